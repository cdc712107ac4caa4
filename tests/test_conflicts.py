import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import ranges, registry, text
from tessella.plans import conflicts, extraction
from tessella.plans.conflicts import FIRST, LAST


@pytest.mark.parametrize("days,window", [(365, (0, 47_482)), (7, (0, 60)), (1000, (10, 20))])
def test_overlaps_of_unbounded_ranges(spark, days, window):
    rnd = random.Random(days)
    rows = [(i, rnd.randint(0, 2), rnd.choice([FIRST, rnd.randint(-50, 90)]), rnd.choice([LAST, rnd.randint(-50, 120)])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, k int, lo int, hi int")
    got = [tuple(r) for r in ranges.day_overlap_join(df, df, ["k"], days=days, window=window, extra=F.col("a.id") < F.col("b.id")).select("a.id", "b.id").collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3]}
    assert len(got) == len(set(got)) and set(got) == want and want


def grant_table(spark, path, rows):
    schema = "id long, contract_id long, contract_history_id long, content_asset_id long, territory string, legal_right string, exploitation_mode string, period string, exclusivity string, status string, evidence string"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/rights_grant.parquet")


def test_what_conflicts(spark, tmp_path):
    base = (1, 10, 100, 5, "KR", "PUBLIC_TRANSMISSION", "VOD", "[2024-01-01,2025-01-01)", "exclusive", "active", None)
    other = lambda i, **k: tuple({**dict(zip(("id", "contract_id", "contract_history_id", "content_asset_id", "territory", "legal_right", "exploitation_mode", "period", "exclusivity", "status", "evidence"), base, strict=True)), "id": i, "contract_id": 20, "contract_history_id": 200, **k}.values())
    rows = [
        base, base, other(2, legal_right="BROADCAST", exploitation_mode="SVOD"), other(3, period="[2025-01-01,2026-01-01)"), other(4, period="[2024-12-31,)", exclusivity="Non-Exclusive"),
        other(5, territory=" kr "), other(6, territory="JP"), other(7, status="terminated"), other(8, contract_id=10), other(9, exploitation_mode="THEATRICAL"), other(10, period="empty"), other(11, period=None), other(12, territory=None),
    ]
    grant_table(spark, tmp_path, rows)
    got = {r.incoming_id: (r.existing_id, r.overlap_period, r.legal_right_relation, r.exploitation_mode_relation, r.blocking_layer, r.reason) for r in conflicts.grant_conflicts(spark, str(tmp_path)).filter("existing_id = 1").collect()}
    assert got == {
        2: (1, "[2024-01-01,2025-01-01)", "existing_is_broader", "existing_is_broader", "no_exclusive_overlap", "EXCLUSIVE_OVERLAP"),
        4: (1, "[2024-12-31,2025-01-01)", "same", "same", "no_exclusivity_conflict", "EXCLUSIVITY_MISMATCH"), 5: (1, "[2024-01-01,2025-01-01)", "same", "same", "no_exclusive_overlap", "EXCLUSIVE_OVERLAP"),
    }
    report = {r.contract_history_id: r for r in conflicts.conflict_reports(spark, str(tmp_path)).collect()}
    assert report[100].conflicts >= 3 and report[100].report.startswith('{"conflicts":[{"incoming":{"legal_right":"PUBLIC_TRANSMISSION"')


def test_evidence_that_holds(spark, tmp_path):
    good, docs = {"quote": "x"}, []
    import json

    docs.append(json.dumps({k: good for k in conflicts.EVIDENCE_KEYS}))
    docs.append(json.dumps({"legal_right": {"quote": " "}, "territory": [good, {"quote": ""}], "period": [good, good], "exclusivity": "x"}))
    docs.append(None)
    grant_table(spark, tmp_path, [(i, 1, 1, 1, "KR", "BROADCAST", "VOD", "[,)", "sole", "active", d) for i, d in enumerate(docs)])
    got = {(r.key, r.valid): r.grants for r in conflicts.evidence_validity(spark, str(tmp_path)).collect()}
    assert got == {(k, True): 2 if k == "period" else 1 for k in conflicts.EVIDENCE_KEYS} | {(k, False): 1 if k == "period" else 2 for k in conflicts.EVIDENCE_KEYS}


@pytest.mark.parametrize("payloads", [[], [None, "{}", "[]", '{"a": 1}'], ['{"rights_grants": {"grant_ref": "g"}, "evidence": ["x"]}']])
def test_results_with_little_in_them(spark, tmp_path, payloads):
    spark.createDataFrame([(str(i), p, None) for i, p in enumerate(payloads)], "tmpid string, payload string, created_at timestamp").write.parquet(f"{tmp_path}/extract_result.parquet")
    rows = {name: q(spark, str(tmp_path)).count() for name, q in extraction.queries().items()}
    grants = sum("rights_grants" in (p or "") for p in payloads)
    assert rows["effective_territories"] == grants and rows["field_evidence"] == 2 * grants and rows["contract_parties"] == 0


def test_territories_of_a_grant(spark, tmp_path):
    doc = '{"rights_grants": [{"territory": {"values": ["North", "ASIA", "Atlantis", "FR"], "excluded_values": ["HK"], "definitions": [{"term": "North", "members": ["SE", "NO"]}]}}]}'
    spark.createDataFrame([("t", doc, None)], "tmpid string, payload string, created_at timestamp").write.parquet(f"{tmp_path}/extract_result.parquet")
    assert tuple(extraction.effective_territories(spark, str(tmp_path)).first()) == ("t", "rights_grants[0]", "CN,FR,JP,KR,NO,SE,TW", "Atlantis")


def test_functions_by_name(spark):
    names = registry.register(spark)
    got = spark.sql("SELECT plain_key('A b-C_'), round(word_similarity('word', 'two words'), 6), size(trigrams('ab c')), cosine(array(1D, 0D), array(0D, 2D)), token_units('한a'), squash(' a  b '), merge_patch('{\"a\":1}', '{\"a\":null}')").first()
    assert tuple(got) == ("abc", 0.8, 5, 0.0, 27, "ab", "{}") and "ranges_meet" in names


def test_merge_patch_against_recursion():
    def plain(t, p):
        if not isinstance(p, dict):
            return p
        out = dict(t) if isinstance(t, dict) else {}
        for k, v in p.items():
            out = {x: y for x, y in out.items() if x != k} if v is None else out | {k: plain(out.get(k), v)}
        return out

    rnd = random.Random(1)
    value = lambda d: rnd.choice([None, 1, "x", [1]]) if d == 0 or rnd.random() < 0.4 else {rnd.choice("abc"): value(d - 1) for _ in range(3)}
    for _ in range(500):
        t, p = value(3), value(3)
        before = repr(t)
        assert text.merge_patch_value(t, p) == plain(t, p) and repr(t) == before
