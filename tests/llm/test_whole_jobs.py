import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixture, neighbours, queries, scans, spans


def test_confusions_are_learned_from_the_corpus(spark):
    """Confusions outside the fixed table, with a sign inside the word; rare words of the language stay."""
    rows = []
    for i in range(60):
        scan, own = i % 3 == 0, "手帳" if i % 8 == 1 else "台帳"
        text = "the period within listed files 영수증을 목록 日本 記載 " + own
        if scan and i % 9 == 0:
            text = text.replace("within", "w!thin").replace("영수증을", "영수중을").replace("記載", "記戴")
        rows.append((i, 10 + i // 15 if scan else 90 + i // 15, ("Silver Yard licence T12345-6789\n" if scan else "") + text, 1, 1))
    df = spark.createDataFrame(rows, "id long, contract_history_id long, chunk_text string, page_start int, page_end int")
    s = scans.Scans(df)
    assert set(s.learned) == {("!", "i"), ("중", "증"), ("戴", "載")}
    assert {r.id for r in s.found().filter("kind = 'misread'").collect()} == {i for i in range(0, 60, 9)}
    text = {r.id: r.paragraph for r in s.paragraphs().collect()}
    assert "within" in text[0] and "영수증을" in text[0] and "記載" in text[0] and "手帳" in text[1]


def test_forms_of_both_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, "ａ b"), (1, "ａ b"), (2, None), (3, "c")], "id long, chunk_text string")
    b = spark.createDataFrame([("1", "a b"), ("x", "é"), ("y", None)], "chunk_id string, text string")
    a.write.parquet(f"{tmp_path}/contract_chunk.parquet")
    b.write.parquet(f"{tmp_path}/bundle_chunk.parquet")
    got = sorted(tuple(r) for r in queries.p5_forms(spark, str(tmp_path)).collect())
    assert got == [("bundle_chunk", "1", "a b"), ("bundle_chunk", "x", "é"), ("contract_chunk", "1", "a b"), ("contract_chunk", "3", "c")]


def brute_passages(docs, n):
    out = set()
    for i, s in docs:
        for j, t in docs:
            if i < j and s == t:
                out |= {(i, j, 0, 0, len(s))} if len(s) >= n else set()
            elif i < j:
                for shift in range(-len(s) + n, len(t) - n + 1):
                    k = max(0, -shift)
                    while k < len(s) and k + shift < len(t):
                        e = k
                        while e < len(s) and e + shift < len(t) and s[e] == t[e + shift]:
                            e += 1
                        if e - k >= n:
                            out.add((i, j, k, k + shift, e - k))
                        k = e + 1
    return out


@pytest.mark.parametrize("limit", [2000, 2])
def test_passages_against_brute_force(spark, limit):
    rnd = random.Random(5)
    long = ["".join(rnd.choice("abcd é🎬한 ") for _ in range(90)) for _ in range(8)]
    docs = [(i, "".join(rnd.choice(long)[rnd.randint(0, 30) :] for _ in range(rnd.randint(1, 3)))) for i in range(25)]
    docs += [(200 + k, long[0] + long[1]) for k in range(3)] + [(300 + k, "only copies " * 3 + long[2][::-1]) for k in range(2)] + [(9, ""), (400, "short")][1:]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in spans.SharedSpans(df, length=60, minimiser=25, bucket_part=limit, aligned=True).passages().collect()]
    assert len(got) == len(set(got)) and set(got) == brute_passages(docs, 60)


def test_coverage_of_every_document(spark, tmp_path):
    text = "".join(map(chr, range(0x4E00, 0x4F00)))
    docs = [(1, text), (2, text), (3, "x" + text[:200]), (4, "alone"), (5, None), (6, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_chars, r.shared_chars, r.shared_share) for r in queries.p10_coverage(spark, str(tmp_path)).collect()}
    assert got == {1: (256, 256, 1.0), 2: (256, 256, 1.0), 3: (201, 200, 0.995025), 4: (5, 0, 0.0), 5: (0, 0, 0.0), 6: (0, 0, 0.0)}
    assert {tuple(r) for r in queries.p10_passages(spark, str(tmp_path)).collect()} == {(1, 2, 0, 0, 256), (1, 3, 0, 1, 200), (2, 3, 0, 1, 200)}


def test_one_clause_in_very_many_records(spark):
    """Ten thousand records with one clause: one set of records, in one part of its buckets and in twenty."""
    clause = "".join(map(chr, range(0x4E00, 0x4E00 + 260)))
    df = spark.range(10_000).selectExpr("id AS doc_id", f"concat('no ', id, ' {clause} end ', id * 7) AS text")
    for part in (spans.BUCKET_PART, 500):
        s = spans.SharedSpans(df, bucket_part=part)
        runs = s.runs().filter("n = 10000").agg(F.countDistinct("group").alias("sets"), F.countDistinct("doc_id").alias("docs")).first()
        assert tuple(runs) == (1, 10_000)
    assert s.links().filter("a < 3 and b < 5").count() == 9


def test_draws_follow_the_distribution():
    rng = np.random.default_rng(4)
    for good, bad, take in ((5, 7, 4), (30, 3, 20), (1, 9, 5), (400, 800, 300), (10**10, 3 * 10**10, 2 * 10**10)):
        got = np.array([mixture.hypergeometric(rng, good, bad, take) for _ in range(4000)], float)
        mean, total = take * good / (good + bad), good + bad
        var = mean * (bad / total) * ((total - take) / (total - 1))
        assert abs(got.mean() - mean) < 5 * (var / 4000) ** 0.5 and 0.9 < got.var() / var < 1.1
        assert got.min() >= max(0, take - bad) and got.max() <= min(good, take)


def test_shards_of_ten_billion_slots():
    """The same random draw at any size: other seeds give other counts, and shards add up to the totals."""
    totals = np.array([7 * 10**9, 2 * 10**9, 10**9 - 5, 5], np.int64)
    parts = [mixture.shard_counts(totals, 64, s, 3) for s in range(64)]
    assert (sum(h for h, _ in parts) == totals).all() and all((parts[i][1] + parts[i][0] == parts[i + 1][1]).all() for i in range(63))
    assert any((mixture.shard_counts(totals, 64, s, 4)[0] != parts[s][0]).any() for s in range(3))
    size = np.array([h.sum() for h, _ in parts])
    assert size.max() - size.min() <= 1


def found_in(spark, rows):
    df = spark.createDataFrame(rows, "id long, contract_history_id long, chunk_text string, page_start int, page_end int")
    s = scans.Scans(df)
    text = {}
    for r in s.paragraphs().orderBy("id", "paragraph_no").collect():
        text.setdefault(r.id, []).append(r.paragraph)
    return {(r.id, r.kind) for r in s.found().collect()}, text


@pytest.mark.parametrize("head", ["Silver Yard licence No. 12", "SILVER YARD - LICENCE AGREEMENT", "Confidential - Do not distribute", "깊은 나루터 이용허락 계약서"])
def test_heads_of_any_form(spark, head):
    """A line that recurs at the page breaks is a head, whatever it says; misread once, it still is."""
    lines = ["alpha beta gamma", "delta epsilon", "zeta eta theta", "iota kappa", "lambda mu nu", "xi omicron"]
    rows = [(i, 1, f"Article {i} (Records)\nThe {a} is kept\n{head if i != 3 else head.replace('e', 'c', 1)}\nby the {a} owner.", i + 20, i + 21) for i, a in enumerate(lines, 1)]
    got, text = found_in(spark, rows)
    assert {i for i, kind in got if kind == "running_head"} == set(range(1, 7))
    assert text[1] == ["Article 1 (Records)", "The alpha beta gamma is kept by the alpha beta gamma owner."]


def test_nothing_is_taken_from_within_a_page(spark):
    head = "Silver Yard licence T12345-6789"
    rows = [(i, 1, f"The clause no {i} is\n{head}  {i + 1}\nkept for {i * 37} days.", i, i + 1) for i in range(1, 7)]
    rows += [(10, 1, f"Payment follows\nthe amended {head}\nas it stands.", 3, 4), (11, 1, f"Payment under\n{head}\nis due.", 3, 3)]
    rows += [(12, 1, "Number of copies to deliver\n2\nto the licensor", 2, 2), (13, 1, "Number of copies to deliver\n3\nto the licensor", 2, 3)]
    got, text = found_in(spark, rows)
    assert {i for i, _ in got} == set(range(1, 7)) and {k for _, k in got} == {"running_head", "page_number"}
    assert text[10] == [f"Payment follows the amended {head} as it stands."] and text[11] == [f"Payment under {head} is due."]
    assert text[12] == ["Number of copies to deliver 2 to the licensor"] and text[13] == ["Number of copies to deliver 3 to the licensor"]


def test_feet_and_bare_numbers(spark):
    names = ["", "alpha beta gamma", "delta epsilon", "zeta eta theta", "iota kappa"]
    rows = [(i, 1, f"The {names[i]} is\n{i}\nkept for {i * 37} days.", i, i + 1) for i in range(1, 5)]
    rows += [(20 + i, 2, f"The {names[i]}\nis kept for {i * 37} days.\nPrinted by the office", i, i) for i in range(1, 5)]
    got, text = found_in(spark, rows)
    assert got == {(i, "page_number") for i in range(1, 5)} | {(i, "running_head") for i in range(21, 25)}
    assert text[1] == ["The alpha beta gamma is kept for 37 days."] and text[21] == ["The alpha beta gamma is kept for 37 days."]


def test_stored_index(spark, tmp_path):
    """Built in part, grown by the rest, asked by vectors of its own and others."""
    x = np.random.default_rng(6).normal(size=(1200, 64)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    frame = lambda r: spark.createDataFrame(r, "id long, embedding array<float>")
    neighbours.StoredIndex.build(frame(rows[:800]), f"{tmp_path}/i").add(frame(rows[800:1000] + rows[900:910]))
    index = neighbours.StoredIndex(spark, f"{tmp_path}/i")
    u = neighbours.unit(x)
    got = index.search(frame([*rows[1000:], (0, rows[0][1]), (5000, None)])).collect()
    s = u[1000:] @ u[:1000].T
    want = {(1000 + i, int(j)) for i in range(200) for j in np.argsort(-s[i])[:5]}
    found = {(r.id, r.other) for r in got if r.id}
    assert len(found) == 1000 and len(found & want) >= 950
    assert max((r.cosine, r.other) for r in got if r.id == 0)[1] == 0  # itself, as it is indexed too
    with pytest.raises(ValueError):
        neighbours.StoredIndex.build(frame([]), f"{tmp_path}/j")


def test_tokens_of_the_mix(spark):
    """Every slot holds the tokens its references name; staged parts go with `close`."""
    from tessella.llm import bpe

    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", f"record {i} " * (i % 40 + 1)) for i in range(300)] + [(900, "a", None), (901, None, "x")], "doc_id long, source string, text string")
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeat int")
    with mixture.Mixture(docs, goal, block=64) as m:
        refs = m.mix().toPandas().sort_values(["shard", "slot", "block_from"])
        ids = {r.doc_id: list(r.ids) for r in bpe.encode(docs.select("doc_id", "text")).collect()}
        want = {k: [t for r in g.itertuples() for t in ids[r.doc_id][r.token_from : r.token_to]] for k, g in refs.groupby(["shard", "slot"])}
        assert {(r.shard, r.slot): list(r.ids) for r in m.tokens().collect()} == want and max(map(len, want.values())) == 64
        kept = list(m._kept)
    assert kept and not m._kept
