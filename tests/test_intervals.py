import random

import pytest

from tessella.operators.intervals import MINUS_INF, PLUS_INF, IntervalMap, exclusivity_periods, merge_intervals, parse_day, parse_range

SCHEMA = "contract_id long, content_asset_id long, territory string, exclusivity string, period string, status string"


def brute(spans, top=60):
    days = {d for lo, hi in spans for d in range(lo, hi)}
    periods, start = [], None
    for d in range(-1, top + 1):
        if d in days and start is None:
            start = d
        if d not in days and start is not None:
            periods.append((start, d))
            start = None
    return periods, [(a[1], b[0]) for a, b in zip(periods[:-1], periods[1:], strict=True)]


def test_map_against_brute_force():
    rnd = random.Random(5)
    for _ in range(400):
        spans = [(lo, lo + rnd.randint(0, 7)) for lo in (rnd.randint(0, 45) for _ in range(rnd.randint(0, 14)))]
        m = IntervalMap()
        for s in spans:
            m.insert(*s)
        assert (m.periods(), m.gaps) == brute(spans)


@pytest.mark.parametrize(("text", "want"), [
    ("[2020-01-01,2020-01-03)", (18262, 18264)), ("(2020-01-01,2020-01-03]", (18263, 18265)), (' [ "2020-01-01" , "2020-01-03" ) ', (18262, 18264)),
    ("[,2020-01-03)", (MINUS_INF, 18264)), ("[2020-01-01,infinity)", (18262, PLUS_INF)), ("(-infinity,)", (MINUS_INF, PLUS_INF)), ("(,)", (MINUS_INF, PLUS_INF)),
    ("empty", None), (" EMPTY ", None), ("[2020-01-03,2020-01-01)", None), ("[2020-01-01,2020-01-01)", None), ("[2020-01-01,2020-01-01]", (18262, 18263)),
    ("(2020-01-01,2020-01-02)", None), ("", None), (None, None), ("[2020-02-30,2020-03-01)", None), ("[20200101,20200103)", (18262, 18264)), ("[Jan 1 2020,3 January 2020)", (18262, 18264)), ("nonsense", None),
])
def test_range_text(text, want):
    assert parse_range(text) == want


def test_days():
    assert parse_day("2000-01-01") == 10957
    assert parse_day("J2451545") == 10957
    assert parse_day("0001-01-01 BC") is not None
    assert parse_day("2001-02-29") is None


def test_dirty_rows_and_clashing_columns(spark):
    rows = [
        (1, 1, "kr", "Exclusive", "[2020-01-01,2020-02-01)", "active"), (1, 1, " KR ", "EXCLUSIVE", "[2020-02-01,2020-02-10)", "active"), (1, 1, "KR", "exclusive", "[2020-03-01,)", "active"),
        (1, 1, "KR", "exclusive", "[2020-03-01,)", "active"), (1, 1, "KR", "exclusive", "[2020-02-12,2020-02-20)", "terminated"), (1, 1, None, "exclusive", "[2020-01-01,)", "active"),
        (1, 1, "KR", None, "[2020-01-01,)", "active"), (1, 1, "KR", "exclusive", None, "active"), (None, 1, "KR", "exclusive", "[2020-01-01,)", "active"), (2, 1, "KR", "Non Exclusive", "empty", "active"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS lo", "'x' AS kind", "'y' AS __a")
    got = sorted(tuple(r) for r in exclusivity_periods(df).collect())
    assert got == [(1, 1, "KR", "exclusive", "gap", "2020-02-10", "2020-03-01"), (1, 1, "KR", "exclusive", "period", "2020-01-01", "2020-02-10"), (1, 1, "KR", "exclusive", "period", "2020-03-01", "infinity")]


def test_empty_table(spark):
    assert exclusivity_periods(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_entity_with_most_rows(spark):
    df = spark.range(3000).selectExpr("1L AS k", "cast(id * 3 AS int) AS lo", "cast(id * 3 + 1 + id % 3 AS int) AS hi")
    got = merge_intervals(df, ["k"]).toPandas()
    assert (got.kind == "period").sum() == 2001 and (got.kind == "gap").sum() == 2000
