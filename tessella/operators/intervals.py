"""Continuous periods and gaps of overlapping, nested and broken intervals (problem 4).

Each entity keeps an ordered map of disjoint half-open day intervals. An insertion finds the intervals it touches by
binary search, replaces them by their union and renews the gaps beside it. The map of a union of rows is the union of
the maps of its parts, so every input partition folds its own rows first and only disjoint intervals are shuffled: an
entity with a third of all rows reaches its final task as a few intervals per input partition. One entity's map can
never hold more intervals than the calendar has separate days, whatever the number of rows.

Defined results: repeated rows, ties and late rows change nothing; null or unknown territory or exclusivity, null keys
and missing, unreadable, empty or reversed periods do not count; an empty table gives no rows; extra columns of any
name are ignored (only named columns are read).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

MINUS_INF, PLUS_INF = -(2**31), 2**31 - 1
#: Interval maps that a map task keeps before it hands them on.
STATE_LIMIT = 200_000


class IntervalMap:
    """Ordered disjoint half-open intervals of one entity, with the gaps between neighbours."""

    __slots__ = ("ends", "gaps", "starts")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.gaps: list[tuple[int, int]] = []  # gaps[i] lies between interval i and i + 1

    def insert(self, lo: int, hi: int) -> None:
        """Add [lo, hi); touching intervals become one. An empty or reversed interval is ignored."""
        if lo >= hi:
            return
        i = bisect_left(self.ends, lo)  # first interval that ends at or after lo
        j = bisect_right(self.starts, hi)  # first interval that starts after hi
        if i < j:
            lo, hi = min(lo, self.starts[i]), max(hi, self.ends[j - 1])
        self.starts[i:j] = [lo]
        self.ends[i:j] = [hi]
        a, b = max(i - 1, 0), i + 1
        near = [(self.ends[k], self.starts[k + 1]) for k in range(a, min(b, len(self.starts) - 1))]
        self.gaps[a : max(j, a)] = near

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends, strict=True))


# --- reading range text -----------------------------------------------------------------------------------------------

_QUOTED = r'((?:[^,"\\]|"(?:[^"\\]|\\.|"")*"|\\.)*)'
_RANGE = re.compile(rf"\s*([\[(]){_QUOTED},{_QUOTED}([\])])\s*")
_INFINITE = {"infinity": PLUS_INF, "+infinity": PLUS_INF, "inf": PLUS_INF, "-infinity": MINUS_INF, "-inf": MINUS_INF}


@lru_cache(maxsize=200_000)
def _bound(raw: str, absent: int) -> int | None:
    """Day number of one bound's text; `absent` where there is none; None where it is no date."""
    if raw == "":
        return absent
    s = raw.replace('""', '"').replace("\\", "").strip().strip('"').strip().lower()
    day = _INFINITE.get(s)
    return parse_day(s) if day is None else day


def parse_range(text: str | None) -> tuple[int, int] | None:
    """Day numbers [lo, hi) of a date range's text; None if it is missing, unreadable, empty or reversed."""
    m = _RANGE.fullmatch(text) if text else None
    if m is None:
        return None
    left, a, b, right = m.groups()
    lo, hi = _bound(a, MINUS_INF), _bound(b, PLUS_INF)
    if lo is None or hi is None:
        return None
    lo += left == "(" and MINUS_INF < lo < PLUS_INF
    hi += right == "]" and MINUS_INF < hi < PLUS_INF
    return (lo, hi) if lo < hi else None


_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def parse_day(text: str) -> int | None:
    """Day number of a date in the less common spellings a range reader accepts; None if it is none of them."""
    s = text.strip().lower()
    bc = bool(re.search(r"\bbc$", s))
    s = re.sub(r"\s*\b(bc|ad)$", "", s)
    if s == "epoch":
        return 0
    s = re.sub(r"[t ]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(z|utc|[+-]\d{1,2}(:?\d{2})?)?$", "", s)
    s = re.sub(r"^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "", s)
    y = m = d = None
    if g := re.fullmatch(r"j(\d+)", s):
        return int(g[1]) - 2440588
    if g := re.fullmatch(r"(\d{4,})[-/. ](\d{1,2})[-/. ](\d{1,2})", s):
        y, m, d = map(int, g.groups())
    elif g := re.fullmatch(r"(\d{4})(\d{2})(\d{2})", s):
        y, m, d = map(int, g.groups())
    elif g := re.fullmatch(r"(\d{4})[.-](\d{3})", s):
        try:
            return date(int(g[1]), 1, 1).toordinal() - 719163 + int(g[2]) - 1
        except ValueError:
            return None
    elif g := re.fullmatch(r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})", s):
        m, d, y = map(int, g.groups())
    elif g := re.fullmatch(r"([a-z]{3,9})\.?[ -]?(\d{1,2})(?:st|nd|rd|th)?,?[ -]+(\d{4})", s):
        m, d, y = _MONTHS.get(g[1][:3]), int(g[2]), int(g[3])
    elif g := re.fullmatch(r"(\d{1,2})(?:st|nd|rd|th)?[ -]?([a-z]{3,9})\.?,?[ -]?(\d{4})", s):
        d, m, y = int(g[1]), _MONTHS.get(g[2][:3]), int(g[3])
    elif g := re.fullmatch(r"(\d{4})[ -]([a-z]{3,9})[ -](\d{1,2})", s):
        y, m, d = int(g[1]), _MONTHS.get(g[2][:3]), int(g[3])
    if not (y and m and d) or not 1 <= m <= 12:
        return None
    return _civil(1 - y if bc else y, m, d)


def _civil(y: int, m: int, d: int) -> int | None:
    """Days from 1970-01-01 in the proleptic Gregorian calendar; None for a day that does not exist."""
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    if not 1 <= d <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]:
        return None
    y -= m <= 2
    era, yoe = y // 400, y % 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def day_text(c: Column) -> Column:
    return (
        F.when(c == MINUS_INF, F.lit("-infinity"))
        .when(c == PLUS_INF, F.lit("infinity"))
        .otherwise(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), c), "yyyy-MM-dd"))
    )


# --- the operator -----------------------------------------------------------------------------------------------------


def _fold(width: int, names: list[str], text: bool):
    """Fold the rows of a partition to the disjoint intervals of each entity. text: the range is one column of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, IntervalMap] = {}

        def out() -> pd.DataFrame:
            rows = [(*k, lo, hi) for k, m in state.items() for lo, hi in m.periods()]
            return pd.DataFrame(rows, columns=[*names[:width], "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch[c].tolist() for c in names), strict=True):
                span = parse_range(row[width]) if text else row[width:]
                if span is None:
                    continue
                k = row[:width]
                m = state.get(k)
                if m is None:
                    m = state[k] = IntervalMap()
                m.insert(*span)
            if len(state) >= STATE_LIMIT:
                yield out()
                state = {}
        if state:
            yield out()

    return run


def _close(width: int, names: list[str]):
    """Of rows sorted by entity: one map at a time, giving its periods and gaps."""

    def rows_of(k: tuple, m: IntervalMap) -> list[tuple]:
        return [(*k, "period", lo, hi) for lo, hi in m.periods()] + [(*k, "gap", lo, hi) for lo, hi in m.gaps]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*names[:width], "kind", *names[width:]]
        key, m = None, None
        for batch in batches:
            rows: list[tuple] = []
            for row in zip(*(batch[c].tolist() for c in names), strict=True):
                k = row[:width]
                if k != key:
                    if m is not None:
                        rows += rows_of(key, m)
                    key, m = k, IntervalMap()
                m.insert(row[width], row[width + 1])
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        if m is not None:
            yield pd.DataFrame(rows_of(key, m), columns=columns)

    return run


def merge_intervals(df: DataFrame, keys: list[str], period: str | None = None, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Periods and gaps per entity: keys, kind ('period' or 'gap'), lo, hi (day numbers, hi exclusive).

    The interval is the text in `period`, or else the day numbers in lo and hi. Rows with a null key or bound do not count.
    """
    ship(df.sparkSession)
    names = [*keys, period] if period else [*keys, lo, hi]
    df = df.select(*names).dropna()
    ends = [T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]
    own = [df.schema[c] for c in keys]
    return (
        df.mapInPandas(_fold(len(keys), names, period is not None), T.StructType([*own, *ends]))
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInPandas(_close(len(keys), [*keys, "lo", "hi"]), T.StructType([*own, T.StructField("kind", T.StringType()), *ends]))
    )


def spelled(c: Column) -> Column:
    """Trimmed of any kind of blank."""
    return F.regexp_replace(c, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", "")


def exclusivity_periods(grants: DataFrame) -> DataFrame:
    """Continuous periods and gaps by which one contract holds one asset in one territory under one exclusivity."""
    territory = F.upper(spelled(F.col("territory")))
    exclusivity = F.regexp_replace(F.lower(spelled(F.col("exclusivity"))), r"(?U)[\s_\-\u2010-\u2015]+", "_")
    rows = grants.select(
        "contract_id", "content_asset_id", territory.alias("territory"), exclusivity.alias("exclusivity"), "period",
        F.lower(spelled(F.col("status"))).alias("status"),
    ).filter(
        (F.col("status") == "active") & F.col("period").isNotNull() & F.col("territory").rlike("^[A-Z]{2}$")
        & F.col("exclusivity").isin("exclusive", "sole", "non_exclusive")
        & F.col("contract_id").isNotNull() & F.col("content_asset_id").isNotNull()
    )
    keys = ["contract_id", "content_asset_id", "territory", "exclusivity"]
    out = merge_intervals(rows, keys, "period")
    return out.select(*keys, "kind", day_text(F.col("lo")).alias("lo"), day_text(F.col("hi")).alias("hi"))
