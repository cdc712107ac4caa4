"""Half-open range algebra on pairs of columns; a null bound is unbounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nonempty(lo, hi) -> Column:
    return F.coalesce(_c(lo) < _c(hi), F.lit(True))


def overlaps(a_lo, a_hi, b_lo, b_hi) -> Column:
    """Do two non-empty ranges share a point?"""
    meet = F.coalesce(_c(a_lo) < _c(b_hi), F.lit(True)) & F.coalesce(_c(b_lo) < _c(a_hi), F.lit(True))
    return meet & nonempty(a_lo, a_hi) & nonempty(b_lo, b_hi)


def contains(a_lo, a_hi, b_lo, b_hi) -> Column:
    """Does range a hold all of range b?"""
    left = _c(a_lo).isNull() | F.coalesce(_c(a_lo) <= _c(b_lo), F.lit(False))
    return left & (_c(a_hi).isNull() | F.coalesce(_c(b_hi) <= _c(a_hi), F.lit(False)))


def intersection_text(a_lo, a_hi, b_lo, b_hi) -> Column:
    """The common part as '[lo,hi)'; a missing bound is empty text, no common part is 'empty'."""
    lo, hi = F.greatest(_c(a_lo), _c(b_lo)), F.least(_c(a_hi), _c(b_hi))
    text = F.concat(F.lit("["), F.coalesce(lo.cast("string"), F.lit("")), F.lit(","), F.coalesce(hi.cast("string"), F.lit("")), F.lit(")"))
    return F.when(overlaps(a_lo, a_hi, b_lo, b_hi), text).otherwise(F.lit("empty"))


def inclusive_to_half_open(end: str | Column) -> Column:
    return F.date_add(_c(end), 1)


def half_open_to_inclusive(hi: str | Column) -> Column:
    return F.date_sub(_c(hi), 1)


def relation(a_lo, a_hi, b_lo, b_hi) -> Column:
    """same, a_broader, b_broader or overlap, of two ranges that meet."""
    same = (_c(a_lo) == _c(b_lo)) & (_c(a_hi) == _c(b_hi))
    return (
        F.when(same, "same").when(contains(a_lo, a_hi, b_lo, b_hi), "a_broader").when(contains(b_lo, b_hi, a_lo, a_hi), "b_broader").otherwise("overlap")
    )


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], lo: str = "p_lo", hi: str = "p_hi", days: int = 90, extra: Column | None = None) -> DataFrame:
    """Rows of a and b (aliased 'a' and 'b') with equal keys and overlapping date ranges.

    Every row is posted in each bin of `days` its range touches, and rows meet by key and bin, so a key with very many
    rows is spread over its bins instead of being compared as a whole; a pair is kept only in the bin where its common
    part begins. Ranges must be bounded.
    """
    at = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    post = lambda df: df.filter(F.col(lo) < F.col(hi)).withColumn("__bin", F.explode(F.sequence(at(F.col(lo)), at(F.date_sub(F.col(hi), 1)))))
    x, y = post(a).alias("a"), post(b).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "__bin")]
    first = F.col("a.__bin") == at(F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}")))
    meet = overlaps(f"a.{lo}", f"a.{hi}", f"b.{lo}", f"b.{hi}")
    return x.join(y, reduce(lambda p, q: p & q, [*on, meet, first] + ([extra] if extra is not None else [])))


def day_overlap_join(a: DataFrame, b: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", days: int = 365, window: tuple[int, int] = (0, 47_482), extra: Column | None = None) -> DataFrame:
    """As `overlap_join`, of ranges in days since 1970 that may be unbounded (very small and large days).

    Bins lie within `window` (1970 to 2100); what lies before or after it falls into the first or last bin, so an
    unbounded range is posted in as many bins as the window has and no more."""
    first, last = window[0] // days, window[1] // days
    at = lambda c: F.least(F.greatest(F.floor(c / days), F.lit(first)), F.lit(last))
    post = lambda df: df.filter(F.col(lo) < F.col(hi)).withColumn("__bin", F.explode(F.sequence(at(F.col(lo)), at(F.col(hi) - 1))))
    x, y = post(a).alias("a"), post(b).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "__bin")]
    begins = F.col("a.__bin") == at(F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}")))
    meet = (F.col(f"a.{lo}") < F.col(f"b.{hi}")) & (F.col(f"b.{lo}") < F.col(f"a.{hi}"))
    return x.join(y, reduce(lambda p, q: p & q, [*on, begins, meet] + ([extra] if extra is not None else [])))


def with_span(df: DataFrame, code: str, dim: DataFrame, lo: str = "lo", hi: str = "hi", strict: bool = True) -> DataFrame:
    """df with the span of each code from a small dimension (code, lo, hi). A code that it does not have is an error, or (not
    strict) has no span; spans that df brought along are replaced. A null code has none."""
    from pyspark.sql.functions import broadcast

    spans = broadcast(dim.select(F.col("code").alias(code), F.col(lo), F.col(hi)))
    joined = df.drop(lo, hi).join(spans, code, "left")
    if not strict:
        return joined
    known = F.when(F.col(code).isNotNull() & F.col(lo).isNull(), F.raise_error(F.concat(F.lit("unknown code: "), F.col(code))).cast("int")).otherwise(F.col(lo))
    return joined.withColumn(lo, known)
