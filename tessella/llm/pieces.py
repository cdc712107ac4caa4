"""Splitting oversized items at natural boundaries (problem 1).

A text that costs more than the limit is bisected: among the places near the middle the strongest boundary is cut (line
end, then sentence end, then clause, then word); if there is no line or sentence end near the middle the nearest one
anywhere is taken; halves that still cost more than the limit less the overlap are bisected again. At last every piece but
the first is given the end of the piece before it, up to the overlap, from a word's begin where there is one. So every
piece costs at most the limit, pieces are in order, and without their overlaps they make up the text exactly.

Costs are counted in whole units (a wide code point 20, any other 7, a token 20), so no rounding is involved. The cost is
found in the JVM; only texts over the limit go through Python, one text at a time, in memory of its own length.

Defined results: null and empty texts have no pieces; a text within the limit is one piece; repeated rows count once; a
text without boundaries is cut anywhere, but not before a combining mark if another place is near; clause numbers are kept
as they are, also null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

LIMIT, OVERLAP, WIDE, NARROW, UNIT = 480, 48, 20, 7, 20
#: Code points that cost a whole token.
WIDE_RANGES = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF))
_WIDE_CLASS = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in WIDE_RANGES)

_PIECES = T.ArrayType(T.StructType([T.StructField("piece_text", T.StringType()), T.StructField("overlap_chars", T.IntegerType())]))
_LINE, _SENTENCE, _CLAUSE, _WORD = 4, 3, 2, 1
_MARKS = (
    (re.compile(r"\s(?=\S)"), _WORD),
    (re.compile(r"[,;:，；、](?:\s+|(?=\S))"), _CLAUSE),
    (re.compile(r"(?:[.!?](?=[\"'”’)\]]*\s+[^\Wa-z]|[\"'”’)\]]*\s+[“‘\"'(])|[。．！？｡])[\"'”’」』)）\]]*\s*"), _SENTENCE),
    (re.compile(r"(?:\r\n|[\n\r\v\f\x85  ])+"), _LINE),
)


def cost_units(text: Column) -> Column:
    """Cost of a text in units."""
    return F.regexp_count(text, F.lit(f"[{_WIDE_CLASS}]")) * (WIDE - NARROW) + F.char_length(text) * NARROW


def unit_costs(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = np.zeros(len(cp), bool)
    for a, b in WIDE_RANGES:
        wide |= (cp >= a) & (cp <= b)
    return np.where(wide, WIDE, NARROW).astype(np.int64)


def boundaries(text: str) -> np.ndarray:
    """Strength of a cut before each code point (0: inside a word)."""
    strength = np.zeros(len(text) + 1, np.int8)
    for pattern, power in _MARKS:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        strength[ends] = np.maximum(strength[ends], power)
    if re.search("[̀-ͯᅠ-ᇿ‍゙゚︀-️]", text):
        for i, c in enumerate(text):
            if unicodedata.combining(c) or c in "‍︎️" or "ᅠ" <= c <= "ᇿ":
                strength[i] = -1
    return strength


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start with overlap, start, end) of the pieces of a text."""
    limit, overlap = limit * UNIT, overlap * UNIT
    costs = unit_costs(text)
    sums = np.concatenate([[0], np.cumsum(costs)])
    if sums[-1] <= limit:
        return [(0, 0, len(text))]
    core = limit - overlap
    strength = boundaries(text)

    def cut(a: int, b: int) -> int:
        middle = (sums[a] + sums[b]) / 2
        quarter = (sums[b] - sums[a]) / 4
        lo, hi = max(a + 1, int(np.searchsorted(sums, middle - quarter))), min(b - 1, int(np.searchsorted(sums, middle + quarter)))
        lo, hi = min(lo, b - 1), max(hi, a + 1)
        near = strength[lo : hi + 1]
        if near.max(initial=-1) < _SENTENCE and strength[a + 1 : b].max(initial=-1) >= _SENTENCE:
            lo, near = a + 1, strength[a + 1 : b]  # the nearest line or sentence end anywhere
            at = lo + np.flatnonzero(near >= _SENTENCE)
        else:
            at = lo + np.flatnonzero(near == near.max())
        return int(at[np.argmin(np.abs(sums[at] - middle))])

    done, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if sums[b] - sums[a] <= core or b - a < 2:
            done.append((a, b))
            continue
        m = cut(a, b)
        todo += [(m, b), (a, m)]
    done.sort()
    out = [(done[0][0], *done[0])]
    for (before, _), (a, b) in zip(done[:-1], done[1:], strict=True):
        start = max(before, int(np.searchsorted(sums, sums[a] - overlap)))
        words = start + np.flatnonzero(strength[start:a] >= _WORD)
        if len(words) and start > before:
            start = int(words[0])
        while start < a and strength[start] < 0:
            start += 1
        out.append((start, a, b))
    return out


def pieces(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, kept columns, piece_no (from 0), pieces, overlap_chars and piece_text of every text."""
    ship(df.sparkSession)

    @F.pandas_udf(_PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"piece_text": t[s:b], "overlap_chars": a - s} for s, a, b in split(t, limit, overlap)])

    cut = cut.asNondeterministic()  # so that a filter on its result does not run it twice
    rows = df.select(key, *keep, F.col(text).alias("__t")).filter(F.col("__t").isNotNull() & (F.col("__t") != "")).distinct()
    rows = rows.withColumn("__over", cost_units(F.col("__t")) > limit * UNIT)
    one = F.array(F.struct(F.col("__t").alias("piece_text"), F.lit(0).alias("overlap_chars")))
    whole = rows.filter(~F.col("__over")).withColumn("__p", one)
    parts = rows.filter("__over").withColumn("__p", cut("__t"))
    both = whole.select(key, *keep, "__p").unionByName(parts.select(key, *keep, "__p"))
    flat = both.select(key, *keep, F.size("__p").alias("pieces"), F.posexplode("__p").alias("piece_no", "x"))
    return flat.select(key, *keep, "piece_no", "pieces", "x.overlap_chars", "x.piece_text")


def over_limit(chunks: DataFrame, stats: DataFrame) -> DataFrame:
    """Per history: chunks over the limit as counted now and as reported (-1 where nothing was reported)."""
    now = chunks.filter(F.col("contract_history_id").isNotNull()).select("contract_history_id", "chunk_id", "text").distinct()
    now = now.groupBy("contract_history_id").agg(F.sum((F.coalesce(cost_units(F.col("text")), F.lit(0)) > LIMIT * UNIT).cast("int")).alias("counted"))
    told = stats.filter(F.col("contract_history_id").isNotNull()).groupBy("contract_history_id").agg(F.max("over_limit").alias("reported"))
    return now.join(told, "contract_history_id", "left").select("contract_history_id", F.col("counted").cast("int").alias("counted"), F.coalesce("reported", F.lit(-1)).alias("reported"))
