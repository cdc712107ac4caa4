"""One form for texts that look the same (problem 5).

A text is cut into plain runs, whose characters stand for themselves, and clusters: stretches of characters that have a
mapping or combine, with the character before them. The distinct clusters of all texts are exploded into positioned code
points, broadcast-joined with the decomposition and look-alike mappings, their combining marks ordered by class, and
recomposed; then each text is rebuilt from its runs and its clusters' forms in order. Texts without clusters are their own
form and take no part in this.

The mapping is bounded by Unicode (under 20,000 rows) and derived from its character data: canonical decompositions of all
characters; width variants, ligatures, radicals and Roman numerals to the characters they look like; letters of other
scripts to the Latin letters they cannot be told from; every kind of blank to a space, of line break to a line feed, of
hyphen to a hyphen; invisible characters to nothing. Accents, digits, case, words and dashes longer than a hyphen remain.
Blanks at the end of a line or text cannot be seen and are dropped.

Defined results: a null text has a null form; an empty text or one of invisible characters has the empty form, which is
paired with nothing; repeated rows count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import ship, spread, staged

# Letters that cannot be told from a Latin letter, and that letter.
LOOKALIKE = (
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ϳj ͿJ "
    "АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ ҮY аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw "
    "ɡg օo"
)
# Code points that cannot be seen.
INVISIBLE = [0x00AD, 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x3164, 0xFEFF, 0xFFA0, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)]
# Blanks and hyphens of all kinds.
BLANKS = [0x09, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
BREAKS = [0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029]
HYPHENS = [0x2010, 0x2011, 0xFE63, 0xFF0D]


def _compatible(cp: int, kind: str) -> bool:
    """Does a compatibility decomposition of this kind leave the look unchanged?"""
    return kind in ("<wide>", "<narrow>", "<small>", "<noBreak>") or 0x2E80 <= cp <= 0x2FDF or 0x2160 <= cp <= 0x217F or 0xFB00 <= cp <= 0xFB06


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Decomposed form of every character that is not its own."""
    alike = {pair[0]: pair[1] for pair in LOOKALIKE.split()}
    alike |= dict.fromkeys(map(chr, INVISIBLE), "") | dict.fromkeys(map(chr, BLANKS), " ") | dict.fromkeys(map(chr, BREAKS), "\n") | dict.fromkeys(map(chr, HYPHENS), "-")

    def down(c: str) -> str:
        if c in alike:
            return alike[c]
        d = unicodedata.decomposition(c)
        if d.startswith("<"):
            kind, *rest = d.split()
            if not _compatible(ord(c), kind):
                return c
            return "".join(down(chr(int(x, 16))) for x in rest)
        return "".join(down(chr(int(x, 16))) for x in d.split()) if d else c

    out = {}
    for cp in (*range(0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)):
        c = chr(cp)
        if cp < 0x80 and c not in "\t\x0b\x0c\r":
            continue
        if (x := down(c)) != c:
            out[c] = x
    for cp in range(0xAC00, 0xD7A4):  # Hangul syllables by rule
        i = cp - 0xAC00
        out[chr(cp)] = chr(0x1100 + i // 588) + chr(0x1161 + i % 588 // 28) + (chr(0x11A7 + i % 28) if i % 28 else "")
    return out


@lru_cache(maxsize=1)
def _composites() -> dict[tuple[str, str], str]:
    """Pairs that compose, and what they compose to."""
    out = {}
    for cp in range(0xC0, 0x110000):
        d = unicodedata.decomposition(chr(cp))
        if d and not d.startswith("<") and len(x := d.split()) == 2 and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            out[chr(int(x[0], 16)), chr(int(x[1], 16))] = chr(cp)
    return out


def _pair(a: str, b: str) -> str | None:
    x, y = ord(a[0]) if len(a) == 1 else 0, ord(b)
    if 0x1100 <= x < 0x1113 and 0x1161 <= y < 0x1176:
        return chr(0xAC00 + (x - 0x1100) * 588 + (y - 0x1161) * 28)
    if 0xAC00 <= x < 0xD7A4 and (x - 0xAC00) % 28 == 0 and 0x11A8 <= y < 0x11C3:
        return chr(x + y - 0x11A7)
    return _composites().get((a, b))


def recompose(parts: list[str]) -> str:
    """Compose decomposed characters whose marks are in order; a mark is blocked by one of its own class before it."""
    out: list[str] = []
    base, last = -1, 0  # the starter that marks attach to; class of the last mark kept after it
    for c in parts:
        k = unicodedata.combining(c)
        if base >= 0 and (last < k or last == 0 and base == len(out) - 1) and (made := _pair(out[base], c)):
            out[base] = made
            continue
        out.append(c)
        if k == 0:
            base, last = len(out) - 1, 0
        else:
            last = k
    return "".join(out)


def _ranges(cps: list[int]) -> str:
    out, start = [], cps[0]
    for a, b in zip(cps, [*cps[1:], -9], strict=True):
        if b != a + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{a:X}}}" if a > start else f"\\x{{{a:X}}}")
            start = b
    return "".join(out)


@lru_cache(maxsize=1)
def classes() -> tuple[str, str]:
    """Java character classes of the characters that have a form of their own or combine with what is before them, and
    of all others. Both first ask for the blocks that most text is made of, which spares the long list of ranges."""
    m = mapping()
    cps = {ord(c) for c, d in m.items() if not 0xAC00 <= ord(c) < 0xD7A4 and recompose(list(d)) != c}
    cps |= {cp for cp in range(0x300, 0x1F000) if not 0xD800 <= cp < 0xE000 and unicodedata.combining(chr(cp))}
    cps |= {*range(0x1100, 0x1200), *range(0xA960, 0xA980), *range(0xD7B0, 0xD7FF)}
    common = [cp for a, b in ((0x0A, 0x0A), (0x20, 0x7E), (0xAC00, 0xD7A3), (0x4E00, 0x9FFF), (0x3001, 0x30FF), (0x2014, 0x201D), (0xC0, 0x17F)) for cp in range(a, b + 1) if cp not in cps]
    often, special = _ranges(sorted(common)), _ranges(sorted(cps))
    return f"[[^{often}]&&[{special}]]", f"[{often}[^{special}]]"


def mapping_table(spark: SparkSession) -> DataFrame:
    """ch, parts (its decomposed characters with their combining class)."""
    rows = [(c, [(x, unicodedata.combining(x)) for x in d]) for c, d in mapping().items()]
    rows += [(chr(cp), [(chr(cp), unicodedata.combining(chr(cp)))]) for cp in range(0x300, 0x1F000) if not 0xD800 <= cp < 0xE000 and unicodedata.combining(chr(cp)) and chr(cp) not in mapping()]
    parts = pa.list_(pa.struct([("c", pa.string()), ("class", pa.int32())]))
    columns = {"ch": [c for c, _ in rows], "parts": pa.array([[{"c": x, "class": k} for x, k in p] for _, p in rows], parts)}
    return spark.createDataFrame(pa.table(columns))


def clusters_form(clusters: DataFrame) -> DataFrame:
    """el and form of distinct clusters."""

    @F.pandas_udf(T.StringType())
    def compose(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: recompose(list(p)))

    points = clusters.select("el", F.posexplode(F.split("el", "")).alias("pos", "ch"))
    itself = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("class")))
    mapped = points.join(F.broadcast(mapping_table(clusters.sparkSession)), "ch", "left").select("el", "pos", F.posexplode(F.coalesce("parts", itself)).alias("sub", "part"))
    flat = mapped.select("el", "pos", "sub", "part.c", "part.class")
    # Marks move only among the marks after one starter, by class and, within a class, by place.
    w = W.partitionBy("el").orderBy("pos", "sub").rowsBetween(W.unboundedPreceding, 0)
    placed = flat.withColumn("starter", F.sum((F.col("class") == 0).cast("int")).over(w))
    listed = placed.groupBy("el").agg(F.sort_array(F.collect_list(F.struct("starter", "class", "pos", "sub", "c"))).alias("p"))
    known = listed.select("el", compose(F.transform("p", lambda x: x["c"])).alias("form"))
    return clusters.join(known, "el", "left").select("el", F.coalesce("form", F.lit("")).alias("form"))


def settled(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"[ \t]+(?=\n|\z)", "")


def same_form(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, kept columns, form: the text in the form all texts that look like it have. One row per distinct row."""
    ship(df.sparkSession)
    special, other = classes()
    rows = spread(df.select(key, *keep, F.regexp_replace(text, "\r\n", "\n").alias("__t"))).withColumn("__dirty", F.coalesce(F.col("__t").rlike(special), F.lit(False)))
    clean = rows.filter(~F.col("__dirty")).select(key, *keep, settled(F.col("__t")).alias("form"))
    dirty = rows.filter("__dirty")
    # Neighbouring plain characters go together; a cluster takes the plain character before it.
    pattern = f"(?s){other}?{special}+|{other}+(?!{special})"
    pieces = dirty.select(key, *keep, F.xxhash64("__t").alias("__h"), F.posexplode(F.regexp_extract_all("__t", F.lit(pattern), 0)).alias("__at", "el"))
    pieces = pieces.withColumn("__special", F.col("el").rlike(special))
    forms = staged(clusters_form(pieces.filter("__special").select("el").distinct()), "forms")
    plain = pieces.filter(~F.col("__special")).select(key, *keep, "__h", "__at", F.col("el").alias("form"))
    special = pieces.filter("__special").join(forms, "el").select(key, *keep, "__h", "__at", "form")
    rebuilt = plain.unionByName(special).groupBy(key, *keep, "__h").agg(F.sort_array(F.collect_set(F.struct("__at", "form"))).alias("p"))
    rebuilt = rebuilt.select(key, *keep, settled(F.array_join(F.transform("p", lambda x: x["form"]), "")).alias("form"))
    return clean.unionByName(rebuilt)


def alike_pairs(a: DataFrame, a_key: str, a_text: str, b: DataFrame, b_key: str, b_text: str, group: str) -> DataFrame:
    """Pairs of rows of one group whose texts look the same but are not the same characters."""

    def digests(df: DataFrame, key: str, text: str) -> DataFrame:
        raw = df.filter(F.col(text).isNotNull() & F.col(key).isNotNull() & F.col(group).isNotNull()).select(F.col(key), F.col(group), F.col(text).alias("t"))
        raw = raw.withColumn("raw", F.unhex(F.md5("t")))
        form = same_form(raw, key, "t", (group, "raw"))
        return form.filter("form <> ''").select(key, group, "raw", F.unhex(F.md5("form")).alias("form")).distinct()

    x = digests(a, a_key, a_text).withColumnRenamed("raw", "raw_a")
    y = digests(b, b_key, b_text).withColumnRenamed("raw", "raw_b")
    return x.join(y, [group, "form"]).filter("raw_a <> raw_b").select(a_key, b_key).distinct()
