"""Functions by name for SQL: `register(spark)` makes them known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..session import ship
from . import text

#: Vectorised functions.
VECTORISED = {"word_similarity": text.word_similarity, "strict_word_similarity": text.strict_word_similarity, "nfkc": text.nfkc, "nfc": text.nfc, "merge_patch": text.merge_patch, "reading_order": text.reading_order}
#: Functions that are expressions over built-in ones and stay in the JVM: signature, type, body.
EXPRESSIONS = {
    "plain_key(s STRING)": ("STRING", r"lower(regexp_replace(s, '(?U)[\\s\\p{Punct}_]+', ''))"),
    "squash(s STRING)": ("STRING", r"regexp_replace(s, '(?U)\\s+', '')"),
    "trigrams(s STRING)": (
        "ARRAY<STRING>",
        r"array_distinct(flatten(transform(filter(split(lower(s), '(?U)[^\\w]+|_'), w -> w <> ''), w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))",
    ),
    "token_units(s STRING)": ("INT", "regexp_count(s, '[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]') * 13 + char_length(s) * 7"),
    "ranges_meet(a_lo DATE, a_hi DATE, b_lo DATE, b_hi DATE)": ("BOOLEAN", "coalesce(a_lo < b_hi, true) AND coalesce(b_lo < a_hi, true) AND coalesce(a_lo < a_hi, true) AND coalesce(b_lo < b_hi, true)"),
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": (
        "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0)",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """The names that SQL of this session may use from now on."""
    ship(spark)
    for name, f in VECTORISED.items():
        spark.udf.register(name, f)
    for signature, (kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return sorted([*VECTORISED, *(s.split("(")[0] for s in EXPRESSIONS)])
