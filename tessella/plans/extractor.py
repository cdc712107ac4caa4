"""A rule-based extractor: grants, payments and dates that clauses state in the sentences of the corpus's three languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import table

MONTHS = "January February March April May June July August September October November December".split()
_MODE, _ENTRY = "((?:S|A|T)?VOD|TV_LINEAR)", "([A-Z][0-9]{4,6}-[0-9]{3,5})"
_DAY_EN = "([0-9]{4}-[0-9]{2}-[0-9]{2}|[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}|[0-9]{1,2} [A-Z][a-z]+ [0-9]{4})"
_DAY_KO = "([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}년 [0-9]{1,2}월 [0-9]{1,2}일)"
_DAY_JA = "([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)"
#: Per language how white space is read (' ' or ''), the sentence of a grant, and which of its groups are title, mode, country, first and last day, entry.
GRANT = {
    "en": (" ", f"show “([^”]+)” by {_MODE} in (?:the )?([A-Z][A-Za-z ]+?) from {_DAY_EN} until {_DAY_EN}, under entry {_ENTRY}", (1, 2, 3, 4, 5, 6)),
    "ko": (" ", f"‘([^’]+)’의 이용을 {_DAY_KO}부터 {_DAY_KO}까지 ([가-힣]+)에서 {_MODE} [가-힣]+으?로 허락하고 이를 등록부 {_ENTRY}", (1, 5, 4, 2, 3, 6)),
    "ja": ("", f"『([^』]+)』の利用を{_DAY_JA}から{_DAY_JA}まで([一-鿿ァ-ヿ]+)において{_MODE}の[^で]+で許諾し、台帳{_ENTRY}", (1, 5, 4, 2, 3, 6)),
}
NAMES = ("title", "mode", "country", "since", "until", "entry")


def day(c: Column) -> Column:
    """A day in any of the forms above, as yyyy-mm-dd; empty if the calendar has no such day."""
    month = F.regexp_extract(c, "([A-Z][a-z]{2})[a-z]*", 1)
    number = F.lpad(F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), month).cast("string"), 2, "0")
    named = F.concat_ws("-", F.regexp_extract(c, "([0-9]{4})", 1), number, F.lpad(F.regexp_extract(c, r"\b([0-9]{1,2})\b", 1), 2, "0"))
    numeric = F.concat_ws("-", F.regexp_extract(c, r"^([0-9]{4})", 1), F.lpad(F.regexp_extract(c, r"^[0-9]{4}\D+([0-9]{1,2})", 1), 2, "0"), F.lpad(F.regexp_extract(c, r"^[0-9]{4}\D+[0-9]{1,2}\D+([0-9]{1,2})", 1), 2, "0"))
    return F.coalesce(F.when(c.rlike("[A-Z]"), named).otherwise(numeric).try_cast("date").cast("string"), F.lit(""))


def extracted_grants(spark, sf):
    """Every grant a clause states: title, mode, country, first and last day and the entry it is recorded under."""
    c = table(spark, sf, "contract_chunk", "id", "chunk_text").filter("chunk_text IS NOT NULL").distinct()
    parts = []
    for lang, (gap, pattern, groups) in GRANT.items():
        flat = F.regexp_replace("chunk_text", r"\s+", gap)
        lists = [F.regexp_extract_all(flat, F.lit(pattern), F.lit(g)) for g in groups]
        parts.append(c.select("id", F.lit(lang).alias("lang"), F.explode(F.arrays_zip(*[x.alias(n) for x, n in zip(lists, NAMES, strict=True)])).alias("g")).select("id", "lang", "g.*"))
    every = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return every.select("id", "lang", "title", "mode", "country", day(F.col("since")).alias("since"), day(F.col("until")).alias("until"), "entry").distinct()


def extracted_amounts(spark, sf):
    """Amounts of money that clauses state, by currency: how many, and the least and greatest."""
    c = table(spark, sf, "contract_chunk", "id", "chunk_text").filter("chunk_text IS NOT NULL").distinct()
    parts = []
    for currency, pattern in AMOUNTS.items():
        found = F.regexp_extract_all("chunk_text", F.lit(pattern), F.lit(1))
        parts.append(c.select("id", F.lit(currency).alias("currency"), F.explode(found).alias("x")))
    every = parts[0].unionAll(parts[1]).unionAll(parts[2]).withColumn("amount", F.expr("try_cast(replace(x, ',', '') AS bigint)")).filter("amount IS NOT NULL")
    return every.groupBy("currency").agg(F.count("*").alias("n"), F.countDistinct("id").alias("clauses"), F.min("amount").alias("least"), F.max("amount").alias("most"))


AMOUNTS = {"USD": "USD\\s+([0-9]{1,3}(?:,[0-9]{3})+)", "KRW": "금\\s+([0-9]{1,3}(?:,[0-9]{3})+)원", "JPY": "金([0-9]{1,3}(?:,[0-9]{3})+)円"}


def queries() -> dict:
    return {f.__name__: f for f in (extracted_grants, extracted_amounts)}


_MON = "CASE regexp_extract({0}, '([A-Z][a-z][a-z])[a-z]*', 1) " + " ".join(f"WHEN '{m[:3]}' THEN '{i:02d}'" for i, m in enumerate(MONTHS, 1)) + " END"


def _day_sql(c: str) -> str:
    named = f"regexp_extract({c}, '([0-9]{{4}})', 1) || '-' || {_MON.format(c)} || '-' || lpad(regexp_extract({c}, '\\b([0-9]{{1,2}})\\b', 1), 2, '0')"
    numeric = f"regexp_extract({c}, '^([0-9]{{4}})', 1) || '-' || lpad(regexp_extract({c}, '^[0-9]{{4}}[^0-9]+([0-9]{{1,2}})', 1), 2, '0') || '-' || lpad(regexp_extract({c}, '^[0-9]{{4}}[^0-9]+[0-9]{{1,2}}[^0-9]+([0-9]{{1,2}})', 1), 2, '0')"
    return f"coalesce(try_cast(CASE WHEN regexp_matches({c}, '[A-Z]') THEN {named} ELSE {numeric} END AS DATE)::VARCHAR, '')"


def oracle_sql() -> dict[str, str]:
    unions = " UNION ALL ".join(
        f"SELECT id, '{lang}' AS lang, " + ", ".join(f"unnest(regexp_extract_all(f, '{pattern}', {g})) AS {n}" for g, n in zip(groups, NAMES, strict=True)) + f" FROM (SELECT id, regexp_replace(chunk_text, '\\s+', '{gap}', 'g') AS f FROM c)"
        for lang, (gap, pattern, groups) in GRANT.items()
    )
    amounts = " UNION ALL ".join(f"SELECT id, '{k}' AS currency, unnest(regexp_extract_all(chunk_text, '{p}', 1)) AS x FROM c" for k, p in AMOUNTS.items())
    c = "WITH c AS (SELECT DISTINCT id, chunk_text FROM contract_chunk WHERE chunk_text IS NOT NULL), e AS ("
    return {
        "extracted_grants": c + unions + f") SELECT DISTINCT id, lang, title, mode, country, {_day_sql('since')} AS since, {_day_sql('until')} AS until, entry FROM e",
        "extracted_amounts": c + amounts + "), a AS (SELECT id, currency, replace(x, ',', '')::BIGINT AS amount FROM e) SELECT currency, count(*) AS n, count(DISTINCT id) AS clauses, min(amount) AS least, max(amount) AS most FROM a GROUP BY 1",
    }
