"""Smaller queries: codes and their spans, products of axes, scores, dates, patches, stale rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as R
from ..sources.tables import table
from .rights import AXES_SQL, LEGAL_RIGHTS, axis


def code_spans(spark, sf):
    """Span of every code in use; unknown codes have the span (-1, -1)."""
    dim = F.broadcast(axis(spark, LEGAL_RIGHTS).select(F.col("code").alias("legal_right"), "lo", "hi"))
    used = table(spark, sf, "rights_grant", "id", "legal_right").distinct().groupBy("legal_right").agg(F.count("*").alias("n"))
    return used.join(dim, "legal_right", "left").select(F.coalesce("legal_right", F.lit("?")).alias("code"), "n", F.coalesce("lo", F.lit(-1)).alias("lo"), F.coalesce("hi", F.lit(-1)).alias("hi"))


def axis_product(spark, sf):
    """Per contract the combinations of its rights and its modes, each once."""
    g = table(spark, sf, "rights_grant", "contract_id", "legal_right", "exploitation_mode").filter("contract_id IS NOT NULL")
    sets = g.groupBy("contract_id").agg(F.collect_set("legal_right").alias("r"), F.collect_set("exploitation_mode").alias("m"))
    each = sets.select("contract_id", F.explode_outer("r").alias("r"), "m").select("contract_id", "r", F.explode_outer("m").alias("m")).dropDuplicates()
    return each.groupBy("contract_id").agg(F.count("*").alias("combinations"), F.countDistinct("r").alias("rights"))


def weighted_confidence(spark, sf):
    """A weighted score per user and the route it leads to."""
    e = table(spark, sf, "events", "user_id", "event_type", "value")
    share = lambda c: F.avg(c.cast("double"))
    score = 0.6 * share(F.col("event_type") != "error") + 0.2 * share(F.col("value") > 1) + 0.2 * share(F.col("value") < 50)
    s = e.groupBy("user_id").agg(F.round(score, 6).alias("score"))
    return s.withColumn("route", F.when(F.col("score") < 0.70, "RED").when(F.col("score") < 0.85, "YELLOW").otherwise("GREEN"))


def valid_dates(spark, sf):
    """ISO dates named in chunks, by whether the calendar has them."""
    c = table(spark, sf, "contract_chunk", "id", "chunk_text").filter("chunk_text IS NOT NULL").distinct()
    d = c.select(F.explode(F.regexp_extract_all("chunk_text", F.lit(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), 0)).alias("d"))
    return d.groupBy(F.try_to_date("d", "yyyy-MM-dd").isNotNull().cast("int").alias("valid")).agg(F.count("*").alias("n"), F.countDistinct("d").alias("different"))


def stale_results(spark, sf):
    """Results more than 365 days older than the newest that no later contract refers to."""
    r = table(spark, sf, "extract_result", "tmpid", "created_at").groupBy("tmpid").agg(F.max("created_at").alias("at"))
    newest = r.agg(F.max("at").alias("newest"))
    old = r.crossJoin(F.broadcast(newest)).filter(F.col("at") < F.col("newest") - F.expr("INTERVAL 365 DAYS"))
    used = table(spark, sf, "contract", F.col("source_tmpid").alias("tmpid")).filter("tmpid IS NOT NULL")
    return old.join(used, "tmpid", "left_anti").select("tmpid")


def camel_rows(spark, sf):
    """Rows as JSON with camelCase keys."""
    c = table(spark, sf, "content_asset", "id", "ip_id", "scope_type")
    return c.select("id", F.to_json(F.struct(*[F.col(x).alias(text.camel(x)) for x in c.columns])).alias("json"))


def merge_patches(spark, sf):
    """Event properties patched: a key replaced, one added, one removed."""
    e = table(spark, sf, "events", "event_id", "props")
    return e.select("event_id", text.merge_patch("props", F.lit('{"k":null,"n":{"a":1,"b":null}}')).alias("patched"))


def error_rates(spark, sf):
    """Character error rate of every chunk against the nearest of the bundle's chunks of the same generation and clause number, and how many of its numbers stand there too."""
    c = table(spark, sf, "contract_chunk", "id", "contract_history_id", "clause_no", "chunk_text").filter("chunk_text IS NOT NULL AND clause_no IS NOT NULL").dropDuplicates(["id"])
    b = table(spark, sf, "bundle_chunk", "contract_history_id", "clause_no", "text").filter("text IS NOT NULL").distinct()
    both = c.join(b, ["contract_history_id", "clause_no"])
    rate = F.levenshtein("chunk_text", "text") / F.greatest(F.char_length("text"), F.lit(1))
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[0-9][0-9,.-]*[0-9]"), F.lit(0)))
    kept = F.size(F.array_intersect(numbers(F.col("text")), numbers(F.col("chunk_text"))))
    best = both.select("id", "contract_history_id", F.struct(rate.alias("rate"), F.size(numbers(F.col("text"))).alias("numbers"), kept.alias("kept")).alias("m")).groupBy("id", "contract_history_id").agg(F.min("m").alias("m"))
    return best.groupBy("contract_history_id").agg(F.count("*").alias("clauses"), F.round(F.avg("m.rate"), 6).alias("rate"), F.sum("m.numbers").alias("numbers"), F.sum("m.kept").alias("kept"))


SQL = {
    "code_spans": f"WITH {AXES_SQL}, u AS (SELECT legal_right, count(*) AS n FROM (SELECT DISTINCT id, legal_right FROM rights_grant) GROUP BY 1) SELECT coalesce(legal_right, '?') AS code, u.n, coalesce(lo, -1)::INT AS lo, coalesce(hi, -1)::INT AS hi FROM u LEFT JOIN lr ON lr.code = legal_right",
    "axis_product": "WITH g AS (SELECT contract_id, count(DISTINCT legal_right) AS r, count(DISTINCT exploitation_mode) AS m FROM rights_grant WHERE contract_id IS NOT NULL GROUP BY 1) SELECT contract_id, greatest(r, 1) * greatest(m, 1) AS combinations, r AS rights FROM g",
    "weighted_confidence": "WITH s AS (SELECT user_id, round(0.6::DOUBLE * avg((event_type <> 'error')::INT) + 0.2::DOUBLE * avg((value > 1)::INT) + 0.2::DOUBLE * avg((value < 50)::INT), 6) AS score FROM events GROUP BY 1) SELECT user_id, score, CASE WHEN score < 0.70 THEN 'RED' WHEN score < 0.85 THEN 'YELLOW' ELSE 'GREEN' END AS route FROM s",
    "valid_dates": "WITH d AS (SELECT unnest(regexp_extract_all(chunk_text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS d FROM (SELECT DISTINCT id, chunk_text FROM contract_chunk WHERE chunk_text IS NOT NULL)) SELECT (try_cast(d AS DATE) IS NOT NULL)::INT AS valid, count(*) AS n, count(DISTINCT d) AS different FROM d GROUP BY 1",
    "stale_results": "WITH r AS (SELECT tmpid, max(created_at) AS at FROM extract_result GROUP BY 1) SELECT tmpid FROM r WHERE r.at < (SELECT max(created_at) FROM extract_result) - INTERVAL 365 DAYS AND NOT EXISTS (SELECT 1 FROM contract c WHERE c.source_tmpid = r.tmpid)",
    "merge_patches": """SELECT event_id, json_merge_patch(props::JSON, '{"k":null,"n":{"a":1}}'::JSON)::VARCHAR AS patched FROM events""",
    "camel_rows": """SELECT id, '{"id":' || id || ',"ipId":' || ip_id || ',"scopeType":"' || scope_type || '"}' AS json FROM content_asset""",
}

NAMES = (*SQL, "error_rates")


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
