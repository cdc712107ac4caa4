"""Searching clauses: filters over grants, current generations only, blended scores, fields with their best chunks, and how well that works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors
from ..operators import plugins
from ..operators import relational as R
from ..sources.tables import table
from . import clauses
from .conflicts import _G, grants

#: The search of the queries below: what grants must have, words of the question, weights and limits.
RIGHTS, TERRITORIES, FROM, TO = ("PUBLIC_TRANSMISSION", "BROADCAST", "TRANSMISSION"), ("KR", "JP", "US"), "2020-01-01", "2028-12-31"
SIGNED_FROM, SIGNED_TO = "2019-01-01", "2025-12-31"
TERMS = ("records", "usd", "기록", "이용", "記録", "利用")
WEIGHT, LEAST, SNIPPETS = 0.5, 0.3, 3

#: Fields of a clause: patterns with weights, patterns that speak against it, and the id from which its question's vector is taken.
FIELDS = {
    "territory": ((("territory|territories|지역|地域", 3.0), ("South Korea|Korea|Japan|United States|대한민국|일본|미국|韓国|日本|米国", 1.0)), (("law|법률|法律", 2.0),), 0),
    "payment": ((("USD|금 [0-9]|金[0-9]", 2.0), ("pay|balance|지급|대금|支払", 2.5)), (("promotion|홍보|宣伝", 1.5),), 100),
    "period": ((("from .{0,40} until|부터 .{0,40}까지|から.{0,40}まで", 3.0), ("months|개월|か月|ヶ月", 1.5)), (("interest|이자|利息", 1.0),), 200),
    "rights": ((("SVOD|AVOD|TVOD|VOD", 2.5), ("show|display|allows|permits|허락|許諾", 2.0)), (("may not|넘길 수 없|できない", 2.0),), 300),
}
TOP = (1, 3, 5)


def usable_vectors(df: DataFrame, vector: str = "embedding", dim: int = 64) -> DataFrame:
    """The vector, or null if it cannot be compared."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0)
    return df.withColumn(vector, F.when(good, F.col(vector)))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts with an active grant that meets the filter, signed between two days."""
    span = lambda d: F.datediff(F.lit(d).cast("date"), F.lit("1970-01-01").cast("date"))
    g = R.dynamic_filter(grants(spark, sf), legal_right=list(RIGHTS), territory=list(TERRITORIES), status="active").filter((F.col("lo") <= span(TO)) & (F.col("hi") > span(FROM)))
    c = table(spark, sf, "contract", "id", "signed_date").filter(F.col("signed_date").between(F.lit(SIGNED_FROM).cast("date"), F.lit(SIGNED_TO).cast("date"))).select(F.col("id").alias("contract_id")).distinct()
    return c.join(g.select("contract_id").distinct(), "contract_id", "left_semi")


def current_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the current generation of their contract, repeated rows once."""
    current = table(spark, sf, "contract", "id", "current_history_id").filter("current_history_id IS NOT NULL").select(F.col("id").alias("contract_id"), F.col("current_history_id").alias("contract_history_id")).distinct()
    chunks = table(spark, sf, "contract_chunk", "id", "contract_id", "contract_history_id", "clause_no", "page_start", "chunk_text", "embedding", "created_at")
    return usable_vectors(chunks.join(current, ["contract_id", "contract_history_id"], "left_semi")).dropDuplicates(["id"])


def _question(spark: SparkSession, sf: str, least: int = 0) -> DataFrame:
    """One vector: that of the first usable chunk from an id on."""
    v = usable_vectors(table(spark, sf, "contract_chunk", "id", "embedding").filter(F.col("id") >= least)).filter("embedding IS NOT NULL")
    return v.agg(F.min_by("embedding", "id").alias("question"))


def chunk_search(spark, sf):
    """The best snippets of each contract that meets the filters: half words, half likeness scaled over all candidates."""
    pool = current_chunks(spark, sf).join(candidates(spark, sf), "contract_id", "left_semi").crossJoin(F.broadcast(_question(spark, sf)))
    text = F.lower(F.coalesce("chunk_text", F.lit("")))
    lex = sum((F.contains(text, F.lit(w)).cast("double") for w in TERMS), F.lit(0.0)) / len(TERMS)
    scored = pool.select("contract_id", F.col("id").alias("chunk_id"), "clause_no", F.coalesce("page_start", F.lit(-1)).alias("page_start"), lex.alias("lex"), vectors.cosine(F.col("embedding"), F.col("question")).alias("sem"))
    ranked = vectors.minmax_over_all(scored, "sem", "sem_norm").withColumn("score", F.round(vectors.hybrid(F.col("lex"), F.col("sem_norm"), WEIGHT), 5))
    top = R.top_per_group(ranked.filter(F.col("score") >= LEAST), ["contract_id"], SNIPPETS, F.desc("score"), F.col("chunk_id"))
    return top.select("contract_id", "chunk_id", "clause_no", "page_start", "score", F.col("rn").alias("place"))


def search_results(spark, sf):
    """The contracts of the search with their best score, and the mean of these over all."""
    best = chunk_search(spark, sf).groupBy("contract_id").agg(F.max("score").alias("similarity"), F.count("*").alias("snippets"))
    return best.crossJoin(F.broadcast(best.agg(F.round(F.avg("similarity"), 5).alias("confidence"))))


def search_fallback(spark, sf):
    """Without a vector: the twenty newest candidates."""
    c = table(spark, sf, "contract", "id", "created_at").groupBy(F.col("id").alias("contract_id")).agg(F.max("created_at").alias("created_at"))
    return c.join(candidates(spark, sf), "contract_id", "left_semi").orderBy(F.desc("created_at"), "contract_id").limit(20).select("contract_id")


def generation_counts(spark, sf):
    """Per contract with a current generation: chunks of it and chunks of those it replaced."""
    chunks = table(spark, sf, "contract_chunk", "id", "contract_id", "contract_history_id").distinct()
    current = table(spark, sf, "contract", "id", "current_history_id").filter("current_history_id IS NOT NULL").select(F.col("id").alias("contract_id"), "current_history_id").distinct()
    now = F.coalesce(F.col("contract_history_id") == F.col("current_history_id"), F.lit(False))
    return chunks.join(current, "contract_id").groupBy("contract_id").agg(F.count_if(now).alias("current_chunks"), F.count_if(~now).alias("older_chunks"))


def _lexical(text, field: str):
    """(score before scaling or null if nothing speaks for the field, labels of what was found)."""
    good, bad, _ = FIELDS[field]
    hits = [F.regexp_count(text, F.lit(p)) for p, _ in good]
    positive = sum((F.when(h > 1, w * (1 + F.log(h.cast("double")))).when(h == 1, F.lit(w)).otherwise(0.0) for h, (_, w) in zip(hits, good, strict=True)), F.lit(0.0))
    against = sum((F.when(text.rlike(p), w).otherwise(0.0) for p, w in bad), F.lit(0.0))
    labels = [F.when(h > 0, F.lit(f"+{i}")) for i, h in enumerate(hits)] + [F.when(text.rlike(p), F.lit(f"-{i}")) for i, (p, _) in enumerate(bad)]
    return F.when(positive > 0, vectors.logistic(positive - against)).otherwise(0.0), F.array_join(F.array_compact(F.array(*labels)), ",")


def field_scores(spark: SparkSession, sf: str, weight: float = WEIGHT) -> DataFrame:
    """contract_history_id, id, field, score: every chunk by every field; likeness is scaled within its generation."""
    chunks = usable_vectors(table(spark, sf, "contract_chunk", "id", "contract_history_id", "chunk_text", "embedding").filter("chunk_text IS NOT NULL AND contract_history_id IS NOT NULL")).dropDuplicates(["id"])
    questions = [_question(spark, sf, at).select(F.col("question").alias(f"q_{f}")) for f, (_, _, at) in FIELDS.items()]
    for q in questions:
        chunks = chunks.crossJoin(F.broadcast(q))
    parts = []
    for f in FIELDS:
        lex, labels = _lexical(F.col("chunk_text"), f)
        sem = F.coalesce(vectors.cosine(F.col("embedding"), F.col(f"q_{f}")), F.lit(0.0))
        parts.append(F.struct(F.lit(f).alias("field"), F.round(lex, 4).alias("lex"), labels.alias("reasons"), sem.alias("sem")))
    rows = chunks.select("contract_history_id", "id", F.explode(F.array(*parts)).alias("s")).select("contract_history_id", "id", "s.*")
    norm = vectors.minmax_within("sem", "contract_history_id", "field")
    return rows.withColumn("sem_norm", norm).withColumn("score", F.round((1 - weight) * F.col("lex") + weight * F.col("sem_norm"), 6))


def field_hits(spark, sf):
    """The five best chunks of each generation for each field, with what speaks for and against them."""
    rows = field_scores(spark, sf).filter("score >= 0.15")
    return R.top_per_group(rows, ["contract_history_id", "field"], 5, F.desc("score"), F.col("id")).select("contract_history_id", "field", "id", "score", "reasons", F.col("rn").alias("place"))


def retrieval_recall(spark, sf):
    """Quotes that stand as evidence of a grant's territory: by k and by weight of likeness, how many are in the k best
    chunks of their generation (hit), in another of its chunks (rank_miss), or in none (chunk_miss)."""
    g = table(spark, sf, "rights_grant", "contract_history_id", "evidence").filter("evidence IS NOT NULL AND contract_history_id IS NOT NULL")
    one = F.coalesce(F.get_json_object("evidence", "$.territory[0].quote"), F.get_json_object("evidence", "$.territory.quote"))
    quotes = g.select("contract_history_id", one.alias("quote")).filter("quote <> ''").distinct()
    chunks = table(spark, sf, "contract_chunk", "id", "contract_history_id", "chunk_text").filter("chunk_text IS NOT NULL").dropDuplicates(["id"])
    holds = quotes.join(chunks, "contract_history_id").filter(F.contains("chunk_text", F.col("quote"))).select("contract_history_id", "quote", "id")
    parts = []
    for weight in (0.0, 0.5):
        scores = field_scores(spark, sf, weight).filter("field = 'territory'")
        w = W.partitionBy("contract_history_id").orderBy(F.desc("score"), F.col("id"))
        place = scores.select("contract_history_id", "id", F.row_number().over(w).alias("place"))
        best = holds.join(place, ["contract_history_id", "id"]).groupBy("contract_history_id", "quote").agg(F.min("place").alias("best"))
        seen = quotes.join(best, ["contract_history_id", "quote"], "left").join(chunks.select("contract_history_id").distinct(), "contract_history_id", "left_semi")
        for k in TOP:
            outcome = F.when(F.col("best") <= k, "hit").when(F.col("best").isNotNull(), "rank_miss").otherwise("chunk_miss")
            parts.append(seen.select(F.lit(k).alias("k"), F.lit(weight).alias("weight"), outcome.alias("outcome")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.groupBy("k", "weight", "outcome").agg(F.count("*").alias("quotes"))


def bundle(documents: DataFrame, model, key: str = "doc_id", text: str = "text", weight: float = WEIGHT, top: int = 5, questions: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From texts to what an extractor is given: the chunks with their vectors, the best chunks of each field, and figures per text.

    model: see `plugins.embed`. questions: per field what is asked; its vector is made by the same model (default: the field's name)."""
    pieces = clauses.chunks(clauses.segments(documents, key, text), key)
    pieces = plugins.embed(pieces, "text", model, wanted=F.col("indexable"))
    asked = documents.sparkSession.createDataFrame([(f, (questions or {}).get(f, f)) for f in FIELDS], "field string, question string")
    asked = plugins.embed(asked, "question", model, "vector", plugins.QUERY).select("field", "vector")
    scores = [F.struct(F.lit(f).alias("field"), lex.alias("lex"), labels.alias("reasons")) for f in FIELDS for lex, labels in [_lexical(F.col("text"), f)]]
    rows = pieces.filter("indexable").select(key, "clause", "piece", "embedding", F.explode(F.array(*scores)).alias("s")).select(key, "clause", "piece", "embedding", "s.*").join(F.broadcast(asked), "field")
    rows = rows.withColumn("sem", F.coalesce(vectors.cosine(F.col("embedding"), F.col("vector")), F.lit(0.0)))
    rows = rows.withColumn("score", F.round((1 - weight) * F.col("lex") + weight * vectors.minmax_within("sem", key, "field"), 4))
    hits = R.top_per_group(rows.filter("score >= 0.15"), [key, "field"], top, F.desc("score"), F.col("clause"), F.col("piece")).select(key, "field", "clause", "piece", "score", "reasons", F.col("rn").alias("place"))
    info = pieces.groupBy(key).agg(F.count("*").alias("chunks"), F.count_if("indexable").alias("indexable"), F.max("page_end").alias("pages"), F.first("lang").alias("lang"))
    return pieces, hits, info


def queries() -> dict:
    return {f.__name__: f for f in (chunk_search, search_results, search_fallback, generation_counts, field_hits, retrieval_recall)}


_USABLE = "CASE WHEN len(embedding) = 64 AND len(list_filter(embedding, LAMBDA x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, LAMBDA x: x <> 0)) > 0 THEN embedding::DOUBLE[] END"
_COS = "list_sum(list_transform(list_zip(%s, %s), LAMBDA z: z[1] * z[2])) / (sqrt(list_sum(list_transform(%s, LAMBDA y: y * y))) * sqrt(list_sum(list_transform(%s, LAMBDA y: y * y))))"
_V = f", v AS (SELECT DISTINCT ON (id) id, contract_id, contract_history_id, clause_no, page_start, chunk_text, {_USABLE} AS e FROM contract_chunk)"
_CAND = f""", cand AS (SELECT DISTINCT id AS contract_id FROM contract WHERE signed_date BETWEEN DATE '{SIGNED_FROM}' AND DATE '{SIGNED_TO}' AND id IN (SELECT contract_id FROM h WHERE status = 'active'
  AND legal_right IN {RIGHTS} AND territory IN {TERRITORIES} AND lo <= datediff('day', DATE '1970-01-01', DATE '{TO}') AND hi > datediff('day', DATE '1970-01-01', DATE '{FROM}')))"""
_SEARCH = _G + _CAND + _V + f""", q AS (SELECT arg_min(e, id) AS q FROM v WHERE e IS NOT NULL),
pool AS (SELECT v.* FROM v WHERE contract_id IN (SELECT contract_id FROM cand) AND (contract_id, contract_history_id) IN (SELECT (id, current_history_id) FROM contract WHERE current_history_id IS NOT NULL)),
s AS (SELECT contract_id, id AS chunk_id, clause_no, coalesce(page_start, -1) AS page_start, ({' + '.join(f"contains(lower(coalesce(chunk_text, '')), '{w}')::INT" for w in TERMS)}) / {len(TERMS)}.0::DOUBLE AS lex, {_COS % ('e', 'q', 'e', 'q')} AS sem FROM pool, q),
n AS (SELECT *, CASE WHEN max(sem) OVER () = min(sem) OVER () THEN 1 ELSE (sem - min(sem) OVER ()) / (max(sem) OVER () - min(sem) OVER ()) END AS sem_norm FROM s),
r AS (SELECT *, round({1 - WEIGHT} * lex + {WEIGHT} * coalesce(sem_norm, 0), 5) AS score FROM n),
t AS (SELECT contract_id, chunk_id, clause_no, page_start, score, row_number() OVER (PARTITION BY contract_id ORDER BY score DESC, chunk_id)::INT AS place FROM r WHERE score >= {LEAST} QUALIFY place <= {SNIPPETS})"""


def _lexical_sql(f: str) -> str:
    good, bad, _ = FIELDS[f]
    n = lambda p: f"len(regexp_extract_all(chunk_text, '{p}'))"
    plus = " + ".join(f"CASE WHEN {n(p)} > 1 THEN {w} * (1 + ln({n(p)})) WHEN {n(p)} = 1 THEN {w} ELSE 0 END" for p, w in good)
    minus = " + ".join(f"CASE WHEN regexp_matches(chunk_text, '{p}') THEN {w} ELSE 0 END" for p, w in bad)
    labels = ", ".join([f"CASE WHEN {n(p)} > 0 THEN '+{i}' END" for i, (p, _) in enumerate(good)] + [f"CASE WHEN regexp_matches(chunk_text, '{p}') THEN '-{i}' END" for i, (p, _) in enumerate(bad)])
    return f"round(CASE WHEN {plus} > 0 THEN 1 / (1 + exp(-((({plus}) - ({minus})) - 4) / 3)) ELSE 0 END, 4) AS lex, concat_ws(',', {labels}) AS reasons"


_FIELDS_SQL = "WITH z AS (SELECT 1)" + _V + ", " + ", ".join(f"q{i} AS (SELECT arg_min(e, id) AS q FROM v WHERE e IS NOT NULL AND id >= {at})" for i, (_, _, at) in enumerate(FIELDS.values())) + ", rows AS (" + " UNION ALL ".join(
    f"SELECT contract_history_id, id, '{f}' AS field, {_lexical_sql(f)}, coalesce({_COS % ('e', 'q', 'e', 'q')}, 0) AS sem FROM v, q{i} WHERE chunk_text IS NOT NULL AND contract_history_id IS NOT NULL" for i, f in enumerate(FIELDS)
) + """), scaled AS (SELECT *, CASE WHEN max(sem) OVER w = min(sem) OVER w THEN 0 ELSE (sem - min(sem) OVER w) / (max(sem) OVER w - min(sem) OVER w) END AS sem_norm FROM rows WINDOW w AS (PARTITION BY contract_history_id, field))"""
_RECALL = _FIELDS_SQL + """, quotes AS (SELECT DISTINCT contract_history_id, coalesce(json_extract_string(evidence, '$.territory[0].quote'), json_extract_string(evidence, '$.territory.quote')) AS quote FROM rights_grant
  WHERE evidence IS NOT NULL AND contract_history_id IS NOT NULL AND coalesce(json_extract_string(evidence, '$.territory[0].quote'), json_extract_string(evidence, '$.territory.quote')) <> ''),
place AS (SELECT wt AS weight, contract_history_id, id, row_number() OVER (PARTITION BY wt, contract_history_id ORDER BY round((1 - wt) * lex + wt * sem_norm, 6) DESC, id) AS place FROM scaled, (VALUES (0.0::DOUBLE), (0.5::DOUBLE)) t(wt) WHERE field = 'territory'),
best AS (SELECT p.weight, q.contract_history_id, q.quote, min(p.place) AS best FROM quotes q JOIN v USING (contract_history_id) JOIN place p ON p.id = v.id WHERE contains(v.chunk_text, q.quote) GROUP BY ALL),
seen AS (SELECT wt AS weight, q.*, b.best FROM quotes q CROSS JOIN (VALUES (0.0::DOUBLE), (0.5::DOUBLE)) t(wt) LEFT JOIN best b ON b.weight = wt AND b.contract_history_id = q.contract_history_id AND b.quote = q.quote
  WHERE q.contract_history_id IN (SELECT contract_history_id FROM v WHERE chunk_text IS NOT NULL))
SELECT k, weight, CASE WHEN best <= k THEN 'hit' WHEN best IS NOT NULL THEN 'rank_miss' ELSE 'chunk_miss' END AS outcome, count(*) AS quotes FROM seen, (VALUES (1), (3), (5)) u(k) GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {
        "chunk_search": _SEARCH + " SELECT * FROM t",
        "search_results": _SEARCH + ", b AS (SELECT contract_id, max(score) AS similarity, count(*) AS snippets FROM t GROUP BY 1) SELECT *, (SELECT round(avg(similarity), 5) FROM b) AS confidence FROM b",
        "search_fallback": _G + _CAND + " SELECT id AS contract_id FROM contract WHERE id IN (SELECT contract_id FROM cand) GROUP BY id ORDER BY max(created_at) DESC, id LIMIT 20",
        "generation_counts": """WITH k AS (SELECT DISTINCT id, contract_id, contract_history_id FROM contract_chunk), c AS (SELECT DISTINCT id AS contract_id, current_history_id FROM contract WHERE current_history_id IS NOT NULL)
SELECT contract_id, count_if(coalesce(contract_history_id = current_history_id, false))::BIGINT AS current_chunks, count_if(NOT coalesce(contract_history_id = current_history_id, false))::BIGINT AS older_chunks FROM k JOIN c USING (contract_id) GROUP BY contract_id""",
        "field_hits": _FIELDS_SQL + f", r AS (SELECT *, round({1 - WEIGHT} * lex + {WEIGHT} * sem_norm, 6) AS score FROM scaled) SELECT contract_history_id, field, id, score, reasons, row_number() OVER (PARTITION BY contract_history_id, field ORDER BY score DESC, id)::INT AS place FROM r WHERE score >= 0.15 QUALIFY place <= 5",
        "retrieval_recall": _RECALL,
    }
