"""Search queries: similarity of names, vectors, lexical and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import relational as R
from ..sources.tables import table
from .retrieval import _COS, _USABLE, usable_vectors

QUERY_ID = 7
# Fields of a clause, with patterns and weights of our own.
FIELD_PATTERNS = (
    ("period", r"\b(?:until|before|after)\b", 1.0), ("period", r"기간|까지|期間|まで", 1.5), ("territory", r"Korea|Japan|Germany|France|대한민국|일본|日本|ドイツ", 1.0),
    ("payment", r"USD|금 |金", 1.2), ("payment", r"invoice|voucher|영수증|計算書", 0.8), ("rights", r"SVOD|AVOD|TVOD|VOD|OST", 2.0),
)


def trigram_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Trigram similarity of every part's type to a phrase."""
    p = table(spark, sf, "part", "p_partkey", "p_type")
    return p.select("p_partkey", F.round(text.similarity(F.col("p_type"), F.lit("STANDARD PLATED STEEL")), 6).alias("score"))


_TRG = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w)::INT + 2), lambda i: substr('  ' || w || ' ', i::INT, 3)))))"


def entity_search(spark, sf):
    """Contracts by title like a query, keys and containment first, then trigrams; best 20."""
    c = table(spark, sf, "contract", "id", "title").filter("title IS NOT NULL").groupBy("id").agg(F.max("title").alias("title"))
    scored = c.withColumn("score", F.round(text.ladder(F.col("title"), F.lit("the silver parade licence")), 6)).filter("score >= 0.15")
    return scored.orderBy(F.desc("score"), "id").limit(20).select("id", "title", "score")


def word_similarities(spark, sf):
    """Word similarity of titles to a longer, noisy query (extents of letters, extents of words)."""
    c = table(spark, sf, "contract", "id", "title").filter("title IS NOT NULL").groupBy("id").agg(F.max("title").alias("title"))
    q = F.lit("scan of Silver Parade contract, page 2")
    return c.select("id", F.round(text.word_similarity("title", q), 6).alias("word"), F.round(text.strict_word_similarity("title", q), 6).alias("strict"))


def norm_keys(spark, sf):
    """Contracts that share the normalised key of their title."""
    c = table(spark, sf, "contract", "id", "title").filter("title IS NOT NULL").distinct()
    return c.groupBy(text.norm_key("title").alias("key")).agg(F.countDistinct("id").alias("n")).filter("n > 1")


def plain_keys(spark, sf):
    c = table(spark, sf, "part", "p_name")
    return c.groupBy(text.plain_key(F.col("p_name")).alias("key")).agg(F.count("*").alias("n"))


def vector_knn(spark, sf):
    """The 10 vectors nearest to one, by exact cosine."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    q = e.filter(F.col("vec_id") == QUERY_ID).select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(10)


_E = "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[])) AS c FROM embeddings, q)"


def _scored(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "label", "embedding")
    q = e.filter(F.col("vec_id") == QUERY_ID).select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", "label", vectors.cosine(F.col("embedding"), F.col("q")).alias("c"))


def minmax_global(spark, sf):
    return vectors.minmax_over_all(_scored(spark, sf), "c", "s").select("vec_id", F.round("s", 5).alias("scaled"))


def minmax_per_group(spark, sf):
    return _scored(spark, sf).select("vec_id", F.round(vectors.minmax_within("c", "label"), 5).alias("scaled"))


def lexical_fields(spark, sf):
    """Per clause and field: weighted, damped pattern hits through a logistic; only clauses with a hit."""
    d = table(spark, sf, "bundle_chunk", "chunk_id", "text").filter("text IS NOT NULL").distinct()
    hits = [F.struct(F.lit(f).alias("field"), F.regexp_count("text", F.lit(p)).alias("hits"), F.lit(w).alias("weight")) for f, p, w in FIELD_PATTERNS]
    rows = d.select("chunk_id", F.inline(F.array(*hits))).filter("hits > 0")
    raw = rows.groupBy("chunk_id", "field").agg(F.sum(F.col("weight") * (1 + F.ln(F.col("hits").cast("double")))).alias("raw"))
    return raw.select("chunk_id", "field", F.round(vectors.logistic(F.col("raw")), 6).alias("score"))


def hybrid_rank(spark, sf):
    """The best clause of each contract generation by lexical and vector score, then the best generations.

    Scores are found before repeated rows are brought together, so neither texts nor vectors travel."""
    c = table(spark, sf, "contract_chunk", "id", "contract_history_id", "chunk_text", "embedding").filter("chunk_text IS NOT NULL")
    c = usable_vectors(c).filter("embedding IS NOT NULL")
    q = c.agg(F.min_by("embedding", "id").alias("q"))
    lex = F.regexp_count("chunk_text", F.lit("USD|금 |金")).cast("double")
    s = c.crossJoin(F.broadcast(q)).select("id", "contract_history_id", (lex / (lex + 1)).alias("lex"), vectors.cosine(F.col("embedding"), F.col("q")).alias("sem"))
    s = s.groupBy("id", "contract_history_id").agg(F.max("lex").alias("lex"), F.max("sem").alias("sem"))
    s = vectors.minmax_over_all(s, "sem", "sem_n").withColumn("score", F.round(vectors.hybrid(F.col("lex"), F.col("sem_n")), 5))
    best = s.filter("score >= 0.15").groupBy("contract_history_id").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("m"))
    return best.select("contract_history_id", (-F.col("m.minus")).alias("id"), "m.score").orderBy(F.desc("score"), "id").limit(25)


#: What a question's words say: labels of countries and words of modes and exclusivity.
COUNTRIES = (("KR", "South Korea"), ("KR", "대한민국"), ("KR", "韓国"), ("JP", "Japan"), ("JP", "일본"), ("JP", "日本"), ("US", "United States"), ("US", "미국"), ("US", "米国"), ("DE", "Germany"), ("DE", "독일"), ("FR", "France"), ("FR", "프랑스"), ("VN", "Vietnam"), ("VN", "베트남"))
MODES_OF = ("SVOD", "AVOD", "TVOD")


def filter_interpretation(spark, sf):
    """Every clause read as a question: the countries and modes it names, the words of exclusivity, and the years from first to last."""
    c = table(spark, sf, "contract_chunk", "id", "chunk_text").filter("chunk_text IS NOT NULL").select("id", F.lower("chunk_text").alias("q"))
    named = F.array_compact(F.array(*[F.when(F.contains(F.col("q"), F.lit(label.lower())), F.lit(code)) for code, label in COUNTRIES]))
    modes = F.array_compact(F.array(*[F.when(F.contains(F.col("q"), F.lit(m.lower())), F.lit(m)) for m in MODES_OF]))
    sole = F.when(F.col("q").rlike("exclusive|독점|独占"), "exclusive").otherwise("")
    years = F.transform(F.regexp_extract_all("q", F.lit(r"(20[0-9]{2})"), 1), lambda y: y.cast("int"))
    rows = c.select("id", F.array_join(F.sort_array(F.array_distinct(named)), ",").alias("countries"), F.array_join(modes, ",").alias("modes"), sole.alias("exclusivity"), F.coalesce(F.array_min(years), F.lit(0)).alias("since"), F.coalesce(F.array_max(years), F.lit(0)).alias("until"))
    return rows.distinct().groupBy("countries", "modes", "exclusivity", "since", "until").agg(F.count("*").alias("clauses"))


SQL = {
    "trigram_similarity": f"WITH t AS (SELECT p_partkey, {_TRG.format('p_type')} AS a, {_TRG.format(chr(39) + 'STANDARD PLATED STEEL' + chr(39))} AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score FROM t",
    "plain_keys": "SELECT lower(regexp_replace(p_name, '[\\s[:punct:]_]+', '', 'g')) AS key, count(*) AS n FROM part GROUP BY 1",
    "vector_knn": _E + " SELECT vec_id, round(c, 5) AS cosine FROM s ORDER BY cosine DESC, vec_id LIMIT 10",
    "minmax_global": _E + " SELECT vec_id, round((c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), 5) AS scaled FROM s",
    "minmax_per_group": _E + " SELECT vec_id, round(CASE WHEN max(c) OVER w = min(c) OVER w THEN 0 ELSE (c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w) END, 5) AS scaled FROM s WINDOW w AS (PARTITION BY label)",
    "lexical_fields": "WITH d AS (SELECT DISTINCT chunk_id, text FROM bundle_chunk WHERE text IS NOT NULL), p(field, pattern, weight) AS (VALUES "
    + ", ".join("('%s', '%s', %s)" % (f, p, w) for f, p, w in FIELD_PATTERNS)
    + "), h AS (SELECT chunk_id, field, weight, len(regexp_extract_all(text, pattern)) AS hits FROM d, p), r AS (SELECT chunk_id, field, sum(weight::DOUBLE * (1 + ln(hits))) AS raw FROM h WHERE hits > 0 GROUP BY ALL) SELECT chunk_id, field, round(1 / (1 + exp(-(raw - 4) / 3)), 6) AS score FROM r",
    "filter_interpretation": "WITH c AS (SELECT DISTINCT id, lower(chunk_text) AS q FROM contract_chunk WHERE chunk_text IS NOT NULL), l AS (SELECT *, list_transform(regexp_extract_all(q, '20[0-9][0-9]'), LAMBDA y: y::INT) AS years FROM c), r AS (SELECT DISTINCT id, array_to_string(list_sort(list_distinct(list_filter(["
    + ", ".join(f"CASE WHEN contains(q, '{label.lower()}') THEN '{code}' END" for code, label in COUNTRIES) + "], LAMBDA x: x IS NOT NULL))), ',') AS countries, concat_ws(',', " + ", ".join(f"CASE WHEN contains(q, '{m.lower()}') THEN '{m}' END" for m in MODES_OF)
    + ") AS modes, CASE WHEN regexp_matches(q, 'exclusive|독점|独占') THEN 'exclusive' ELSE '' END AS exclusivity, coalesce(list_min(years), 0) AS since, coalesce(list_max(years), 0) AS until FROM l) SELECT countries, modes, exclusivity, since, until, count(*) AS clauses FROM r GROUP BY ALL",
    "hybrid_rank": f"WITH v AS (SELECT id, contract_history_id, chunk_text, {_USABLE} AS e FROM contract_chunk WHERE chunk_text IS NOT NULL), u AS (SELECT * FROM v WHERE e IS NOT NULL), q AS (SELECT arg_min(e, id) AS q FROM u), s AS (SELECT id, contract_history_id, max(len(regexp_extract_all(chunk_text, 'USD|금 |金'))) AS n, max({_COS % ('e', 'q', 'e', 'q')}) AS sem FROM u, q GROUP BY ALL), m AS (SELECT *, (sem - min(sem) OVER ()) / (max(sem) OVER () - min(sem) OVER ()) AS sem_n FROM s), r AS (SELECT contract_history_id, id, round(0.5::DOUBLE * (n / (n + 1)) + 0.5::DOUBLE * sem_n, 5) AS score FROM m), b AS (SELECT * FROM r WHERE score >= 0.15 QUALIFY row_number() OVER (PARTITION BY contract_history_id ORDER BY score DESC, id) = 1) SELECT * FROM b ORDER BY score DESC, id LIMIT 25",
}

NAMES = (*SQL, "entity_search", "word_similarities", "norm_keys")


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
