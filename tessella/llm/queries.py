"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe, lookalike, mixture, neighbours, pieces, scans, spans


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.pieces(table(spark, sf, "bundle_chunk", "chunk_id", "clause_no", "text"), "chunk_id", "text", ("clause_no",))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that come out in more than one piece."""
    return p1_pieces(spark, sf).filter("pieces > 1").select("chunk_id").distinct()


def p1_over_limit(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.over_limit(table(spark, sf, "bundle_chunk", "contract_history_id", "chunk_id", "text"), table(spark, sf, "chunk_stats"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.alike_pairs(
        table(spark, sf, "contract_chunk", "id", "contract_history_id", "chunk_text"), "id", "chunk_text",
        table(spark, sf, "bundle_chunk", "chunk_id", "contract_history_id", "text"), "chunk_id", "text", "contract_history_id",
    )


def p5_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The form of every text of both tables: table_name, chunk_id (as text), form."""
    own = table(spark, sf, "contract_chunk", "id", "chunk_text").select(F.lit("contract_chunk").alias("table_name"), F.col("id").cast("string").alias("chunk_id"), F.col("chunk_text").alias("text"))
    bundle = table(spark, sf, "bundle_chunk", "chunk_id", "text").select(F.lit("bundle_chunk").alias("table_name"), "chunk_id", "text")
    texts = own.unionByName(bundle).filter("chunk_id is not null and text is not null")
    return lookalike.same_form(texts, "chunk_id", "text", ("table_name",)).select("table_name", "chunk_id", "form").distinct()


def _scans(spark: SparkSession, sf: str) -> scans.Scans:
    return scans.Scans(table(spark, sf, "contract_chunk", "id", "contract_history_id", "chunk_text", "page_start", "page_end"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scans(spark, sf).found()


def p6_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _scans(spark, sf).paragraphs()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.pairs(neighbours.nearest(table(spark, sf, "contract_chunk", "id", "embedding"), least=0.9))


def p7_all(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar chunks of every chunk with a usable vector."""
    return neighbours.nearest(table(spark, sf, "contract_chunk", "id", "embedding")).select("id", "other", F.round("cosine", 6).alias("cosine"))


def p7_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar chunks of every chunk whose id is divisible by 50, against all rows."""
    found = neighbours.search(table(spark, sf, "contract_chunk", "id", "embedding"), F.col("id") % 50 == 0)
    return found.select("id", "other", F.round("cosine", 6).alias("cosine"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents", "doc_id", "text"))


def _mixture(spark: SparkSession, sf: str) -> mixture.Mixture:
    return mixture.Mixture(table(spark, sf, "documents", "doc_id", "source", "text"), table(spark, sf, "mix_target"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).mix()


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).shares()


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.SharedSpans(table(spark, sf, "documents", "doc_id", "text")).pairs()


def p10_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return spans.SharedSpans(table(spark, sf, "documents", "doc_id", "text")).coverage(every=True)


def p10_passages(spark: SparkSession, sf: str) -> DataFrame:
    return spans.SharedSpans(table(spark, sf, "documents", "doc_id", "text"), aligned=True).passages()


def queries() -> dict:
    return {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_over_limit": p1_over_limit, "p5_found": p5_found, "p5_forms": p5_forms, "p6_found": p6_found, "p6_paragraphs": p6_paragraphs, "p7_found": p7_found, "p7_all": p7_all, "p7_neighbours": p7_neighbours, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_coverage": p10_coverage, "p10_passages": p10_passages}


_COST = r"(13 * length(regexp_replace(text, '[^\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]', '', 'g')) + 7 * length(text))"

P1_SQL = f"SELECT DISTINCT chunk_id FROM bundle_chunk WHERE {_COST} > 9600"

P1_OVER_SQL = f"""
WITH c AS (SELECT DISTINCT contract_history_id, chunk_id, text FROM bundle_chunk WHERE contract_history_id IS NOT NULL),
n AS (SELECT contract_history_id, sum((coalesce({_COST}, 0) > 9600)::INT)::INT AS counted FROM c GROUP BY 1),
s AS (SELECT contract_history_id, max(over_limit) AS reported FROM chunk_stats GROUP BY 1)
SELECT n.contract_history_id, counted, coalesce(reported, -1)::INT AS reported FROM n LEFT JOIN s USING (contract_history_id)
"""


_WINDOWS = """WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) >= 200),
p AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d), w AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM p)"""

P10_SQL = _WINDOWS + """, u AS (SELECT DISTINCT doc_id, h FROM w), s AS (SELECT h, list_sort(list(doc_id)) AS docs FROM u GROUP BY h HAVING count(*) > 1), g AS (SELECT DISTINCT docs FROM s), a AS (SELECT docs, unnest(docs) AS a FROM g), b AS (SELECT a, unnest(docs) AS b FROM a)
SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM b WHERE a < b"""

P10_COVERAGE_SQL = _WINDOWS + """, s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), c AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM w WHERE h IN (SELECT h FROM s)),
n AS (SELECT doc_id, sum(least(200, coalesce(next - i, 200)))::BIGINT AS shared_chars FROM c GROUP BY doc_id), t AS (SELECT DISTINCT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars FROM documents)
SELECT doc_id, n_chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(round(shared_chars / nullif(n_chars, 0), 6), 0) AS shared_share FROM t LEFT JOIN n USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"p10_found": P10_SQL, "p10_coverage": P10_COVERAGE_SQL, "p1_found": P1_SQL, "p1_over_limit": P1_OVER_SQL}
