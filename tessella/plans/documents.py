"""Document queries: lines, clauses, chunks, language, quotes, counts, routing, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from ..functions.vectors import block_search
from ..operators import relational as R
from ..sources.tables import table

#: Heads of clauses in the three languages of the corpus.
HEADS = {"ko": r"^제 ?\d+조", "ja": r"^第 ?\d+条", "en": r"^Article \d+"}
ANY_HEAD = "|".join(HEADS.values())


def lined(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and the array of lines of every document; all that follows is done within the row."""
    d = table(spark, sf, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return d.select("doc_id", F.split("text", "\n").alias("l"))


def _count(pattern: str):
    return F.size(F.filter("l", lambda x: x.rlike(pattern)))


def _heads():
    return F.filter(F.transform("l", lambda x, i: F.when(x.rlike(ANY_HEAD), i)), lambda i: i.isNotNull())


def _chars(start, n, end: int):
    return F.aggregate(F.slice("l", start + 1, n), F.lit(0).cast("long"), lambda s, x: s + F.char_length(x) + end)


def line_counts(spark, sf):
    return lined(spark, sf).select("doc_id", F.size("l").cast("long").alias("n"), F.size(F.filter("l", lambda x: F.trim(x) == "")).cast("long").alias("blank"))


def noise_lines(spark, sf):
    """Lines that are no text: blank or a page number 'n / m' or '- n -'."""
    return lined(spark, sf).select("doc_id", _count(r"^ *$|^ *\d+ */ *\d+ *$|^ *- *\d+ *- *$").cast("long").alias("noise")).filter("noise > 0")


def running_offset(spark, sf):
    """Offset of each head line in its document."""
    heads = lined(spark, sf).withColumn("h", _heads())
    return heads.select("doc_id", "l", F.explode("h").alias("line_no")).select("doc_id", "line_no", _chars(F.lit(0), F.col("line_no"), 1).alias("pos"))


def clause_islands(spark, sf):
    """Clauses: a head line and what follows up to the next."""
    d = lined(spark, sf).withColumn("h", _heads()).withColumn("first", F.when(F.try_element_at("h", F.lit(1)) == 0, 1).otherwise(0))
    starts = F.when(F.col("first") == 1, F.col("h")).otherwise(F.concat(F.array(F.lit(0)), F.col("h")))
    d = d.withColumn("s", starts).select("doc_id", "l", "s", "first", F.posexplode("s").alias("k", "first_line"))
    n = F.coalesce(F.try_element_at("s", F.col("k") + 2), F.size("l")) - F.col("first_line")
    return d.select("doc_id", (F.col("k") + F.col("first")).cast("long").alias("clause"), "first_line", n.cast("long").alias("lines"), _chars(F.col("first_line"), n, 0).alias("chars"))


def head_language(spark, sf):
    """Language with the most head lines (ties: ko, ja, en); unknown without heads."""
    c = lined(spark, sf).select("doc_id", *[_count(p).alias(k) for k, p in HEADS.items()])
    most = F.greatest(*HEADS)
    return c.select("doc_id", F.when(most == 0, "unknown").when(F.col("ko") == most, "ko").when(F.col("ja") == most, "ja").otherwise("en").alias("lang"))


def script_language(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return d.groupBy(text.script_language(F.col("text")).alias("lang")).agg(F.count("*").alias("n"))


def chunk_tokens(spark, sf):
    """Token estimates of bundle chunks and whether a chunk is long enough to be indexed."""
    b = table(spark, sf, "bundle_chunk", "chunk_id", "text").filter("text IS NOT NULL").distinct()
    return b.select("chunk_id", text.token_estimate(F.col("text")).alias("units"), (F.char_length(F.trim("text")) >= 60).cast("int").alias("indexable"))


def chunk_summary(spark, sf):
    """One row of counts per generation."""
    b = table(spark, sf, "bundle_chunk", "chunk_id", "contract_history_id", "page_start", "page_end", "indexable", "text").filter("contract_history_id IS NOT NULL").distinct()
    return b.groupBy("contract_history_id").agg(F.count("*").alias("total"), F.count_if(F.col("indexable")).alias("indexable"), F.count_if(F.col("page_start") < F.col("page_end")).alias("spanning"))


def sliding_windows(spark, sf):
    """Windows of 1,000 characters every 800."""
    d = table(spark, sf, "documents", "doc_id", "text").filter("text IS NOT NULL AND text <> ''")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(800)))
    return d.select("doc_id", at.alias("pos"), "text").select("doc_id", "pos", F.char_length(F.expr("substring(text, pos + 1, 1000)")).alias("n"))


def quote_containment(spark, sf):
    """Chunks whose text stands, blanks aside, in a bundle chunk of the same generation: recall of the bundle."""
    c = table(spark, sf, "contract_chunk", "id", "contract_history_id", "chunk_text").filter("chunk_text IS NOT NULL AND contract_history_id IS NOT NULL").distinct()
    b = table(spark, sf, "bundle_chunk", "contract_history_id", "text").filter("text IS NOT NULL").distinct()
    quote = c.select("id", "contract_history_id", text.squash(F.col("chunk_text")).alias("q")).filter("q <> ''")
    hit = quote.join(b.select("contract_history_id", text.squash(F.col("text")).alias("t")), "contract_history_id").filter(F.contains("t", "q"))
    return quote.join(hit.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left").groupBy("contract_history_id").agg(F.count("*").alias("quotes"), F.count("hit").alias("found"))


def quote_location(spark, sf):
    """First chunk (by index) of a generation that holds 'USD', and where."""
    b = table(spark, sf, "bundle_chunk", "contract_history_id", "chunk_index", "chunk_id", "text").filter("text IS NOT NULL AND contract_history_id IS NOT NULL").distinct()
    hit = b.withColumn("pos", F.locate("USD", F.col("text")) - 1).filter("pos >= 0")
    return hit.groupBy("contract_history_id").agg(F.min(F.struct("chunk_index", "chunk_id", "pos")).alias("m")).select("contract_history_id", "m.chunk_id", "m.pos")


def duplicate_hash(spark, sf):
    """Uploads by how many share their content: stored files and texts."""
    h = table(spark, sf, "contract_history", "id", "file_hash").distinct().select(F.lit("file").alias("kind"), F.col("file_hash").alias("hash"))
    d = table(spark, sf, "documents", "text").filter("text IS NOT NULL").select(F.lit("text").alias("kind"), F.sha2("text", 256).alias("hash"))
    return h.unionAll(d).groupBy("kind", "hash").agg(F.count("*").alias("copies")).groupBy("kind", "copies").agg(F.count("*").alias("contents"))


def text_hash(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return d.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")


def histogram_kind(spark, sf):
    b = table(spark, sf, "bundle_chunk", "chunk_id", "clause_kind").distinct()
    return b.groupBy(F.upper(F.regexp_replace(F.trim(F.coalesce("clause_kind", F.lit("?"))), "[- ]", "_")).alias("kind")).agg(F.count("*").alias("n"))


def group_means(spark, sf):
    d = table(spark, sf, "documents", "lang", "n_chars")
    return d.groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.max("n_chars").alias("longest"))


def slowest_three(spark, sf):
    return table(spark, sf, "documents", "doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(3)


def recall_at_k(spark, sf):
    """Share of label-mates among the first neighbours, at 1, 3, 5, 10, over all vectors whose id is divisible by 50, against all rows."""
    e = table(spark, sf, "embeddings", "vec_id", "label", "embedding")
    near = block_search(e.select(F.col("vec_id").alias("id"), "embedding"), F.col("id") % 50 == 0, 10)
    label = e.select("vec_id", "label")
    both = near.join(label.select(F.col("vec_id").alias("id"), F.col("label").alias("want")), "id").join(label.select(F.col("vec_id").alias("other"), "label"), "other")
    hit = F.when(F.col("label") == F.col("want"), 1).otherwise(0)
    return both.agg(F.countDistinct("id").alias("queries"), *[F.sum(F.when(F.col("place") <= k, hit).otherwise(0)).alias(f"at_{k}") for k in (1, 3, 5, 10)])


def date_words(spark, sf):
    """First date of each chunk."""
    c = table(spark, sf, "contract_chunk", "id", "chunk_text").filter("chunk_text IS NOT NULL")
    days = c.select("id", text.iso_date(F.col("chunk_text")).cast("string").alias("day"))
    return days.groupBy("id").agg(F.min("day").alias("day")).filter("day IS NOT NULL")


def json_from_reply(spark, sf):
    """Replies that hold a JSON object, by what surrounds it."""
    e = table(spark, sf, "extract_result", "tmpid", "payload").distinct()
    return e.select("tmpid", F.length(text.json_part(F.col("payload"))).alias("n")).filter("n > 0").groupBy("tmpid").agg(F.max("n").alias("longest"))


def safe_names(spark, sf):
    h = table(spark, sf, "contract_history", "id", "file_path").distinct()
    return h.select("id", text.safe_filename(F.col("file_path")).alias("name"))


def route(chars, density, image, bad):
    """Where a page's text should come from: OCR where there is little or the page is mostly image, VERIFY where it is in doubt."""
    return F.when((density < 0.10) | (chars < 30), "OCR").when((image > 0.6) & (density < 0.5), "OCR").when((bad > 0) | (image > 0.6), "VERIFY").otherwise("TEXT_LAYER")


#: Characters of a full page; stands in for the size of a page, which the tables do not have.
FULL_PAGE = 1200


def page_routing(spark, sf):
    """Pages by density of characters, share of blanks (in place of image coverage) and characters that tell of a bad text layer."""
    b = table(spark, sf, "bundle_chunk", "contract_history_id", "page_start", "text").filter("page_start IS NOT NULL AND text IS NOT NULL").distinct()
    n = F.sum(F.char_length("text"))
    p = b.groupBy("contract_history_id", "page_start").agg(n.alias("chars"), F.sum(F.regexp_count("text", F.lit("[\ufffd\u200b\uf900-\ufaff]"))).alias("bad"), F.sum(F.regexp_count("text", F.lit("[ \\n]"))).alias("blanks"))
    density, image = F.col("chars") / FULL_PAGE, F.coalesce(F.col("blanks") / F.nullif("chars", F.lit(0)), F.lit(0.0))
    return p.select("contract_history_id", "page_start", "chars", "bad", route(F.col("chars"), density, image, F.col("bad")).alias("route"))


def text_choice(spark, sf):
    """Of the two readings of a clause, scan and bundle, the longer one where the route says to verify: which it is and its length."""
    c = table(spark, sf, "contract_chunk", "contract_history_id", "clause_no", "chunk_text").filter("chunk_text IS NOT NULL AND clause_no IS NOT NULL").select("contract_history_id", "clause_no", F.lit("scan").alias("source"), F.char_length("chunk_text").alias("n"))
    b = table(spark, sf, "bundle_chunk", "contract_history_id", "clause_no", "text").filter("text IS NOT NULL AND clause_no IS NOT NULL").select("contract_history_id", "clause_no", F.lit("bundle").alias("source"), F.char_length("text").alias("n"))
    best = c.unionAll(b).groupBy("contract_history_id", "clause_no").agg(F.max(F.struct("n", "source")).alias("m"), F.countDistinct("source").alias("sources"))
    return best.filter("sources = 2 AND contract_history_id IS NOT NULL").select("contract_history_id", "clause_no", "m.source", "m.n")


def greedy_chunks(spark, sf):
    """Lines of a document gathered greedily up to 9,600 cost units, by a fold over its lines: how many chunks, and the largest."""
    d = lined(spark, sf).select("doc_id", F.transform("l", lambda x: text.token_estimate(x)).alias("l"))
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("chunk"), F.lit(0).alias("most"))
    fold = F.aggregate(
        "l", zero,
        lambda s, x: F.when((s["sum"] > 0) & (s["sum"] + x > 9600), F.struct(x.cast("bigint").alias("sum"), (s["chunk"] + 1).alias("chunk"), F.greatest(s["most"], s["sum"].cast("int"), x.cast("int")).alias("most")))
        .otherwise(F.struct((s["sum"] + x).alias("sum"), s["chunk"].alias("chunk"), F.greatest(s["most"], (s["sum"] + x).cast("int")).alias("most"))),
    )
    return d.select("doc_id", fold.alias("f")).select("doc_id", (F.col("f.chunk") + 1).alias("chunks"), F.col("f.most").alias("largest"))


_LINES = "l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))"
_UNITS = r"(13 * length(regexp_replace({0}, '[^\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}\x{{F900}}-\x{{FAFF}}]', '', 'g')) + 7 * length({0}))"

SQL = {
    "line_counts": f"WITH {_LINES} SELECT doc_id, count(*) AS n, count(*) FILTER (trim(line) = '') AS blank FROM l GROUP BY 1",
    "noise_lines": f"WITH {_LINES} SELECT doc_id, count(*) AS noise FROM l WHERE regexp_matches(line, '^ *$|^ *\\d+ */ *\\d+ *$|^ *- *\\d+ *- *$') GROUP BY 1",
    "running_offset": f"WITH {_LINES}, o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM l) SELECT doc_id, line_no::INT AS line_no, pos FROM o WHERE regexp_matches(line, '{ANY_HEAD}')",
    "clause_islands": f"WITH {_LINES}, o AS (SELECT *, sum(regexp_matches(line, '{ANY_HEAD}')::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS clause FROM l) SELECT doc_id, clause, min(line_no)::INT AS first_line, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM o GROUP BY ALL",
    "head_language": f"WITH {_LINES}, c AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '{HEADS['ko']}')) AS ko, count(*) FILTER (regexp_matches(line, '{HEADS['ja']}')) AS ja, count(*) FILTER (regexp_matches(line, '{HEADS['en']}')) AS en FROM l GROUP BY 1) SELECT doc_id, CASE WHEN greatest(ko, ja, en) = 0 THEN 'unknown' WHEN ko = greatest(ko, ja, en) THEN 'ko' WHEN ja = greatest(ko, ja, en) THEN 'ja' ELSE 'en' END AS lang FROM c",
    "script_language": "SELECT CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' WHEN regexp_matches(text, '[ぁ-ヿ一-鿿]') THEN 'ja' ELSE 'en' END AS lang, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "chunk_tokens": f"SELECT DISTINCT chunk_id, {_UNITS.format('text')} AS units, (length(trim(text, ' ')) >= 60)::INT AS indexable FROM bundle_chunk WHERE text IS NOT NULL",
    "chunk_summary": "SELECT contract_history_id, count(*) AS total, count(*) FILTER (indexable) AS indexable, count(*) FILTER (page_start < page_end) AS spanning FROM (SELECT DISTINCT chunk_id, contract_history_id, page_start, page_end, indexable, text FROM bundle_chunk WHERE contract_history_id IS NOT NULL) GROUP BY 1",
    "sliding_windows": "SELECT doc_id, pos::INT AS pos, length(substr(text, (pos + 1)::INT, 1000))::INT AS n FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS pos FROM documents WHERE text IS NOT NULL AND text <> '')",
    "quote_location": "WITH h AS (SELECT DISTINCT contract_history_id, chunk_index, chunk_id, strpos(text, 'USD') - 1 AS pos FROM bundle_chunk WHERE text IS NOT NULL AND contract_history_id IS NOT NULL AND contains(text, 'USD')), r AS (SELECT *, row_number() OVER (PARTITION BY contract_history_id ORDER BY chunk_index NULLS FIRST, chunk_id) AS rn FROM h) SELECT contract_history_id, chunk_id, pos::INT AS pos FROM r WHERE rn = 1",
    "duplicate_hash": "WITH x AS (SELECT 'file' AS kind, file_hash AS hash FROM (SELECT DISTINCT id, file_hash FROM contract_history) UNION ALL SELECT 'text', sha256(text) FROM documents WHERE text IS NOT NULL), c AS (SELECT kind, hash, count(*) AS copies FROM x GROUP BY ALL) SELECT kind, copies, count(*) AS contents FROM c GROUP BY ALL",
    "text_hash": "SELECT sha256(text) AS hash, min(doc_id) AS first, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "histogram_kind": "SELECT upper(regexp_replace(trim(coalesce(clause_kind, '?')), '[- ]', '_', 'g')) AS kind, count(*) AS n FROM (SELECT DISTINCT chunk_id, clause_kind FROM bundle_chunk) GROUP BY 1",
    "group_means": "SELECT coalesce(lang, '?') AS lang, count(*) AS n, round(avg(n_chars), 4) AS mean, max(n_chars) AS longest FROM documents GROUP BY 1",
    "slowest_three": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3",
    "safe_names": "SELECT DISTINCT id, coalesce(nullif(list_last(string_split(replace(file_path, '\\', '/'), '/')), ''), 'upload.pdf') AS name FROM contract_history",
    "page_routing": f"""WITH p AS (SELECT contract_history_id, page_start, sum(length(text))::BIGINT AS chars, sum(len(regexp_extract_all(text, '[\\x{{FFFD}}\\x{{200B}}\\x{{F900}}-\\x{{FAFF}}]')))::BIGINT AS bad, sum(len(regexp_extract_all(text, '[ \\n]'))) AS blanks
      FROM (SELECT DISTINCT contract_history_id, page_start, text FROM bundle_chunk WHERE page_start IS NOT NULL AND text IS NOT NULL) GROUP BY ALL), q AS (SELECT *, chars / {FULL_PAGE} AS density, coalesce(blanks / nullif(chars, 0), 0) AS image FROM p)
      SELECT contract_history_id, page_start, chars, bad, CASE WHEN density < 0.10 OR chars < 30 THEN 'OCR' WHEN image > 0.6 AND density < 0.5 THEN 'OCR' WHEN bad > 0 OR image > 0.6 THEN 'VERIFY' ELSE 'TEXT_LAYER' END AS route FROM q""",
    "text_choice": """WITH u AS (SELECT contract_history_id, clause_no, 'scan' AS source, length(chunk_text) AS n FROM contract_chunk WHERE chunk_text IS NOT NULL UNION ALL SELECT contract_history_id, clause_no, 'bundle', length(text) FROM bundle_chunk WHERE text IS NOT NULL)
      SELECT contract_history_id, clause_no, max({'n': n, 'source': source}).source AS source, max(n)::INT AS n FROM u WHERE clause_no IS NOT NULL AND contract_history_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT source) = 2""",
    "recall_at_k": """WITH q AS (SELECT vec_id, label AS want, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id, (label = want)::INT AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.embedding::DOUBLE[], q) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) DESC, e.vec_id) AS rn FROM embeddings e, q WHERE e.vec_id <> q.vec_id)
      SELECT count(DISTINCT vec_id) AS queries, sum(CASE WHEN rn <= 1 THEN hit ELSE 0 END)::BIGINT AS at_1, sum(CASE WHEN rn <= 3 THEN hit ELSE 0 END)::BIGINT AS at_3, sum(CASE WHEN rn <= 5 THEN hit ELSE 0 END)::BIGINT AS at_5, sum(CASE WHEN rn <= 10 THEN hit ELSE 0 END)::BIGINT AS at_10 FROM s""",
    "date_words": r"""WITH c AS (SELECT DISTINCT id, regexp_extract(chunk_text, '(\d{4})(?:-|년 ?|年)(\d{1,2})(?:-|월 ?|月)(\d{1,2})', ['y', 'm', 'd']) AS a, regexp_extract(chunk_text, '(January|February|March|April|May|June|July|August|September|October|November|December) (\d{1,2}), (\d{4})') AS b FROM contract_chunk WHERE chunk_text IS NOT NULL),
      d AS (SELECT id, coalesce(try_cast(a.y || '-' || a.m || '-' || a.d AS DATE), try_strptime(b, '%B %d, %Y')::DATE) AS day FROM c) SELECT id, min(day)::VARCHAR AS day FROM d WHERE day IS NOT NULL GROUP BY id""",
    "json_from_reply": r"""WITH r AS (SELECT tmpid, length(regexp_extract(regexp_replace(regexp_replace(payload, '(?s)<think>.*?</think>', '', 'g'), '```(?:json)?', '', 'g'), '(?s)\{.*\}')) AS n FROM extract_result) SELECT tmpid, max(n)::INT AS longest FROM r WHERE n > 0 GROUP BY tmpid""",
    "greedy_chunks": f"""WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), LAMBDA x: {_UNITS.format('x')}) AS l FROM documents WHERE text IS NOT NULL),
      f AS (SELECT doc_id, list_reduce(list_transform(l, LAMBDA x: {{'s': x, 'c': 0, 'm': x}}), LAMBDA a, x: {{'s': CASE WHEN a.s > 0 AND a.s + x.s > 9600 THEN x.s ELSE a.s + x.s END, 'c': a.c + (a.s > 0 AND a.s + x.s > 9600)::INT, 'm': greatest(a.m, CASE WHEN a.s > 0 AND a.s + x.s > 9600 THEN x.s ELSE a.s + x.s END)}}) AS r FROM d)
      SELECT doc_id, r.c + 1 AS chunks, r.m::INT AS largest FROM f""",
    "quote_containment": r"""WITH c AS (SELECT DISTINCT id, contract_history_id, regexp_replace(chunk_text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g') AS q FROM contract_chunk WHERE chunk_text IS NOT NULL AND contract_history_id IS NOT NULL),
      b AS (SELECT DISTINCT contract_history_id, regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g') AS t FROM bundle_chunk WHERE text IS NOT NULL),
      q AS (SELECT * FROM c WHERE q <> '') SELECT contract_history_id, count(*) AS quotes, count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE b.contract_history_id = q.contract_history_id AND contains(t, q.q))) AS found FROM q GROUP BY 1""",
}

NAMES = tuple(SQL)


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
