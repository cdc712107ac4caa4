"""Cutting documents into clauses and clauses into chunks, within the row: lines never leave their document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table

#: Kinds of heads and how they begin a line; the first number is the head's own.
HEAD_KINDS = {
    "ARTICLE": r"제 ?\d+ ?조|第 ?\d+ ?条|(?:Article|Clause|Section) \d+",
    "SCHEDULE": r"별지 ?\d+|別紙 ?\d+|(?:Schedule|Exhibit|Appendix|Annex) \d+",
    "GRANT_ITEM": r"개별 ?이용허락 ?\d+|個別(?:利用)?許諾 ?\d+|Grant \d+",
}
HEAD = "|".join(HEAD_KINDS.values())
LANGUAGES = {"ko": r"제 ?\d+ ?조", "ja": r"第 ?\d+ ?条", "en": r"(?:Article|Clause|Section) \d+"}
#: Lines that are no text: page numbers.
NOISE = r"^[ \t]*(?:\|?[ \t]*\d+[ \t]*/[ \t]*\d+|- *\d+ *-)[ \t]*\n?"
# Cost of a chunk at most, the share of it beyond which a sentence's end closes it, characters worth an index entry.
#: Lines of a page, cost of a chunk at most (in 1/20 token), its share beyond which a sentence's end closes it, and characters of text worth an index entry.
PAGE_LINES, MOST, FULL, INDEXABLE = 40, 9600, 6720, 60
WIDE = "[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]"
#: Unicode property Sentence_Terminal, of the scripts of the corpus, before closing marks.
SENTENCE_END = r"[.!?。．！？｡]['\"”’」』)）]*[ \t]*$"


def cost(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WIDE)) * 13 + F.char_length(text) * 7


def _newlines(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, "\n", ""))


def segments(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, hash, lang, clause (from 0), kind, clause_no, title, text, char_start, char_end, first_line: the clauses of each text.

    What stands before the first head is FRONT_MATTER; a text without heads is one UNSEGMENTED clause. Page numbers are
    taken out before offsets are counted. Null and blank texts have no clauses."""
    clean = F.regexp_replace(text, "(?md)" + NOISE, "")
    marked = F.regexp_replace("clean", f"(?md)^([ \\t]*(?:{HEAD}))", "\u0001$1")
    count = lambda k: F.regexp_count("clean", F.lit(f"(?md)^[ \\t]*(?:{LANGUAGES[k]})"))
    best = F.greatest(*[count(k) for k in LANGUAGES])
    lang = F.when(best == 0, "unknown").when(count("ko") == best, "ko").when(count("ja") == best, "ja").otherwise("en")
    rows = df.select(key, text).filter(F.col(text).isNotNull()).distinct().select(key, F.sha2(F.col(text), 256).alias("hash"), clean.alias("clean"))
    rows = rows.select(key, "hash", lang.alias("lang"), F.split(marked, "\u0001").alias("parts"))
    # Offsets and lines of each part: sums over the parts before it (a few dozen numbers).
    sums = lambda size: F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda s, x: s + size(x).cast("int")))
    rows = rows.withColumn("starts", sums(F.char_length)).withColumn("line_starts", sums(_newlines))
    each = rows.select(key, "hash", "lang", F.size("parts").alias("n"), F.posexplode(F.arrays_zip("parts", "starts", "line_starts")).alias("i", "p"))
    body = F.regexp_replace("p.parts", r"\n+\z", "")
    each = each.select(key, "hash", "lang", "n", "i", body.alias("text"), F.col("p.starts").alias("char_start"), F.col("p.line_starts").alias("first_line")).filter("trim(text) <> ''")
    first = F.trim(F.substring_index("text", "\n", 1))
    kind = F.when((F.col("i") == 0) & ~F.col("text").rlike(f"\\A[ \\t]*(?:{HEAD})"), F.when(F.col("n") == 1, "UNSEGMENTED").otherwise("FRONT_MATTER"))
    for k, p in HEAD_KINDS.items():
        kind = kind.when(first.rlike(f"^(?:{p})"), k)
    head = F.regexp_replace(F.regexp_extract(first, f"^(?:{HEAD})", 0), r"(?<=[^A-Za-z]) +| +(?=[^0-9A-Za-z])", "")
    title = F.trim(F.regexp_extract(first, f"^(?:{HEAD})[ \\t]*[(（—–:-]*([^)）]*)", 1))
    headed = ~F.col("kind").isin("UNSEGMENTED", "FRONT_MATTER")
    return each.withColumn("kind", kind).select(
        key, "hash", "lang", F.col("i").alias("clause"), "kind", F.when(headed, head).otherwise("").alias("clause_no"), F.when(headed, title).otherwise("").alias("title"), "text", "char_start",
        (F.col("char_start") + F.char_length("text")).alias("char_end"), "first_line",
    )


def chunks(clauses: DataFrame, key: str = "doc_id", most: int = MOST, full: int = FULL) -> DataFrame:
    """Chunks of clauses: a clause that costs no more than `most` is one; a longer one is filled line by line, closed
    before the line that would be too much and after the end of a sentence beyond `full`. Only a line that costs too much by itself makes a chunk that does."""
    ends = lambda x: x.rlike("(?d)" + SENTENCE_END)
    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("t"), F.array().cast("array<int>").alias("of"))

    def step(s: Column, x: Column) -> Column:
        price = (cost(x) + 7).cast("int")
        over = (s["t"] > 0) & (s["t"] + price > most)
        g, t = s["g"] + over.cast("int"), F.when(over, price).otherwise(s["t"] + price)
        done = (t > full) & ends(x)
        return F.struct((g + done.cast("int")).alias("g"), F.when(done, 0).otherwise(t).alias("t"), F.concat(s["of"], F.array(g)).alias("of"))

    lines = F.split("text", "\n")
    whole = cost(F.col("text")) <= most
    of = F.when(whole, F.array_repeat(F.lit(0), F.size(lines))).otherwise(F.aggregate(lines, start, step, lambda s: s["of"]))
    groups = F.transform(
        F.sequence(F.lit(0), F.array_max("of")),
        lambda g: F.struct(
            F.array_join(F.transform(F.filter(F.arrays_zip("of", F.col("lines")), lambda z: z["of"] == g), lambda z: z["lines"]), "\n").alias("text"), (F.array_position("of", g) - 1).cast("int").alias("line"),
        ),
    )
    rows = clauses.withColumn("lines", lines).withColumn("of", of).select("*", F.posexplode(groups).alias("piece", "c")).drop("of")
    before = F.aggregate(F.slice("lines", F.lit(1), F.col("c.line")), F.lit(0), lambda s, x: s + F.char_length(x) + 1)
    page = lambda line: F.floor(line / PAGE_LINES).cast("int") + 1
    own = F.col("c.text")
    rows = rows.select(
        key, "hash", "lang", "clause", "piece", "kind", "clause_no", "title", (F.col("char_start") + before).alias("char_start"), page(F.col("first_line") + F.col("c.line")).alias("page_start"),
        page(F.col("first_line") + F.col("c.line") + _newlines(own)).alias("page_end"), own.alias("text"), cost(own).alias("cost"), (F.char_length(F.trim(own)) >= INDEXABLE).alias("indexable"),
    ).filter("trim(text) <> ''")
    return rows.withColumn("char_end", F.col("char_start") + F.char_length("text"))


def clause_rows(spark, sf):
    """The clauses of every document; of the text its digest."""
    return segments(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", "lang", "clause", "kind", "clause_no", "title", "char_start", "char_end", "first_line", F.md5("text").alias("digest"))


def clause_chunks(spark, sf):
    """The chunks of every document, with pages, offsets and ids (twelve digits of the text's digest and the place of the chunk)."""
    c = chunks(segments(table(spark, sf, "documents", "doc_id", "text")))
    return c.select("doc_id", F.concat(F.substring("hash", 1, 12), F.format_string("-%04d-%02d", "clause", "piece")).alias("chunk_id"), "page_start", "page_end", "char_start", "char_end", "cost", "indexable", F.md5("text").alias("digest"))


def clause_chunk_stats(spark, sf):
    """Per document: chunks, those worth an index entry, over pages, over the limit, and clauses that were split."""
    c = chunks(segments(table(spark, sf, "documents", "doc_id", "text")))
    return c.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if("indexable").alias("indexable"), F.count_if(F.col("page_start") < F.col("page_end")).alias("spanning_pages"), F.count_if(F.col("cost") > MOST).alias("over_limit"),
        F.count_if(F.col("piece") == 1).alias("split_clauses"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (clause_rows, clause_chunks, clause_chunk_stats)}


_P = lambda p: p.replace("'", "''")
_WIDE_SQL = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"


def _cost_sql(c: str) -> str:
    return f"(len(regexp_extract_all({c}, '{_WIDE_SQL}')) * 13 + length({c}) * 7)"


_NL = lambda c: f"(length({c}) - length(replace({c}, chr(10), '')))"
_COUNTS = {k: f"len(regexp_extract_all(clean, '(?m)^[ \\t]*(?:{p})'))" for k, p in LANGUAGES.items()}
_KINDS = " ".join(f"WHEN regexp_matches(first, '^(?:{p})') THEN '{k}'" for k, p in HEAD_KINDS.items())
_CLAUSES = f"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, sha256(text) AS hash, regexp_replace(text, '(?m){NOISE}', '', 'g') AS clean FROM d),
m AS (SELECT *, string_split(regexp_replace(clean, '(?m)^([ \\t]*(?:{HEAD}))', chr(1) || '\\1', 'g'), chr(1)) AS parts, {_COUNTS['ko']} AS ko, {_COUNTS['ja']} AS ja, {_COUNTS['en']} AS en FROM c),
x AS (SELECT doc_id, hash, CASE WHEN greatest(ko, ja, en) = 0 THEN 'unknown' WHEN ko = greatest(ko, ja, en) THEN 'ko' WHEN ja = greatest(ko, ja, en) THEN 'ja' ELSE 'en' END AS lang, len(parts) AS n,
  unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS clause FROM m),
y AS (SELECT *, coalesce(sum(length(part)) OVER w, 0)::INT AS char_start, coalesce(sum({_NL('part')}) OVER w, 0)::INT AS first_line, regexp_replace(part, '\\n+$', '') AS text FROM x
  WINDOW w AS (PARTITION BY doc_id ORDER BY clause ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, trim(split_part(text, chr(10), 1)) AS first FROM y WHERE trim(text) <> ''),
k AS (SELECT *, CASE WHEN clause = 0 AND NOT regexp_matches(text, '^[ \\t]*(?:{HEAD})') THEN CASE WHEN n = 1 THEN 'UNSEGMENTED' ELSE 'FRONT_MATTER' END {_KINDS} END AS kind FROM z),
cl AS (SELECT doc_id, hash, lang, clause::INT AS clause, kind, CASE WHEN kind IN ('UNSEGMENTED', 'FRONT_MATTER') THEN '' ELSE regexp_replace(regexp_replace(regexp_extract(first, '^(?:{HEAD})'), '([^A-Za-z ]) +', '\\1', 'g'), ' +([^0-9A-Za-z ])', '\\1', 'g') END AS clause_no,
  CASE WHEN kind IN ('UNSEGMENTED', 'FRONT_MATTER') THEN '' ELSE trim(regexp_extract(first, '^(?:{HEAD})[ \\t]*[(（—–:-]*([^)）]*)', 1)) END AS title, text, char_start, char_start + length(text) AS char_end, first_line FROM k)"""
_CHUNKS = _CLAUSES + f""", li AS (SELECT *, string_split(text, chr(10)) AS lines, {_cost_sql('text')} <= {MOST} AS whole FROM cl),
fold AS (SELECT *, CASE WHEN whole THEN list_transform(lines, LAMBDA q: 0) ELSE list_reduce(list_transform(lines, LAMBDA q: {{'g': 0, 't': {_cost_sql('q')} + 7, 'e': regexp_matches(q, '{_P(SENTENCE_END)}'), 'of': []::INT[]}}),
  LAMBDA s, q: {{'g': s.g + (s.t > 0 AND s.t + q.t > {MOST})::INT + ((CASE WHEN s.t > 0 AND s.t + q.t > {MOST} THEN q.t ELSE s.t + q.t END) > {FULL} AND q.e)::INT,
    't': CASE WHEN (CASE WHEN s.t > 0 AND s.t + q.t > {MOST} THEN q.t ELSE s.t + q.t END) > {FULL} AND q.e THEN 0 WHEN s.t > 0 AND s.t + q.t > {MOST} THEN q.t ELSE s.t + q.t END,
    'e': q.e, 'of': list_append(s.of, s.g + (s.t > 0 AND s.t + q.t > {MOST})::INT)}}, {{'g': 0, 't': 0, 'e': false, 'of': []::INT[]}}).of END AS of FROM li),
ex AS (SELECT doc_id, hash, clause, char_start, first_line, unnest(lines) AS line, unnest(of) AS piece, generate_subscripts(lines, 1) - 1 AS i FROM fold),
of2 AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, clause ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ex),
ch AS (SELECT doc_id, hash, clause, piece, (char_start + min(before))::INT AS char_start, min(first_line + i) // {PAGE_LINES} + 1 AS page_start, max(first_line + i) // {PAGE_LINES} + 1 AS page_end, string_agg(line, chr(10) ORDER BY i) AS text FROM of2 GROUP BY doc_id, hash, clause, piece, char_start),
co AS (SELECT *, {_cost_sql('text')} AS cost, length(trim(text)) >= {INDEXABLE} AS indexable FROM ch WHERE trim(text) <> '')"""


def oracle_sql() -> dict[str, str]:
    return {
        "clause_rows": _CLAUSES + " SELECT doc_id, lang, clause, kind, clause_no, title, char_start, char_end, first_line, md5(text) AS digest FROM cl",
        "clause_chunks": _CHUNKS + " SELECT doc_id, hash[1:12] || printf('-%04d-%02d', clause, piece) AS chunk_id, page_start, page_end, char_start, char_start + length(text) AS char_end, cost, indexable, md5(text) AS digest FROM co",
        "clause_chunk_stats": _CHUNKS + f" SELECT doc_id, count(*) AS total, count_if(indexable)::BIGINT AS indexable, count_if(page_start < page_end)::BIGINT AS spanning_pages, count_if(cost > {MOST})::BIGINT AS over_limit, count_if(piece = 1)::BIGINT AS split_clauses FROM co GROUP BY doc_id",
    }
