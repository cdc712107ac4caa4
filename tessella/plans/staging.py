"""Queries around the staging of results: jobs and what came of them, filters over states, labels, prompts, JSON for callers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources.tables import table

STATES, WANTED = ("draft", "signed", "cancelled"), "signed, Draft"


def parse_states(wanted: str, known: tuple[str, ...] = STATES) -> list[str]:
    """The states named in a comma list; one that is not known is an error."""
    got = [s.strip().lower() for s in wanted.split(",") if s.strip()]
    if unknown := sorted(set(got) - set(known)):
        raise ValueError(f"unknown states: {', '.join(unknown)}")
    return got


def state_filter(spark, sf, wanted: str = WANTED, inactive: bool = False):
    """Contracts of the wanted states, by language and state; inactive ones (cancelled) only if asked for."""
    c = table(spark, sf, "contract", "id", "status", "lang").distinct().filter(F.col("status").isin(parse_states(wanted)))
    return c.filter(F.lit(inactive) | (F.col("status") != "cancelled")).groupBy(F.coalesce("lang", F.lit("?")).alias("lang"), "status").agg(F.count("*").alias("contracts"))


def job_results(spark, sf):
    """Per result the contract it led to and the generation that is current there; results without a contract stay."""
    r = table(spark, sf, "extract_result", "tmpid", "created_at", "payload").filter("tmpid IS NOT NULL").groupBy("tmpid").agg(F.count("*").alias("tries"), F.count("payload").alias("with_payload"))
    c = table(spark, sf, "contract", "id", "source_tmpid", "current_history_id").filter("source_tmpid IS NOT NULL").groupBy(F.col("source_tmpid").alias("tmpid")).agg(F.min(F.struct("id", "current_history_id")).alias("m"))
    h = table(spark, sf, "contract_history", "id", "version").groupBy(F.col("id").alias("history")).agg(F.max("version").alias("version"))
    both = r.join(c, "tmpid", "left").select("tmpid", "tries", "with_payload", F.col("m.id").alias("contract_id"), F.col("m.current_history_id").alias("history")).join(h, "history", "left")
    return both.select("tmpid", "tries", "with_payload", F.coalesce("contract_id", F.lit(-1)).alias("contract_id"), F.coalesce("version", F.lit(0)).alias("version"))


def asset_labels(spark, sf):
    """Each title with the label nearest to it of the assets of its work, by trigrams; titles without labels stay."""
    a = table(spark, sf, "content_asset", "id", "ip_id", "title", "label")
    pairs = a.select("id", "ip_id", "title").join(a.filter("label IS NOT NULL").select("ip_id", "label").distinct(), "ip_id", "left")
    score = F.coalesce(F.round(text.similarity(F.col("title"), F.col("label")), 6), F.lit(0.0))
    best = pairs.withColumn("score", score).groupBy("id").agg(F.max(F.struct("score", "label")).alias("m"))
    return best.select("id", F.coalesce("m.label", F.lit("")).alias("label"), "m.score")


def prompts(spark, sf):
    """Per generation its prompt: chunks that name money first, then by id, each with its first line cut to 60 characters; and what the whole would cost."""
    b = table(spark, sf, "bundle_chunk", "chunk_id", "contract_history_id", "text").filter("text IS NOT NULL AND contract_history_id IS NOT NULL").distinct()
    found = (~F.col("text").rlike("USD|금 [0-9]|金[0-9]")).cast("int")
    line = F.concat(F.lit("["), F.col("chunk_id"), F.lit("] "), F.substring(F.substring_index("text", "\n", 1), 1, 60))
    rows = b.groupBy("contract_history_id").agg(F.sort_array(F.collect_list(F.struct(found.alias("late"), F.col("chunk_id").alias("c"), line.alias("line")))).alias("l"), F.sum(text.token_estimate(F.col("text"))).alias("units"))
    return rows.select("contract_history_id", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("digest"), F.size("l").alias("chunks"), "units")


def compat_ideographs(spark, sf):
    """Texts that hold compatibility ideographs, and how many."""
    d = table(spark, sf, "documents", "doc_id", "text").filter("text IS NOT NULL")
    n = F.regexp_count("text", F.lit("[\uf900-\ufaff]"))
    return d.select(F.when(n > 0, 1).otherwise(0).alias("has"), n.alias("n")).groupBy("has").agg(F.count("*").alias("texts"), F.sum("n").alias("ideographs"))


def normal_forms(spark, sf):
    """Texts by whether composing their characters and taking out soft hyphens changes them, and how many characters that saves."""
    d = table(spark, sf, "documents", "doc_id", "text").filter("text IS NOT NULL").withColumn("new", text.nfc("text"))
    return d.groupBy((F.col("new") != F.col("text")).alias("changed")).agg(F.count("*").alias("texts"), F.sum(F.char_length("text") - F.char_length("new")).alias("saved"))


def camel_struct(df: DataFrame, column: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """The column with camelCase names at every level; fields to drop are dropped wherever they stand."""
    def shape(c, t):
        if isinstance(t, T.StructType):
            inner = [shape(c.getField(f.name), f.dataType).alias(text.camel(f.name)) for f in t.fields if f.name not in drop]
            return F.when(c.isNotNull(), F.struct(*inner))
        return F.transform(c, lambda x: shape(x, t.elementType)) if isinstance(t, T.ArrayType) else c

    return df.withColumn(column, shape(F.col(column), df.schema[column].dataType))


def generation_payloads(spark, sf):
    """Per generation its chunks as nested JSON with camelCase keys, amounts as text and without vectors."""
    c = table(spark, sf, "contract_chunk", "id", "contract_history_id", "page_start", "clause_no", "embedding").filter("contract_history_id IS NOT NULL").dropDuplicates(["id"])
    rows = c.groupBy("contract_history_id").agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("chunk_id"), F.struct("page_start", "clause_no").alias("found_at"), F.slice("embedding", 1, 2).alias("embedding")))).alias("chunk_list"))
    whole = camel_struct(rows.select("contract_history_id", F.struct("contract_history_id", "chunk_list").alias("payload")), "payload", ("embedding",))
    return whole.select("contract_history_id", F.to_json("payload").alias("payload"))


def gold_rows(spark, sf):
    """One row per contract from all its sources: header, current generation, number of grants and of chunks, first evidence."""
    c = table(spark, sf, "contract", "id", "title", "lang", "current_history_id").groupBy("id").agg(F.max(F.struct("title", "lang", "current_history_id")).alias("c"))
    h = table(spark, sf, "contract_history", "id", "version", "document_kind").groupBy(F.col("id").alias("current_history_id")).agg(F.max(F.struct("version", "document_kind")).alias("h"))
    g = table(spark, sf, "rights_grant", "id", "contract_id").distinct().groupBy(F.col("contract_id").alias("id")).agg(F.count("*").alias("grants"))
    k = table(spark, sf, "contract_chunk", "id", "contract_id").distinct().groupBy(F.col("contract_id").alias("id")).agg(F.count("*").alias("chunks"))
    rows = c.select("id", "c.*").join(h, "current_history_id", "left").join(g, "id", "left").join(k, "id", "left")
    text_ = lambda x: F.coalesce(x, F.lit(""))
    return rows.select("id", text_(F.col("title")).alias("title"), text_(F.col("lang")).alias("lang"), F.coalesce("h.version", F.lit(0)).alias("version"), text_(F.col("h.document_kind")).alias("kind"), F.coalesce("grants", F.lit(0)).alias("grants"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def field_answers(spark, sf):
    """Per contract its grants' answers by field, as a map of lists in JSON."""
    g = table(spark, sf, "rights_grant", "contract_id", "legal_right", "exploitation_mode").filter("contract_id IS NOT NULL")
    each = g.select("contract_id", F.explode(F.create_map(F.lit("exploitation_mode"), F.col("exploitation_mode"), F.lit("legal_right"), F.col("legal_right"))).alias("field", "answer"))
    lists = each.groupBy("contract_id", "field").agg(F.sort_array(F.collect_set("answer")).alias("answers"))
    return lists.groupBy("contract_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "answers"))))).alias("answers"))


PHRASES = {"working days": "business days", "master files": "masters", "sealed consent": "consent under seal"}


def paraphrases(spark, sf):
    """Clauses in other words: how many change, and by how many characters."""
    c = table(spark, sf, "contract_chunk", "id", "chunk_text").filter("chunk_text IS NOT NULL").distinct()
    new = c.select(F.char_length("chunk_text").alias("old"), F.char_length(text.replace_phrases(PHRASES)("chunk_text")).alias("new"), (F.col("chunk_text") != text.replace_phrases(PHRASES)("chunk_text")).alias("changed"))
    return new.groupBy("changed").agg(F.count("*").alias("clauses"), F.sum(F.col("new") - F.col("old")).alias("longer"))


def queries() -> dict:
    return {f.__name__: f for f in (state_filter, job_results, asset_labels, prompts, compat_ideographs, normal_forms, generation_payloads, gold_rows, field_answers, paraphrases)}


def _phrases_sql(c: str) -> str:
    for a, b in PHRASES.items():
        c = f"regexp_replace({c}, '{a.replace(' ', chr(92) + 's+')}', '{b}', 'g')"
    return c


_TRG = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), LAMBDA w: w <> ''), LAMBDA w: list_transform(range(1, length(w)::INT + 2), LAMBDA i: substr('  ' || w || ' ', i::INT, 3)))))"


def oracle_sql() -> dict[str, str]:
    return {
        "state_filter": "SELECT coalesce(lang, '?') AS lang, status, count(*) AS contracts FROM (SELECT DISTINCT id, status, lang FROM contract) WHERE status IN ('signed', 'draft') GROUP BY ALL",
        "job_results": """WITH r AS (SELECT tmpid, count(*) AS tries, count(payload) AS with_payload FROM extract_result WHERE tmpid IS NOT NULL GROUP BY 1), c AS (SELECT source_tmpid AS tmpid, min({'id': id, 'h': current_history_id}) AS m FROM contract WHERE source_tmpid IS NOT NULL GROUP BY 1),
h AS (SELECT id, max(version) AS version FROM contract_history GROUP BY 1) SELECT r.tmpid, tries, with_payload, coalesce(m.id, -1) AS contract_id, coalesce(version, 0) AS version FROM r LEFT JOIN c USING (tmpid) LEFT JOIN h ON h.id = m.h""",
        "asset_labels": f"""WITH p AS (SELECT a.id, a.title, b.label FROM content_asset a LEFT JOIN (SELECT DISTINCT ip_id, label FROM content_asset WHERE label IS NOT NULL) b USING (ip_id)), t AS (SELECT id, label, {_TRG.format('title')} AS x, {_TRG.format('label')} AS y FROM p),
s AS (SELECT id, label, coalesce(round(CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END, 6), 0) AS score FROM t)
SELECT id, coalesce(arg_max(label, {{'score': score, 'label': label}}), '') AS label, max(score) AS score FROM s GROUP BY id""",
        "prompts": """WITH b AS (SELECT DISTINCT chunk_id, contract_history_id, text FROM bundle_chunk WHERE text IS NOT NULL AND contract_history_id IS NOT NULL), l AS (SELECT contract_history_id, (NOT regexp_matches(text, 'USD|금 [0-9]|金[0-9]'))::INT AS late, chunk_id, '[' || chunk_id || '] ' || substr(split_part(text, chr(10), 1), 1, 60) AS line,
len(regexp_extract_all(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}]')) * 13 + length(text) * 7 AS units FROM b)
SELECT contract_history_id, md5(string_agg(line, chr(10) ORDER BY late, chunk_id, line)) AS digest, count(*)::INT AS chunks, sum(units)::BIGINT AS units FROM l GROUP BY 1""",
        "compat_ideographs": "WITH n AS (SELECT len(regexp_extract_all(text, '[\\x{F900}-\\x{FAFF}]')) AS n FROM documents WHERE text IS NOT NULL) SELECT (n > 0)::INT AS has, count(*) AS texts, sum(n)::BIGINT AS ideographs FROM n GROUP BY 1",
        "normal_forms": "WITH d AS (SELECT text, replace(nfc_normalize(text), chr(173), '') AS new FROM documents WHERE text IS NOT NULL) SELECT new <> text AS changed, count(*) AS texts, sum(length(text) - length(new))::BIGINT AS saved FROM d GROUP BY 1",
        "generation_payloads": """WITH c AS (SELECT DISTINCT ON (id) id, contract_history_id, page_start, clause_no FROM contract_chunk WHERE contract_history_id IS NOT NULL)
SELECT contract_history_id, '{"contractHistoryId":' || contract_history_id || ',"chunkList":[' || string_agg('{"chunkId":' || id || ',"foundAt":{' || concat_ws(',', '"pageStart":' || page_start, '"clauseNo":' || to_json(clause_no)::VARCHAR) || '}}', ',' ORDER BY id) || ']}' AS payload FROM c GROUP BY 1""",
        "gold_rows": """WITH c AS (SELECT id, max({'title': title, 'lang': lang, 'h': current_history_id}) AS c FROM contract GROUP BY 1), h AS (SELECT id, max({'version': version, 'kind': document_kind}) AS h FROM contract_history GROUP BY 1), g AS (SELECT contract_id, count(DISTINCT id) AS grants FROM rights_grant GROUP BY 1), k AS (SELECT contract_id, count(DISTINCT id) AS chunks FROM contract_chunk GROUP BY 1)
SELECT c.id, coalesce(c.c.title, '') AS title, coalesce(c.c.lang, '') AS lang, coalesce(h.h.version, 0) AS version, coalesce(h.h.kind, '') AS kind, coalesce(grants, 0) AS grants, coalesce(chunks, 0) AS chunks FROM c LEFT JOIN h ON h.id = c.c.h LEFT JOIN g ON g.contract_id = c.id LEFT JOIN k ON k.contract_id = c.id""",
        "field_answers": """WITH a AS (SELECT contract_id, list_sort(list_distinct(list(exploitation_mode))) AS m, list_sort(list_distinct(list(legal_right))) AS r FROM rights_grant WHERE contract_id IS NOT NULL GROUP BY 1)
SELECT contract_id, '{"exploitation_mode":' || to_json(m)::VARCHAR || ',"legal_right":' || to_json(r)::VARCHAR || '}' AS answers FROM a""",
        "paraphrases": f"WITH c AS (SELECT DISTINCT id, chunk_text, {_phrases_sql('chunk_text')} AS new FROM contract_chunk WHERE chunk_text IS NOT NULL) SELECT chunk_text <> new AS changed, count(*) AS clauses, sum(length(new) - length(chunk_text))::BIGINT AS longer FROM c GROUP BY 1",
    }
