import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.vectors import block_search
from tessella.operators import plugins
from tessella.plans import clauses, staging
from tessella.sources import files
from tessella.streaming import jobs


def test_embedding_stage(spark):
    letters = lambda texts: np.array([[len(t), t.count("a") + 1.0] for t in texts])
    df = spark.createDataFrame([(1, "aa", True), (2, None, True), (3, " ", True), (4, "b", False)], "id int, t string, indexable boolean")
    got = {r.id: r.embedding for r in plugins.embed(df, "t", letters, wanted=F.col("indexable")).collect()}
    assert got[2] is got[3] is got[4] is None and abs(sum(x * x for x in got[1]) - 1) < 1e-5
    assert plugins.embed(df.limit(0), "t", letters).count() == 0


def test_reading_of_pages(spark):
    engines = [lambda image, lang: "short", lambda image, lang: f"longer text {lang}"]
    rows = [(1, b"x", "", "OCR", "ko"), (2, b"x", "this text layer is longer than that", "VERIFY", "en"), (3, b"x", "few", "VERIFY", "en"), (4, b"x", "kept", "TEXT_LAYER", "ko"), (5, None, "none", "OCR", "ko")]
    df = spark.createDataFrame(rows, "id int, image binary, text string, route string, lang string")
    got = {r.id: (r.text, r.source) for r in plugins.read_pages(df, engines).collect()}
    assert got == {1: ("longer text ko", "OCR"), 2: (rows[1][2], "TEXT_LAYER"), 3: ("longer text None", "OCR"), 4: ("kept", "TEXT_LAYER"), 5: ("none", "TEXT_LAYER")}


def test_extraction_keeps_other_rows(spark):
    def model(p):
        if p == "bad":
            raise ValueError("no\nanswer")
        return json.dumps({"said": p})

    df = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", None)], "tmpid string, prompt string")
    got = {r.tmpid: (r.payload, r.reason) for r in plugins.chain(df, lambda d: plugins.extract(d, model, "tmpid", "prompt")).collect()}
    assert got == {"a": ('{"said": "x"}', None), "b": (None, "ValueError: no"), "c": (None, None)}


def test_makers(monkeypatch):
    monkeypatch.setenv("T_SOURCE", "b")
    assert plugins.from_environment("T_SOURCE", {"a": lambda: 1, "b": lambda: 2}, "a") == 2
    monkeypatch.setenv("T_SOURCE", "z")
    with pytest.raises(ValueError):
        plugins.from_environment("T_SOURCE", {"a": lambda: 1}, "a")


def test_stores(spark, tmp_path):
    rows = [(1, 2, b"%PDF-1"), (1, 3, None)]
    got = files.store(spark.createDataFrame(rows, "contract_id int, history_id int, content binary"), str(tmp_path)).collect()
    assert sorted(r.size for r in got) == [0, 6] and (tmp_path / "1" / "2.pdf").read_bytes() == b"%PDF-1"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-a")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-a")
    (tmp_path / "in" / "c.pdf").write_bytes(b"no")
    at = f"{tmp_path}/q"
    assert files.register_uploads(files.uploads(spark, str(tmp_path / "in")), at).count() == 1
    assert files.register_uploads(files.uploads(spark, str(tmp_path / "in")), at).count() == 0
    assert spark.read.parquet(f"{at}/job").count() == spark.read.parquet(f"{at}/blob").count() == 1
    chunk = '[{"chunk_id":"a","page_start":1},5,{"text":"t"}]'
    got = files.chunk_rows(spark.createDataFrame([(7, chunk), (8, None), (9, "broken")], "h int, p string"), "h", "p").collect()
    assert [(r.h, r.place, r.chunk_id, r.text) for r in got] == [(7, 0, "a", None), (7, 2, None, "t")]


def test_poll_and_changed_rows(spark, tmp_path):
    log = spark.createDataFrame([(1, "contract_chunk", 5, "I"), (2, "contract_chunk", 6, "I"), (3, "contract_chunk", 6, "D"), (4, "contract", 7, "I"), (5, "contract_chunk", 5, "U")], "id long, table_name string, row_id long, op string")
    log.write.parquet(f"{tmp_path}/log")
    rows, seen = spark.range(10), []
    q = jobs.poll(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"), lambda b, i: seen.extend(r.id for r in jobs.changed_rows(b, rows, "contract_chunk", "id").collect()), f"{tmp_path}/cp", None)
    q.awaitTermination()
    assert seen == [5]


def test_block_search_is_exact(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j), k + 1) for i in range(0, 300, 50) for k, j in enumerate(np.argsort(-s[i])[:4])}
    for rows, queries in ((20_000, 5_000), (70, 2)):
        monkeypatch.setattr("tessella.functions.vectors.ROWS_BLOCK", rows)
        monkeypatch.setattr("tessella.functions.vectors.QUERIES_BLOCK", queries)
        assert {tuple(r) for r in block_search(df, F.col("id") % 50 == 0, 4).collect()} == want
    assert block_search(df.limit(0), F.col("id") % 50 == 0, 4).count() == 0


def test_clauses_and_chunks(spark):
    long = "\n".join(f"Sentence number {i} goes on for quite a while here." for i in range(80))
    text = f"Front page\n3 / 7\nArticle 1 (Grant)\nshort\nArticle 2 (Pay)\n{long}\nSchedule 1 — List\nrow"
    df = spark.createDataFrame([(1, text), (1, text), (2, "no heads at all"), (3, None), (4, "  ")], "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS lines")
    got = clauses.segments(df).orderBy("doc_id", "clause").collect()
    assert [(r.doc_id, r.kind, r.clause_no, r.title) for r in got] == [(1, "FRONT_MATTER", "", ""), (1, "ARTICLE", "Article 1", "Grant"), (1, "ARTICLE", "Article 2", "Pay"), (1, "SCHEDULE", "Schedule 1", "List"), (2, "UNSEGMENTED", "", "")]
    clean = text.replace("3 / 7\n", "")
    assert all(clean[r.char_start : r.char_end] == r.text for r in got if r.doc_id == 1)
    pieces = clauses.chunks(clauses.segments(df)).filter("doc_id = 1 AND clause = 2").orderBy("piece").collect()
    assert len(pieces) > 1 and all(r.cost <= clauses.MOST and clean[r.char_start : r.char_end] == r.text for r in pieces)
    assert "\n".join(r.text for r in pieces) == got[2].text and all(r.text.endswith(".") for r in pieces)
    assert clauses.chunks(clauses.segments(df.limit(0))).count() == 0


def test_camel_at_every_level(spark):
    df = spark.createDataFrame([(1, {"page_start": 1, "inner_list": [{"clause_no": "a", "embedding": "x"}]})], "id int, p struct<page_start:int, inner_list:array<struct<clause_no:string, embedding:string>>>")
    got = staging.camel_struct(df, "p", ("embedding",)).select(F.to_json("p")).first()[0]
    assert got == '{"pageStart":1,"innerList":[{"clauseNo":"a"}]}'
    with pytest.raises(ValueError):
        staging.parse_states("draft,gone")


def test_bundle_of_chunks_and_hits(spark):
    from tessella.plans import retrieval

    words = ("territory", "pay", "month", "show")
    model = lambda texts: np.array([[1.0 + sum(t.lower().count(w) for w in words), *[t.lower().count(w) for w in words]] for t in texts])
    text = "Article 1 (Territory)\nThe territory is South Korea and Japan and no other place at all, says the schedule.\nArticle 2 (Pay)\nThe licensee shall pay USD 5,000 within thirty days of the date of the invoice, by wire."
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    pieces, hits, info = retrieval.bundle(df, model)
    best = {(r.field): r.clause for r in hits.filter("place = 1").collect()}
    assert best["territory"] == 1 and best["payment"] == 2
    assert [tuple(r) for r in info.collect()] == [(1, 2, 2, 1, "en")] and pieces.filter("embedding IS NOT NULL").count() == 2
