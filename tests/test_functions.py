from pyspark.sql import functions as F

from tessella.functions import ranges, text, vectors
from tessella.operators import relational as R
from tessella.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_similarities(spark):
    assert round(one(spark, text.similarity(F.lit("word"), F.lit("two words"))), 6) == 0.363636
    assert text.best_extent("word", "two words") == 0.8
    assert round(text.best_extent("word", "two words", True), 6) == 0.571429
    assert one(spark, text.similarity(F.lit(""), F.lit(""))) == 0.0


def test_ranges(spark):
    df = spark.createDataFrame([(1, 5, 4, 9), (1, 5, 5, 9), (None, 5, 2, 3), (3, 3, 1, 9)], "a int, b int, c int, d int")
    got = [tuple(r) for r in df.select(ranges.overlaps("a", "b", "c", "d"), ranges.contains("a", "b", "c", "d"), ranges.intersection_text("a", "b", "c", "d")).collect()]
    assert got == [(True, False, "[4,5)"), (False, False, "empty"), (True, True, "[2,3)"), (False, False, "empty")]


def test_merge_patch():
    assert text.merge_patch_value({"a": 1, "b": {"c": 2, "d": 3}}, {"a": None, "b": {"c": 9}, "e": [1]}) == {"b": {"c": 9, "d": 3}, "e": [1]}
    assert text.merge_patch_value({"a": 1}, 5) == 5
    assert text.merge_patch_value("x", {"a": {"b": None}}) == {"a": {}}


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.cosine(v(1, 0), v(0, 2))) == 0.0
    assert one(spark, vectors.cosine(v(0, 0), v(0, 2))) is None


def test_text(spark):
    assert one(spark, text.safe_filename(F.lit("c:\\x\\a.pdf"))) == "a.pdf" and one(spark, text.safe_filename(F.lit("a/"))) == "upload.pdf"
    assert str(one(spark, text.iso_date(F.lit("on July 4, 2021 and")))) == "2021-07-04" and str(one(spark, text.iso_date(F.lit("2021년 7월 4일")))) == "2021-07-04"
    assert one(spark, text.json_part(F.lit('<think>{x}</think>```json\n{"a":{}}\n```'))) == '{"a":{}}'
    assert text.camel("page_start_no") == "pageStartNo"


def test_diff_and_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "n")], "id int, v string")
    assert sorted(tuple(r) for r in R.snapshot_diff(a, b, ["id"]).collect()) == [(1, "D"), (2, "U"), (4, "I")]
    assert sorted((r.id, r.v) for r in R.upsert(a, b, ["id"]).collect() if r.v) == [(1, "x"), (2, "z"), (4, "n")]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    got = {r.path.rsplit("/", 1)[1]: r.verdict for r in files.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "OK", "b.pdf": "NOT_PDF"}
    assert one(spark, files.upload_verdict(F.lit(bytearray()))) == "EMPTY"
    (tmp_path / "t.md").write_text("# T\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    assert [r.cells for r in files.markdown_rows(files.text_corpus(spark, str(tmp_path / "t.md"))).collect()] == [["a", "b"], ["1", "2"]]
    assert files.stored_path("/s", 1, 2) == "/s/1/2.pdf"


def test_phrases_and_boxes(spark):
    f = text.replace_phrases({"sole right": "A", "right": "B"})
    assert one(spark, f(F.lit("the sole\n right and a right"))) == "the A and a B"
    boxes = F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in ((50, 1, 60, 11), (0, 0, 10, 10), (0, 20, 10, 30))])
    assert one(spark, text.reading_order(boxes)) == [1, 0, 2]


def test_latest_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 2), (1, "c", 2), (2, "z", None), (None, "n", 1)], "k int, v string, at int")
    assert {(r.k, r.v, r.at) for r in R.latest_by(df, ["k"], "at", "v").collect()} == {(1, "c", 2), (2, "z", None), (None, "n", 1)}


def test_spans_of_codes(spark):
    import pytest

    dim = spark.createDataFrame([("A", 1, 3), ("B", 3, 4)], "code string, lo int, hi int")
    df = spark.createDataFrame([(1, "A", 99), (2, None, 99)], "id int, right string, lo int")
    assert {r.id: (r.lo, r.hi) for r in ranges.with_span(df, "right", dim).collect()} == {1: (1, 3), 2: (None, None)}
    odd = spark.createDataFrame([(3, "Z")], "id int, right string")
    assert ranges.with_span(odd, "right", dim, strict=False).first().lo is None
    with pytest.raises(Exception, match="unknown code: Z"):
        ranges.with_span(odd, "right", dim).collect()


def test_a_cycle_is_an_error(spark):
    import pytest

    dim = spark.createDataFrame([("a", "b"), ("b", "a")], "code string, parent_code string")
    with pytest.raises(Exception):
        R.ancestors(dim).collect()
    deep = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(60)], "code string, parent_code string")
    assert R.ancestors(deep).count() == 59 * 60 // 2
