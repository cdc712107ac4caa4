from pyspark.sql import functions as F

from tessella.streaming import jobs


def run(df, name, mode="update"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_window_counts_equal_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    src.write.parquet(f"{tmp_path}/e")
    got = run(jobs.window_counts(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/e"), late="1000 days"), "w", "complete")
    want = src.groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert got.select("window.start", "event_type", "count").exceptAll(want.select("window.start", "event_type", "count")).count() == 0 and got.count() == want.count()


def test_job_states(spark, tmp_path):
    schema = "tmpid string, seq long, event string, at double, stage string"
    rows = [("a", 1, "claim", 0.0, None), ("a", 2, "stage", 1.0, "LLM"), ("a", 3, "done", 2.0, None), ("a", 3, "done", 2.0, None)]
    rows += [("b", i, e, float(i), None) for i, e in enumerate(["claim", "fail"] * 3)] + [("c", 1, "claim", 0.0, None), ("c", 2, "claim", 700.0, None)]
    got = {r.tmpid: (r.status, r.attempts, r.reason) for r in run(jobs.job_states(stream(spark, rows, schema, f"{tmp_path}/j")), "j").collect()}
    assert got == {"a": ("DONE", 1, None), "b": ("FAILED", 3, "OCR_FAILED"), "c": ("RUNNING", 2, None)}


def test_keyed_intervals(spark, tmp_path):
    rows = [(1, "[2020-01-01,2020-01-05)"), (1, "[2020-01-05,2020-01-07)"), (1, "[2020-01-09,2020-01-10)"), (2, None)]
    got = run(jobs.keyed_intervals(stream(spark, rows, "k long, period string", f"{tmp_path}/i"), ["k"]), "i").collect()
    assert sorted((r.k, r.kind, r.hi - r.lo) for r in got) == [(1, "gap", 2), (1, "period", 1), (1, "period", 6)]


def test_upsert_sink_is_idempotent(spark, tmp_path):
    write = jobs.upsert_sink(f"file://{tmp_path}/u", ["k"], "t")
    one, two = (spark.createDataFrame(r, "k int, t int, v string") for r in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (2, 0, "old")]))
    for df, i in ((one, 0), (two, 1), (two, 1)):
        write(df, i)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/u/v=1").collect()) == [(1, 2, "c"), (2, 1, "b")]
