"""Streaming operators: windows with late data, a keyed job state machine, change feeds and intervals in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import relational as R
from ..operators.intervals import IntervalMap, parse_range

MAX_ATTEMPTS = 3
# Why a job failed, by the stage it failed in.
REASONS = {"OCR_TIMEOUT": "OCR_TIMEOUT", "OCR": "OCR_FAILED", "LLM": "LLM_EXTRACTION_FAILED"}


def window_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts by key; rows later than `late` behind the newest are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).count()


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).count()


def joined_streams(a: DataFrame, b: DataFrame, key: str, ts_a: str, ts_b: str, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of two streams with one key whose times lie within `within`; state is bounded by both watermarks."""
    x, y = a.withWatermark(ts_a, late).alias("a"), b.withWatermark(ts_b, late).alias("b")
    near = F.expr(f"b.{ts_b} BETWEEN a.{ts_a} - INTERVAL {within} AND a.{ts_a} + INTERVAL {within}")
    return x.join(y, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near)


JOB_STATE = "status string, stage string, attempts int, lease double, reason string, seq long"
JOB_OUTPUT = "tmpid string, status string, stage string, attempts int, reason string"


def next_state(state: tuple, event: str, at: float, stage: str | None, lease: float = 600.0) -> tuple:
    """One step of a job: claim, stage, done, fail; an expired lease makes a running job claimable again."""
    status, now, attempts, until, reason = state
    if event == "claim" and (status == "QUEUED" or status == "RUNNING" and until < at):
        return "RUNNING", stage or "OCR", attempts + 1, at + lease, None
    if status != "RUNNING":
        return state
    if event == "stage":
        return status, stage, attempts, at + lease, None
    if event == "done":
        return "DONE", None, attempts, 0.0, None
    if event == "fail":
        why = REASONS.get(stage or "", REASONS.get(now or "", "LLM_EXTRACTION_FAILED"))
        return ("FAILED" if attempts >= MAX_ATTEMPTS else "QUEUED"), None, attempts, 0.0, why
    return state


def _job(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    *now, seq = state.get if state.exists else ("QUEUED", None, 0, 0.0, None, -1)
    now = tuple(now)
    batch = pd.concat(list(rows)).sort_values("seq")
    for r in batch.itertuples():
        if r.seq <= seq:
            continue  # delivered again
        seq = int(r.seq)
        now = next_state(now, r.event, float(r.at), r.stage)
    state.update((*now, seq))
    yield pd.DataFrame([(key[0], now[0], now[1], now[2], now[4])], columns=["tmpid", "status", "stage", "attempts", "reason"])


def job_states(events: DataFrame) -> DataFrame:
    """State of each job after its events (tmpid, seq, event, at, stage), kept by key; repeated events count once."""
    return events.groupBy("tmpid").applyInPandasWithState(_job, JOB_OUTPUT, JOB_STATE, "update", GroupStateTimeout.NoTimeout)


INTERVAL_STATE = "starts array<int>, ends array<int>"


def keyed_intervals(rows: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """Continuous periods and gaps per entity as they stand after each batch; the interval map is the keyed state."""
    out = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", kind string, lo int, hi int"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = IntervalMap()
        if state.exists:
            starts, ends = state.get
            for lo, hi in zip(starts, ends, strict=True):
                m.insert(int(lo), int(hi))
        for b in batches:
            for text in b[period].tolist():
                if span := parse_range(text):
                    m.insert(*span)
        state.update((m.starts, m.ends))
        found = [(*key, "period", *p) for p in m.periods()] + [(*key, "gap", *g) for g in m.gaps]
        yield pd.DataFrame(found, columns=[*keys, "kind", "lo", "hi"])

    return rows.groupBy(*keys).applyInPandasWithState(run, out, INTERVAL_STATE, "update", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, keys: list[str], *order: str):
    """A foreachBatch function that keeps the latest row of each key in a versioned Parquet folder; repeating a batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        new = R.latest_by(batch, keys, *order)
        versions = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("v=")) if fs.exists(fs_path) else []
        older = [v for v in versions if v < batch_id]
        merged = R.latest_by(spark.read.parquet(f"{path}/v={older[-1]}").unionByName(new), keys, *order) if older else new
        merged.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        for v in older[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}"), True)

    return write


def poll(stream: DataFrame, handle, checkpoint: str, every: str | None = "5 seconds"):
    """Start handling the stream's new rows batch by batch: every so often until stopped, or (every=None) all there is and no more.
    `handle(batch, batch_id)` may be repeated for a batch after a failure, so it must be idempotent (see `upsert_sink`)."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def changed_rows(changes: DataFrame, rows: DataFrame, table: str, key: str) -> DataFrame:
    """Of a batch of changes, the rows of one table that are to be worked on again (say, to get new vectors): each once, deleted ones left out."""
    last = changes.filter(F.lower("table_name") == table).groupBy("row_id").agg(F.max_by("op", "id").alias("op")).filter("op <> 'D'")
    return rows.join(last.select(F.col("row_id").alias(key)), key, "left_semi")
