"""Rebuilding tables from a feed of inserts, updates and deletes (problem 3).

Every change becomes a few slots of its row: slot '' holds the last insert or delete, slot 'u' the last update and one
slot 'c<column>' the last value set for each column. All slots obey one rule, an upsert whose conflict branch fires only
for a higher sequence: INSERT ... ON CONFLICT DO UPDATE ... WHERE (new sequence > stored sequence). The rule is
commutative and idempotent, so repeated and out-of-order deliveries need no sorting and partial results of different
tasks can be merged by the same statement. It runs in an embedded DuckDB, first in each map task over the task's own
rows (a row with a third of all changes leaves the task as a handful of slots) and then once per bucket of rows.
Deletes stay as tombstones until all slots of a row have met; only then is it decided whether the row exists:
it does if its last insert or delete is an insert, and its last effective change is that insert or the last update after
it. There are as many buckets as it takes for each to hold some BUCKET_SLOTS slots, by a count over the whole feed; an
embedded database that outgrows its memory spills to the executor's own scratch space. All buckets are exported to the
folder of a new version, which is published by one new pointer file (see `publish`).

Defined results: changes without id, row id, table or valid op are void; the same id counts once (of copies that differ,
the greatest image); an update before any insert is void; null images set nothing; an empty log gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, fresh_path, ship

SLOT_SCHEMA = "table_name string, row_id long, slot string, seq long, op string, val string"
STATE_SCHEMA = "table_name string, row_id long, id long, row_image string"
#: Rows of slots after which a map task hands its state on and begins anew; bounds the memory of an embedded database.
FLUSH_SLOTS = 400_000
#: Slots that a bucket should hold, and versions of a published state that stay readable.
BUCKET_SLOTS, VERSIONS_KEPT = 300_000, 3

_SCHEMA_ARROW = pa.schema([("table_name", pa.string()), ("row_id", pa.int64()), ("slot", pa.string()), ("seq", pa.int64()), ("op", pa.string()), ("val", pa.string())])

_DDL = "CREATE TABLE state (table_name VARCHAR, row_id BIGINT, slot VARCHAR, seq BIGINT, op VARCHAR, val VARCHAR, PRIMARY KEY (table_name, row_id, slot))"

#: The slots that the changes of a batch write.
_SLOTS = """
WITH ok AS (SELECT table_name, row_id, seq, op, CASE WHEN json_valid(image) THEN image::JSON END AS j FROM changes),
     keyed AS (SELECT *, unnest(json_keys(j)) AS k FROM ok WHERE op <> 'D' AND json_type(j) = 'OBJECT')
SELECT table_name, row_id, CASE op WHEN 'U' THEN 'u' ELSE '' END AS slot, seq, op, '' AS val FROM ok
UNION ALL
SELECT table_name, row_id, 'c' || k, seq, op, coalesce(json_extract(j, '/' || replace(replace(k, '~', '~0'), '/', '~1'))::VARCHAR, 'null') FROM keyed
"""

#: In one statement a key may conflict once, so a batch first keeps its own greatest row of each slot.
_UPSERT = """
INSERT INTO state
SELECT table_name, row_id, slot, m.seq, m.op, m.val
FROM (SELECT table_name, row_id, slot, max({'seq': seq, 'op': coalesce(op, ''), 'val': coalesce(val, '')}) AS m FROM batch GROUP BY ALL)
ON CONFLICT DO UPDATE SET seq = excluded.seq, op = excluded.op, val = excluded.val
WHERE (excluded.seq, excluded.op, excluded.val) > (state.seq, state.op, state.val)
"""

_EXPORT = """
WITH base AS (SELECT table_name, row_id, seq FROM state WHERE slot = '' AND op = 'I'),
     upd AS (SELECT table_name, row_id, seq FROM state WHERE slot = 'u'),
     cell AS (SELECT s.table_name, s.row_id, '{' || string_agg(to_json(substr(s.slot, 2))::VARCHAR || ':' || s.val, ',' ORDER BY s.slot) || '}' AS row_image
              FROM state s JOIN base b USING (table_name, row_id) WHERE s.slot[1] = 'c' AND s.seq >= b.seq GROUP BY ALL)
SELECT b.table_name, b.row_id, greatest(b.seq, coalesce(u.seq, b.seq)) AS id, coalesce(c.row_image, '{}')::VARCHAR AS row_image
FROM base b LEFT JOIN upd u USING (table_name, row_id) LEFT JOIN cell c USING (table_name, row_id)
"""


@contextlib.contextmanager
def _database():
    """An empty embedded database; what it spills goes to the task's scratch space and is removed with it."""
    import warnings

    import duckdb

    warnings.filterwarnings("ignore", message="Arrow output")
    scratch = tempfile.mkdtemp(prefix="slots-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": scratch})
    try:
        db.execute(_DDL)
        yield db
    finally:
        db.close()
        shutil.rmtree(scratch, ignore_errors=True)


def _upsert_all(db, batch: pa.RecordBatch) -> None:
    """Upsert a batch of changes (they have an image) or of slots."""
    rows = pa.Table.from_batches([batch])
    if "image" in batch.schema.names:
        db.register("changes", rows)
        rows = db.execute(_SLOTS).to_arrow_table()
        db.unregister("changes")
    db.register("batch", rows)
    db.execute(_UPSERT)
    db.unregister("batch")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of a map task's own rows."""
    more = True
    while more:
        more = False
        with _database() as db:
            for batch in batches:
                _upsert_all(db, batch)
                if db.execute("SELECT count(*) FROM state").fetchall()[0][0] >= FLUSH_SLOTS:
                    more = True
                    break
            yield from _select(db, "SELECT * FROM state", _SCHEMA_ARROW)


def _select(db, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in db.execute(sql).to_arrow_reader(10_000):
        yield from pa.Table.from_batches([batch]).cast(schema).to_batches()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Upsert the slots of one bucket and export the rows that exist at the end."""
    schema = pa.schema([("table_name", pa.string()), ("row_id", pa.int64()), ("id", pa.int64()), ("row_image", pa.string())])
    with _database() as db:
        for batch in batches:
            _upsert_all(db, batch)
        yield from _select(db, _EXPORT, schema)


def table_key(c: Column) -> Column:
    """Lower case without schema, quotes or surrounding blanks; null if nothing is left."""
    s = F.regexp_replace(F.lower(c), r"(?U)[\s\p{Cf}\"`'\[\]]+", "")
    return F.nullif(F.element_at(F.split(s, r"\."), -1), F.lit(""))


def valid_changes(log: DataFrame) -> DataFrame:
    """The changes that can take effect: table_name, row_id, seq, op, image."""
    op = F.upper(F.regexp_replace("op", r"(?U)[\s\p{Cf}]+", ""))
    return log.select(
        table_key(F.col("table_name")).alias("table_name"), F.col("row_id").cast("long").alias("row_id"), F.col("id").cast("long").alias("seq"), op.alias("op"),
        F.col("row_image").alias("image"),
    ).filter(F.col("table_name").isNotNull() & F.col("row_id").isNotNull() & F.col("seq").isNotNull() & F.col("op").isin("I", "U", "D"))


def buckets_for(changes: DataFrame) -> int:
    """Buckets for valid changes: each change writes a slot of its own and one per column of its image."""
    columns = F.coalesce(F.size(F.expr("json_object_keys(image)")), F.lit(0))
    slots = changes.agg(F.sum(F.lit(1) + F.greatest(columns, F.lit(0)))).first()[0] or 0
    return max(1, -(-slots // BUCKET_SLOTS), changes.sparkSession.sparkContext.defaultParallelism)


def final_state(log: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows that exist after all changes: table_name, row_id, id of the last change that took effect, row_image (JSON)."""
    ship(log.sparkSession)
    valid = valid_changes(log)
    folded = valid.mapInArrow(_fold, SLOT_SCHEMA)
    return folded.repartition(buckets or buckets_for(valid), "table_name", "row_id").mapInArrow(_buckets, STATE_SCHEMA)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """The names of the pointer files, oldest first."""
    at, fs = _files(spark, f"{path}/_pointers")
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if not f.getPath().getName().startswith(".")) if fs.exists(at) else []


def published(spark: SparkSession, path: str) -> DataFrame:
    """The state published last at `path`."""
    pointers = _pointers(spark, path)
    if not pointers:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path}/{pointers[-1].partition('-')[2]}")


def publish(log: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Export every bucket to the folder of a new version and publish all at once by a pointer file.

    A pointer is an empty file whose name holds its number and the name of its version; the highest counts. Making one
    is a single atomic step on any store, and nothing a reader may be at is moved: the last VERSIONS_KEPT versions stay.
    Of two publications at a time both are whole, and the one with the higher name counts. Without `path` a new folder
    is published under the shared folder.
    """
    spark = log.sparkSession
    path = (path or fresh_path(spark, "state")).rstrip("/")
    version = f"v{uuid.uuid4().hex}"
    final_state(log, buckets).write.parquet(f"{path}/{version}")
    before = _pointers(spark, path)
    pointer, fs = _files(spark, f"{path}/_pointers/{int(before[-1].partition('-')[0]) + 1 if before else 1:012d}-{version}")
    fs.mkdirs(pointer.getParent())
    if not fs.createNewFile(pointer):
        raise OSError(f"cannot publish {pointer}")
    for old in before[: -(VERSIONS_KEPT - 1)]:
        delete(spark, f"{path}/_pointers/{old}", f"{path}/{old.partition('-')[2]}")
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path}/{version}")
