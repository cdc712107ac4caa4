"""Session defaults and the shared working folder.

Anything that must outlive a stage is written under the folder that the cluster names in
``spark.checkpoint.dir``; a folder of our own is used only where that setting is absent (tests, local runs).
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FALLBACK_DIR = os.path.join(tempfile.gettempdir(), "tessella-shared")
#: Session setting: partitions over which a scan is spread before a costly map. Unset, a scan keeps its own; set it where
#: tables lie in few, unsplittable files. The same at every size of input.
SCAN_PARTITIONS = "spark.tessella.scan.partitions"


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "tessella") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TESSELLA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config(SCAN_PARTITIONS, cores if cores.isdigit() else str(os.cpu_count()))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one where that is unset and there is one machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{FALLBACK_DIR}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessella/{_run(spark)}/{name}-{uuid.uuid4().hex}"


def _run(spark: SparkSession) -> str:
    """This application's folder; it goes when the application ends in good order (after a crash it stays until the shared folder is cleaned)."""
    sc = spark.sparkContext
    run = getattr(sc, "_tessella_run", None)
    if run is None:
        run = sc._tessella_run = f"run-{uuid.uuid4().hex}"
        import atexit

        atexit.register(_forget, spark, f"{shared_dir(spark)}/tessella/{run}")
    return run


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        delete(spark, path)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str, keep: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs no rerun.

    The folder is added to `keep`, whose owner may delete it before the application ends. by: columns to partition the files by."""
    path = fresh_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    if keep is not None:
        keep.append(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    return read.select(*df.columns) if by else read


class Staging:
    """Base of operators whose tables share staged parts; `close` deletes them once their results have been read or written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._kept = spark, []

    def stage(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        return staged(df, name, self._kept, by)

    def close(self) -> None:
        delete(self.spark, *self._kept)
        self._kept.clear()

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not share the driver's sys.path (zip once per context)."""
    import zipfile

    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(sc, "_tessella_shipped", False):
        return
    sc._tessella_shipped = True
    folder = tempfile.mkdtemp(prefix="tessella-")  # read by the driver's file server only
    at = os.path.join(folder, "tessella.zip")
    with zipfile.ZipFile(at, "w") as z:
        for inside, _, files in os.walk(os.path.join(root, "tessella")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(inside, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(at)
    import atexit
    import shutil

    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """Before a costly map: over as many partitions as the session's setting says, or as they are where it is unset."""
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df
