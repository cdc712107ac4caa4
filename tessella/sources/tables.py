"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "content_asset", "contract", "contract_history", "rights_grant", "contract_chunk", "bundle_chunk", "chunk_stats",
    "extract_result", "change_log", "mix_target",
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table, optionally only some of its columns (the scan reads no others)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views for spark.sql; a missing table is skipped."""
    for name in names or TABLES:
        try:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        except Exception:  # noqa: BLE001 - a data directory need not hold every table
            continue
