"""Readers and writers beside the tables: binary uploads, JSON, CSV manifests, text corpora with their tables."""

from __future__ import annotations

import hashlib
import importlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, staged

#: Uploads must begin with this and be no larger.
PDF_MAGIC, MAX_BYTES = b"%PDF-", 100 * 1024 * 1024
# Columns of the manifest file.
MANIFEST = (
    "contract_id string, language string, template_family string, agreement_type string, document_title string, canonical_path string, canonical_sha256 string, "
    "actual_pages int, pdf_path string, pdf_sha256 string, used_by_scenario_ids string, scenario_roles string"
)


def uploads(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, content and a verdict (OK, EMPTY, TOO_LARGE, NOT_PDF) of uploaded files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return df.withColumn("verdict", upload_verdict(F.col("content"))).select("path", "length", "content", "verdict")


def upload_verdict(content: Column) -> Column:
    n = F.coalesce(F.length(content), F.lit(0))
    return F.when(n == 0, "EMPTY").when(n > MAX_BYTES, "TOO_LARGE").when(F.substring(content, 1, 5) != F.lit(PDF_MAGIC), "NOT_PDF").otherwise("OK")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def markdown_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """path, row_no, cells of the pipe tables of Markdown texts (rules between head and body left out)."""
    lines = df.select("path", F.posexplode(F.split(text, "\r?\n")).alias("row_no", "line")).filter(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    return lines.select("path", "row_no", cells.alias("cells"))


def stored_path(root: str, contract: int, history: int) -> str:
    """Place of a file in the store; anything that would lead out of the root is refused."""
    at = os.path.normpath(os.path.join(root, str(contract), f"{history}.pdf"))
    if not at.startswith(os.path.normpath(root) + os.sep) or not re.fullmatch(r"\d+", str(contract)) or not re.fullmatch(r"\d+", str(history)):
        raise ValueError(f"outside the store: {contract}/{history}")
    return at


def named_function(name: str):
    """The function 'module:function' names (for plug-in extractors and retrievers)."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"expected module:function, got {name!r}")
    return getattr(importlib.import_module(module), attribute)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def yaml_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a small YAML file (a list, or a mapping of names to records whose name becomes `name`), for dimensions.
    Needs a YAML parser; without one an ImportError says so."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    rows = [{"name": k, **v} for k, v in found.items()] if isinstance(found, dict) else list(found or [])
    return spark.createDataFrame([{k: v for k, v in r.items() if k in schema} for r in rows], schema)


def store(df: DataFrame, root: str) -> DataFrame:
    """Write the content of (contract_id, history_id, content) to {root}/{contract}/{history}.pdf, a folder all executors
    share, and give path, sha256 and size of each. A file is written beside its place and renamed, so that a repeated task does no harm."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, h, content in zip(*(x.to_pylist() for x in b.columns), strict=True):
                at = stored_path(root, c, h)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                part = f"{at}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(content or b"")
                os.replace(part, at)
                rows.append((at, hashlib.sha256(content or b"").hexdigest(), len(content or b"")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "sha256", "size"])

    return df.select("contract_id", "history_id", "content").mapInArrow(run, "path string, sha256 string, size long")


def register_uploads(files: DataFrame, path: str) -> DataFrame:
    """Take over uploads that pass their checks: blobs first, then a queued job for each, under {path}/blob and {path}/job.
    The id of an upload is the digest of its content, so that the same content comes in once; gives the new jobs."""
    spark = files.sparkSession
    good = files.filter("verdict = 'OK'").select(F.sha2("content", 256).alias("tmpid"), "path", "content", F.length("content").alias("size")).dropDuplicates(["tmpid"])
    try:
        known = spark.read.parquet(f"{path}/job").select("tmpid")
        good = good.join(known, "tmpid", "left_anti")
    except Exception:  # noqa: BLE001 - nothing has been taken over yet
        pass
    new = staged(good, "uploads")
    append(new, f"{path}/blob")
    jobs = new.select("tmpid", F.lit("QUEUED").alias("status"), F.lit(0).alias("attempts"))
    append(jobs, f"{path}/job")
    return jobs


def chunk_rows(df: DataFrame, key: str, payload: str) -> DataFrame:
    """The rows of a JSON list of chunks, one per element with its place; elements that are no objects keep theirs."""
    items = df.select(key, F.posexplode(F.from_json(payload, "array<string>")).alias("place", "c")).filter(F.col("c").startswith("{"))
    return items.select(key, "place", F.from_json("c", "chunk_id string, clause_no string, text string, page_start int, page_end int").alias("c")).select(key, "place", "c.*")
