"""Stages that call a model from outside: vectors for texts, readings of pages, extraction. The models are functions; the
stages around them are Spark's. Nothing here holds a model of its own."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ..sources.files import named_function

#: What stands before a text when its vector is asked for, and texts per call.
PASSAGE, QUERY, BATCH = "passage: ", "query: ", 32


def embed(df: DataFrame, text: str, model: Callable[[list[str]], np.ndarray] | str, out: str = "embedding", prefix: str = PASSAGE, wanted: Column | None = None) -> DataFrame:
    """df with a vector of length one for each text, rounded to 6 places; null where `wanted` does not hold, or the text is null or blank.

    model: a function from a list of texts to rows of numbers, or 'module:function'. It is called per Arrow batch with at most BATCH texts."""
    ship(df.sparkSession)
    name = f"__ask_{text}"
    asked = df.withColumn(name, F.when((F.trim(text) != "") & (wanted if wanted is not None else F.lit(True)), F.col(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = named_function(model) if isinstance(model, str) else model
        for b in batches:
            ask = b.column(b.schema.get_field_index(name)).to_pylist()
            at = [i for i, x in enumerate(ask) if x is not None]
            got: list = [None] * len(ask)
            for k in range(0, len(at), BATCH):
                v = np.asarray(call([prefix + ask[i] for i in at[k : k + BATCH]]), np.float64)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                for i, row in zip(at[k : k + BATCH], np.round(v / np.where(size > 0, size, 1), 6), strict=True):
                    got[i] = row.astype(np.float32).tolist()
            keep = [i for i, n in enumerate(b.schema.names) if n != name]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(got, pa.list_(pa.float32()))], names=[*[b.schema.names[i] for i in keep], out])

    fields = [f for f in df.schema.fields if f.name != out]
    return asked.select(*[f.name for f in fields], name).mapInArrow(run, T.StructType([*fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def read_pages(pages: DataFrame, engines: Sequence[Callable[[bytes, str | None], str]], image: str = "image", text: str = "text", route: str = "route", lang: str = "lang") -> DataFrame:
    """pages with the text to go on with and its source: OCR takes the longest reading of the engines, VERIFY that or the
    text layer, whichever is longer; other pages are left as they are. Engines get the image and the language if it is Korean."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def read(images, langs):
        return images.combine(langs, lambda i, g: None if i is None else max((e(bytes(i), "ko" if g == "ko" else None) or "" for e in engines), key=len, default=""))

    seen = F.when(F.col(route).isin("OCR", "VERIFY"), read(image, lang))
    better = (F.col(route) == "OCR") | (F.char_length("__seen") > F.char_length(F.coalesce(text, F.lit(""))))
    taken = F.coalesce(better & F.col("__seen").isNotNull(), F.lit(False))
    df = pages.withColumn("__seen", seen)
    return df.withColumn("source", F.when(taken, "OCR").otherwise("TEXT_LAYER")).withColumn(text, F.when(taken, F.col("__seen")).otherwise(F.col(text))).drop("__seen")


def extract(hits: DataFrame, extractor: Callable[[str], str] | str, key: str, prompt: str, out: str = "payload") -> DataFrame:
    """key and the extractor's answer to each prompt. An extractor that raises gives null and its reason, and no other row is lost."""
    ship(hits.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = named_function(extractor) if isinstance(extractor, str) else extractor
        for b in batches:
            answers, reasons = [], []
            for p in b.column(1).to_pylist():
                try:
                    answers.append(call(p) if p is not None else None)
                    reasons.append(None)
                except Exception as e:  # noqa: BLE001 - a model may fail in any way
                    answers.append(None)
                    reasons.append(f"{type(e).__name__}: {e}".split("\n")[0][:200])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string()), pa.array(reasons, pa.string())], names=[key, out, "reason"])

    return hits.select(key, prompt).mapInArrow(run, T.StructType([hits.schema[key], T.StructField(out, T.StringType()), T.StructField("reason", T.StringType())]))


def chain(df: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One stage after the other: retrieval, extraction, checks, projection."""
    for stage in stages:
        df = stage(df)
    return df


def from_environment(variable: str, makers: dict[str, Callable], default: str):
    """What the environment variable names, made by its maker; an unknown name is an error."""
    name = os.environ.get(variable, default)
    if name not in makers:
        raise ValueError(f"{variable}: {name!r} is none of {sorted(makers)}")
    return makers[name]()
