"""Vector and score functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def minmax_over_all(df: DataFrame, score: str, out: str, equal: float = 1.0) -> DataFrame:
    """Scale a score by its least and greatest value of all rows (one aggregate row, not an unpartitioned window)."""
    ends = df.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    scaled = F.when(F.col("__hi") == F.col("__lo"), F.lit(equal)).otherwise((F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("__lo", "__hi")


def minmax_within(score: str, *keys: str, equal: float = 0.0) -> Column:
    w = W.partitionBy(*keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi == lo, F.lit(equal)).otherwise((F.col(score) - lo) / (hi - lo))


def hybrid(lexical: Column, semantic: Column, weight: float = 0.5) -> Column:
    return (1 - weight) * lexical + weight * F.coalesce(semantic, F.lit(0.0))


def logistic(x: Column, middle: float = 4.0, scale: float = 3.0) -> Column:
    return 1 / (1 + F.exp(-(x - middle) / scale))


#: Rows and queries that meet in one task.
ROWS_BLOCK, QUERIES_BLOCK = 20_000, 5_000


def block_search(df: DataFrame, queries: Column, k: int) -> DataFrame:
    """id, other, place: the k rows of the greatest cosine of each row for which `queries` (a condition on id) holds, exactly.

    df has id and embedding, all of one length and none zero. Every block of rows meets every block of queries once and
    hands on the k best of each query; ties go to the smaller id."""
    n, q = (d.count() for d in (df, df.filter(queries)))
    rb, qb = max(1, -(-n // ROWS_BLOCK)), max(1, -(-q // QUERIES_BLOCK))
    block = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows, asked = df.select("id", "embedding", block(rb, 21).alias("rb"), every(qb).alias("qb")), df.filter(queries).select("id", "embedding", every(rb).alias("rb"), block(qb, 22).alias("qb"))

    def meet(_key, a: pa.Table, b: pa.Table) -> pa.Table:
        read = lambda t: (t.column("id").to_numpy(), np.array(t.column("embedding").to_pylist(), np.float64).reshape(t.num_rows, -1))
        out = []
        if a.num_rows and b.num_rows:
            (ids, x), (asks, y) = read(a), read(b)
            order = np.argsort(ids)
            ids, x = ids[order], x[order] / np.linalg.norm(x[order], axis=1, keepdims=True)
            for i, v in zip(asks, y / np.linalg.norm(y, axis=1, keepdims=True), strict=True):
                cos = x @ v
                cos[ids == i] = -2
                top = np.argsort(-cos, kind="stable")[: k + 1]
                top = top[ids[top] != i][:k]
                out.append((np.full(len(top), i), ids[top], cos[top]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"id": pa.array(cols[0], pa.int64()), "other": pa.array(cols[1], pa.int64()), "cosine": pa.array(cols[2], pa.float64())})

    found = rows.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInArrow(meet, "id long, other long, cosine double")
    w = W.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("id", "other", "place")
