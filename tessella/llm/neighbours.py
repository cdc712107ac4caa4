"""The k most similar vectors of every vector (problem 7), by a permutation index.

A sample of the vectors serves as pivots; their number grows with the root of the number of vectors, so that the
inverted files, of which there is one per pivot, grow with the root as well and each fits a task. Every vector is
represented by the order in which it sees its nearest pivots and is posted, with that order, in the inverted files of
all of them. Two similar vectors see nearly the same pivots first and so meet in an inverted file. There the others of
the file are ranked by the footrule distance of the orders (places beyond the prefix count as the last); those in the
nearest share of the file are compared by the cosine of vectors rounded to 8 bits, which is what the files hold. The
best of all files are reranked by the exact cosine, for which only the vectors in question are read again.
A file that sampling left large is laid out in parts: each part ranks its own vectors against the whole file, so the
work of no file hangs on one task. All vectors are indexed; `nearest` asks for all of them, `search` for those of a
stated query set, over the same files.

Exact copies of a vector are one class: its representative is indexed, the copies come back in at the end, each with the
k smallest ids among the most similar (ties of the cosine go to the smaller id).

Recall is set by the number of pivots and postings. NEAR suits neighbours with a cosine of 0.9 or so, FAR those that are
nearly orthogonal to each other (see the README for measured recall of both).

Defined results: vectors that are null, all zero, of another length or hold NaN, infinity or null take no part; repeated
rows of an id count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import ship, staged


@dataclass(frozen=True)
class Index:
    """pivots: how many times the root of the number of vectors; postings: files a vector is posted in; prefix: places
    of the order that the footrule distance looks at; share: the part of a file whose cosine is found."""

    pivots: float
    postings: int
    prefix: int
    share: float


NEAR = Index(pivots=4, postings=5, prefix=8, share=0.25)
FAR = Index(pivots=8, postings=24, prefix=10, share=0.5)
#: Candidates reranked exactly beyond k, and the error allowed for the rounded cosine.
SPARE, ROUNDING = 3, 0.02
#: Vectors of a file that one part ranks, and pairs held in memory at once.
PART, PAIRS = 4096, 1 << 21
#: One vector in so many is read to see how large the files are.
SAMPLED = 64
POSTING_SCHEMA = "file int, id long, asked boolean, seen binary, vec binary"


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """id and embedding of the vectors that can be compared."""
    named = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return named.filter(F.col("id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == dim) & ~bad & some)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps the squares of very small and large values in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def orders(x: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each unit vector, nearest first.

    The nearest lie in the blocks of pivots with the greatest maxima, so only these blocks are searched."""
    places, width = min(places, len(pivots)), 32
    out = np.empty((len(x), places), np.int32)
    blocks = -(-len(pivots) // width)
    for a in range(0, len(x), step := max(1, (1 << 23) // (blocks * width))):
        near = np.full((len(x[a : a + step]), blocks * width), -9, np.float32)
        near[:, : len(pivots)] = x[a : a + step].astype(np.float32) @ pivots.T
        if blocks > places:
            best = np.argpartition(-near.reshape(len(near), blocks, width).max(axis=2), places - 1, axis=1)[:, :places]
            of = (best[:, :, None] * width + np.arange(width)).reshape(len(near), -1)
            near = np.take_along_axis(near, of, axis=1)
        else:
            of = np.broadcast_to(np.arange(blocks * width), near.shape)
        first = np.argpartition(-near, places - 1, axis=1)[:, :places]
        rank = np.argsort(-np.take_along_axis(near, first, axis=1), axis=1, kind="stable")
        out[a : a + step] = np.take_along_axis(of, np.take_along_axis(first, rank, axis=1), axis=1)
    return out


def footrule_nearness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L(L+1)/2 minus half the footrule distance of order prefixes: the sum over shared pivots of L - the later place."""
    size = a.shape[1]
    out = np.zeros((len(a), len(b)), np.int16)
    columns = np.ascontiguousarray(b.T)
    for i in range(size):
        own = np.ascontiguousarray(a[:, i, None])
        for j in range(size):
            out += (own == columns[j]).view(np.int8) * np.int8(size - max(i, j))
    return out


def rank_file(ids: np.ndarray, asked: np.ndarray, seen: np.ndarray, x: np.ndarray, k: int, least: float, index: Index, apart: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """id, neighbour and cosine of the k best of each vector that is asked for, in one inverted file. apart: those asked for are no neighbours themselves."""
    n, rows = len(ids), np.flatnonzero(asked)
    if n < 2 or not len(rows):
        return
    own = np.unique(seen[:, : index.prefix], return_inverse=True)[1].reshape(n, -1)
    own = own.astype(np.uint16 if own.max() < 1 << 16 else np.int32)  # pivots by their place among those of the file
    cut = max(k + 1, math.ceil(index.share * n))
    for a in range(0, len(rows), step := max(1, PAIRS // n)):
        at = rows[a : a + step]
        cos = x[at] @ x.T
        if cut < n:
            near = footrule_nearness(own[at], own)
            if apart:
                near[:, asked] = -1
            cos[near < np.partition(near, n - cut, axis=1)[:, n - cut, None]] = -2
        cos[np.arange(len(at)), at] = -2
        if apart:
            cos[:, asked] = -2
        c = min(k, n - 1)
        top = np.argpartition(-cos, c - 1, axis=1)[:, :c]
        best = np.take_along_axis(cos, top, axis=1)
        i, j = np.nonzero(best >= max(least, -1.5))
        yield ids[at[i]], ids[top[i, j]], best[i, j]


def _post(pivots: np.ndarray, dim: int, index: Index):
    """The postings of (id, embedding, asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                raw = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
                x = unit(raw)
                seen = orders(x, pivots, max(index.postings, index.prefix))
                rounded = np.round(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
                m = min(index.postings, seen.shape[1])
                copies = pa.array(np.repeat(np.arange(len(raw)), m))
                kept = np.ascontiguousarray(seen[:, : index.prefix])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seen[:, :m].reshape(-1)), b.column(0).take(copies), b.column(2).take(copies),
                        pa.array([r.tobytes() for r in kept], pa.binary()).take(copies), pa.array([r.tobytes() for r in rounded], pa.binary()).take(copies),
                    ],
                    names=["file", "id", "asked", "seen", "vec"],
                )

    return run


def _rank(dim: int, k: int, least: float, index: Index, apart: bool = False):
    """Of rows sorted by file and part: one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts: list) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            key = t.column("id").to_numpy()
            if apart:
                key = np.stack([t.column("asked").to_numpy(), key], axis=1)
            first = np.unique(key, axis=0, return_index=True)[1]  # repeated rows once
            pick = t.take(pa.array(first))
            ids = pick.column("id").to_numpy()
            seen = np.frombuffer(b"".join(pick.column("seen").to_pylist()), np.int32).reshape(len(ids), -1)
            x = unit(np.frombuffer(b"".join(pick.column("vec").to_pylist()), np.int8).reshape(-1, dim)).astype(np.float32)
            asked = pick.column("asked").to_numpy()
            for a, b, c in rank_file(ids, asked, seen, x, k, least, index, apart):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["id", "other", "cosine"])

        held: list = []
        last = None
        for batch in batches:
            place = batch.column(0).to_numpy().astype(np.int64) << 20 | batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b <= a:
                    continue
                if held and last != place[a]:
                    yield from emit(held)
                    held = []
                last = place[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from emit(held)

    return run


def sample_pivots(vectors: DataFrame, count: int, n: int) -> np.ndarray:
    """A sample as unit vectors: the rows with the smallest hash of their id. n: how many rows there are; a
    threshold on the hash lets about twice the sample through, so that tasks do not each send a whole sample."""
    h = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40))
    some = vectors.withColumn("h", h).filter(F.col("h") <= int(min(1.0, (2.0 * count + 50) / n) * (1 << 40)))
    rows = some.orderBy("h", "id").limit(count).select("embedding").collect()
    return unit(np.array([r[0] for r in rows], np.float32)).astype(np.float32)


def _fewest(k: int):
    """The k + 1 smallest ids of each class in each batch, so that a class with very many copies leaves a task as a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pandas().sort_values("id")
            yield pa.RecordBatch.from_pandas(d[d.groupby("rep").cumcount() <= k], preserve_index=False)

    return run


def nearest(
    df: DataFrame, key: str = "id", vector: str = "embedding", dim: int = 64, k: int = 5, least: float = -1.5, pivots: int | None = None, index: Index | None = None,
    queries: Column | None = None,
) -> DataFrame:
    """id, other, cosine: the k most similar others of every vector, of those with a cosine of at least `least`.

    index: NEAR where `least` is 0.8 or more, else FAR. queries: a condition on id; only rows for which it holds are asked for.
    """
    spark = df.sparkSession
    ship(spark)
    index = index or (NEAR if least >= 0.8 else FAR)
    wanted = queries if queries is not None else F.lit(True)
    vectors = usable(df, key, vector, dim)
    hashed = vectors.select("id", F.xxhash64("embedding").alias("h1"), F.xxhash64("embedding", F.lit(5)).alias("h2"))
    groups = hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.max(wanted).alias("asked"))
    n = groups.count()
    none = spark.createDataFrame([], "id long, other long, cosine double")
    if n == 0:
        return none
    # Joins of data-sized tables are hinted, as their stored size says little about their rows.
    copied = staged(groups.filter("rep < last"), "copies")
    members = staged(hashed.join(copied.hint("merge"), ["h1", "h2"]).select("id", "rep", "asked").distinct(), "members")
    reps = vectors.join(members.filter("id <> rep").select("id").hint("merge"), "id", "left_anti")
    if queries is not None:  # a class is asked for if one of its members is
        reps = reps.join(members.filter("id = rep").select("id", F.col("asked").alias("own")).hint("merge"), "id", "left").select("id", "embedding", F.coalesce("own", wanted).alias("asked"))
    else:
        reps = reps.withColumn("asked", F.lit(True))
    p = sample_pivots(vectors, pivots or max(32, math.ceil(index.pivots * math.sqrt(n))), n)
    post = lambda rows: rows.select("id", "embedding", "asked").mapInArrow(_post(p, dim, index), POSTING_SCHEMA)
    # Parts of each file, by a sample of the postings: enough for each to rank some PART vectors. At most as many rows as pivots.
    sample = post(reps.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SAMPLED)) == 0))
    sizes = sample.groupBy("file").agg(F.ceil(F.count("*") * SAMPLED / PART).cast("int").alias("parts")).filter("parts > 1")
    laid = post(reps).join(F.broadcast(sizes), "file", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    laid = laid.select("file", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", (F.col("asked") & (F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")) == F.col("part"))).alias("asked"), "seen", "vec")
    found = laid.repartition("file", "part").sortWithinPartitions("file", "part").mapInArrow(_rank(dim, k + SPARE, least - ROUNDING, index), "id long, other long, cosine float")
    rough = staged(_top(found.groupBy("id", "other").agg(F.max("cosine").alias("cosine")), k + SPARE).select("id", "other"), "rough")
    asked = staged(rough.select("id").union(rough.select("other")).distinct(), "asked")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    read = vectors.join(asked.hint("merge"), "id", "left_semi").dropDuplicates(["id"]).withColumnRenamed("embedding", "v").withColumn("norm", F.sqrt(dot("v", "v")))
    exact = rough.join(read.hint("merge"), "id").join(read.select(F.col("id").alias("other"), F.col("v").alias("w"), F.col("norm").alias("norm_w")).hint("merge"), "other")
    exact = exact.select("id", "other", (dot("v", "w") / (F.col("norm") * F.col("norm_w"))).alias("cosine")).filter(F.col("cosine") >= least)
    best = _top(exact, k)
    # Copies: each member has what its representative has, and the other members of its class.
    w = W.partitionBy("rep").orderBy("id")
    few = members.select("rep", "id").mapInArrow(_fewest(k), "rep long, id long")
    few = few.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1).select(F.col("rep"), F.col("id").alias("member"))
    mine = members.filter(wanted)
    spread = best.join(mine.select(F.col("rep").alias("id"), F.col("id").alias("own")), "id", "left").select(F.coalesce("own", "id").alias("id"), "other", "cosine")
    spread = spread.join(few.select(F.col("rep").alias("other"), "member"), "other", "left").select("id", F.coalesce("member", "other").alias("other"), "cosine")
    inside = mine.join(few, "rep").filter("id <> member").select("id", F.col("member").alias("other"), F.lit(1.0).alias("cosine")).filter(F.lit(1.0 >= least))
    return _top(spread.unionByName(inside).filter(wanted), k)


def search(df: DataFrame, queries: Column, key: str = "id", vector: str = "embedding", dim: int = 64, k: int = 5, index: Index = FAR) -> DataFrame:
    """id, other, cosine of the k most similar rows of each row for which `queries` (a condition on id) holds, over the
    same inverted files: only the files of the queries' pivots are looked up."""
    return nearest(df, key, vector, dim, k, queries=queries, index=index)


class StoredIndex:
    """The index in a folder: pivots, postings and vectors. It is made once, grows by `add` and answers queries from
    outside: only the inverted files of the queries' pivots are read. Ids are taken to be unique over all that is added."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/pivots").orderBy("no").collect()  # as many as pivots
        self.pivots = np.array([r.v for r in rows], np.float32)
        self.dim, self.index = self.pivots.shape[1], Index(rows[0].pivots, rows[0].postings, rows[0].prefix, rows[0].share)

    @classmethod
    def build(cls, df: DataFrame, path: str, key: str = "id", vector: str = "embedding", dim: int = 64, index: Index = FAR) -> StoredIndex:
        spark = df.sparkSession
        vectors = usable(df, key, vector, dim)
        n = vectors.count()
        if n == 0:
            raise ValueError("an index needs at least one usable vector")
        p = sample_pivots(vectors, max(32, math.ceil(index.pivots * math.sqrt(n))), n)
        rows = [(i, v.tolist(), float(index.pivots), index.postings, index.prefix, float(index.share)) for i, v in enumerate(p)]
        spark.createDataFrame(rows, "no int, v array<float>, pivots double, postings int, prefix int, share double").write.parquet(f"{path.rstrip('/')}/pivots")
        stored = cls(spark, path)
        stored.add(df, key, vector)
        return stored

    def _posted(self, vectors: DataFrame, asked: bool) -> DataFrame:
        ship(self.spark)
        return vectors.select("id", "embedding", F.lit(asked).alias("asked")).mapInArrow(_post(self.pivots, self.dim, self.index), POSTING_SCHEMA)

    def add(self, df: DataFrame, key: str = "id", vector: str = "embedding") -> None:
        """Index further vectors; repeated rows count once."""
        vectors = usable(df, key, vector, self.dim).dropDuplicates(["id"])
        vectors.write.mode("append").parquet(f"{self.path}/vectors")
        self._posted(vectors, False).repartition("file").sortWithinPartitions("file").write.mode("append").parquet(f"{self.path}/postings")

    def search(self, queries: DataFrame, key: str = "id", vector: str = "embedding", k: int = 5) -> DataFrame:
        """id (of the query), other, cosine of the k most similar indexed vectors."""
        asks = usable(queries, key, vector, self.dim).dropDuplicates(["id"])
        posted = self._posted(asks, True)
        # Files of many queries are laid out in parts. As many rows as pivots at most.
        sizes = posted.groupBy("file").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        held = self.spark.read.schema(POSTING_SCHEMA).parquet(f"{self.path}/postings").join(F.broadcast(sizes), "file")
        held = held.select("file", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "asked", "seen", "vec")
        own = posted.join(F.broadcast(sizes), "file").select("file", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int").alias("part"), "id", "asked", "seen", "vec")
        found = held.unionByName(own).repartition("file", "part").sortWithinPartitions("file", "part").mapInArrow(_rank(self.dim, k + SPARE, -1.5, self.index, apart=True), "id long, other long, cosine float")
        rough = _top(found.groupBy("id", "other").agg(F.max("cosine").alias("cosine")), k + SPARE).select("id", "other")
        vectors = self.spark.read.parquet(f"{self.path}/vectors").select(F.col("id").alias("other"), F.col("embedding").alias("w"))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        both = rough.join(asks.hint("merge"), "id").join(vectors.hint("merge"), "other")
        return _top(both.select("id", "other", (dot("embedding", "w") / F.sqrt(dot("embedding", "embedding") * dot("w", "w"))).alias("cosine")), k)


def _top(df: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("place")


def pairs(found: DataFrame) -> DataFrame:
    """id_a < id_b of every pair of which one is among the nearest of the other."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
