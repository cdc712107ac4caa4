"""Mixing sources to target weights (problem 9).

The tokens of each source are packed, one record after the other in a pseudorandom order, into blocks of a fixed number
of tokens. A source is to fill its target share of the total size (the tokens of all records of named sources), by whole
blocks and using no block more than `max_repeat` times; a source that runs out stays below its target and the report
says so. The blocks to use are spread over output shards by multinomial counts: the totals are halved again and again,
each half drawing its counts at random without replacement, so that every shard finds its own counts and its first
ordinals by itself and all shards together use exactly the totals. A source's ordinal k means pass k div blocks and,
in that pass, the block to which the pass's own pseudorandom permutation (a Feistel network with cycle walking) maps
k mod blocks. Slots and blocks are then joined by source and block number.

The mix is given by reference (which tokens of which record stand in which slot of which shard) or, by `tokens`, as ids. Offsets are prefix
sums in two levels, so no source is ever handled by one task; only per-source totals (as many rows as `mix_target`)
reach the driver.

Defined results: records without tokens, without source or of a source that is not named take no part; a source that
differs only in case, blanks or '-' for '_' is the same; repeated target rows count once (of differing ones, the largest
share); shares that do not sum to 1 are scaled; an empty corpus or no targets give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import ship, spread, Staging
from .bpe import default_vocabulary, encode, encoder

BLOCK_TOKENS = 512
SHARD_SLOTS = 512
#: Records whose offsets one task adds up.
BUCKET_DOCS = 50_000


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""), r"(?U)[\s\-‐-―]+", "_")


def count_tokens(df: DataFrame, text: str, keep: tuple[str, ...], path: str | None = None) -> DataFrame:
    """The kept columns and n_tokens of the text."""
    ship(df.sparkSession)
    path = path or default_vocabulary()
    df = df.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            counts, _ = enc.encode_batch(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts)], names=[*keep, "n_tokens"])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType())]))


# --- pseudorandom permutations and counts -----------------------------------------------------------------------------


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(key & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of indices under a pseudorandom permutation of 0..n-1."""
    if n <= 1:
        return np.zeros(len(index), np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():  # a value outside 0..n-1 walks on; the network's domain is less than 4n
        a, b = x[todo] >> np.uint64(half), x[todo] & low
        for r in range(4):
            a, b = b, a ^ (_mix(b, key * 4 + r) & low)
        x[todo] = a << np.uint64(half) | b
        todo[todo] = x[todo] >= n
    return x.astype(np.int64)


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of `take` things drawn without replacement are good, for numbers of any size.

    The distribution is log-concave, so a flat middle with exponential tails, scaled by the probability of its mode,
    lies above it (Devroye 1987, "A simple generator for discrete log-concave distributions")."""
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    mode = (take + 1) * (good + 1) // (good + bad + 2)
    log = lambda x: _log_choose(good, x) + _log_choose(bad, take - x)
    at_mode = log(mode)
    p = math.exp(at_mode - _log_choose(good + bad, take))
    flat = 1 + p / 2
    while True:
        y = rng.random() * flat / p if rng.random() <= flat / (1 + flat) else (flat + rng.standard_exponential()) / p
        x = mode + (math.floor(y + 0.5) if rng.random() < 0.5 else -math.floor(y + 0.5))
        if low <= x <= high and math.log(rng.random() or 1e-300) + min(0.0, flat - p * y) <= log(x) - at_mode:
            return x


def _draw(counts: np.ndarray, take: int, seed: tuple) -> np.ndarray:
    """How many of `take` slots drawn without replacement fall to each source: one source after the other, given those before."""
    rng, out = np.random.default_rng(seed), np.zeros_like(counts)
    rest, left = int(counts.sum()), min(take, int(counts.sum()))
    for i, n in enumerate(counts.tolist()):
        rest -= n
        out[i] = hypergeometric(rng, n, rest, left)
        left -= int(out[i])
    return out


def shard_counts(totals: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial counts of one shard given the totals, and the ordinal each source has reached before it."""
    lo, hi, have, before = 0, shards, totals.copy(), np.zeros_like(totals)
    size = int(totals.sum())
    share = lambda a, b: size * b // shards - size * a // shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _draw(have, share(lo, mid), (seed, lo, hi))
        if shard < mid:
            hi, have = mid, left
        else:
            lo, have, before = mid, have - left, before + left
    return have, before


# --- the operator -----------------------------------------------------------------------------------------------------


class Mixture(Staging):
    def __init__(self, docs: DataFrame, targets: DataFrame, path: str | None = None, block: int = BLOCK_TOKENS, seed: int = 1) -> None:
        spark = docs.sparkSession
        super().__init__(spark)
        self.block, self.seed = block, seed
        goal = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeat").cast("int").alias("repeat"))
        goal = goal.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("share", "repeat")).alias("m")).select("source", "m.share", "m.repeat")
        named = spread(docs.select(F.col("doc_id"), source_key(F.col("source")).alias("source"), "text")).join(goal.select("source"), "source", "left_semi")
        self.named, self.path = named, path
        self.sizes = self.stage(count_tokens(named, "text", ("doc_id", "source"), path).filter("n_tokens > 0"), "sizes")
        totals = self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
        self.plan = self._plan(goal.join(totals, "source", "left").orderBy("source").collect())

    def _plan(self, rows: list) -> pd.DataFrame:
        """Per source: tokens, blocks and slots."""
        p = pd.DataFrame([(r.source, r.share or 0.0, max(0, r.repeat or 0), r.tokens or 0, r.docs or 0) for r in rows], columns=["source", "share", "repeat", "tokens", "docs"])
        p["share"] /= p["share"].sum() or 1.0
        self.total = int(p["tokens"].sum())
        p["blocks"] = -(-p["tokens"] // self.block)
        wanted = p["share"] * self.total / (p["tokens"] / p["blocks"].clip(lower=1)).clip(lower=1)
        p["slots"] = np.minimum(np.floor(wanted + 0.5).astype("int64"), p["blocks"] * p["repeat"]).where(p["tokens"] > 0, 0)
        return p

    def blocks(self) -> DataFrame:
        """Pieces of records by block: source, block_no, seq (order in the block), doc_id, token_from, token_to."""
        per = max(1, -(-int(self.plan["docs"].sum()) // BUCKET_DOCS))
        h = F.xxhash64("doc_id", F.lit(self.seed))
        rows = self.sizes.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(per)))
        sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
        base = sums.withColumn("base", F.sum("s").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("source", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
        inner = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        placed = rows.withColumn("inner", inner).join(base, ["source", "bucket"]).withColumn("at", F.col("base") + F.col("inner"))
        b = self.block
        numbers = F.expr(f"sequence(at div {b}, (at + n_tokens - 1) div {b})")
        cut = placed.select("source", "doc_id", "n_tokens", "at", F.explode(numbers).alias("block_no"))
        lo = F.greatest(F.col("block_no") * b - F.col("at"), F.lit(0))
        hi = F.least((F.col("block_no") + 1) * b - F.col("at"), F.col("n_tokens"))
        return cut.select("source", "block_no", F.greatest(F.col("at") - F.col("block_no") * b, F.lit(0)).cast("int").alias("block_from"), "doc_id", lo.cast("int").alias("token_from"), hi.cast("int").alias("token_to"))

    def slots(self) -> DataFrame:
        """shard, slot, source, pass, block_no of every slot of the mix."""
        use = self.plan[self.plan["slots"] > 0]
        names, totals, blocks, seed = use["source"].tolist(), use["slots"].to_numpy(np.int64), use["blocks"].to_numpy(np.int64), self.seed
        shards = max(1, -(-int(totals.sum()) // SHARD_SLOTS)) if len(totals) else 0

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard in batch["id"].tolist():
                    have, before = shard_counts(totals, shards, shard, seed)
                    n = int(have.sum())
                    which = np.repeat(np.arange(len(have)), have)
                    k = np.arange(n) - np.repeat(np.cumsum(have) - have, have) + before[which]
                    turn, block = k // blocks[which], np.empty(n, np.int64)
                    for s in range(len(have)):
                        for t in np.unique(turn[which == s]):
                            own = (which == s) & (turn == t)
                            block[own] = permute(k[own] % blocks[s], int(blocks[s]), (seed * 1000003 + s) * 1000003 + int(t))
                    slot = permute(np.arange(n), n, seed * 7919 + shard)
                    yield pd.DataFrame({"shard": shard, "slot": slot.astype(np.int32), "source": [names[s] for s in which], "pass": turn.astype(np.int32), "block_no": block})

        schema = "shard long, slot int, source string, pass int, block_no long"
        return self.spark.range(shards).mapInPandas(run, schema)

    def mix(self) -> DataFrame:
        """The mix: shard, slot, block_from (place in the slot), source, pass, doc_id, token_from, token_to."""
        # The slots grow with the corpus, which the planner cannot see: never broadcast them.
        return self.blocks().join(self.slots().hint("merge"), ["source", "block_no"]).select("shard", "slot", "block_from", "source", "pass", "block_no", "doc_id", "token_from", "token_to")

    def tokens(self, mix: DataFrame | None = None) -> DataFrame:
        """The mix itself: shard, slot, source and ids, the tokens of the slot in order (a block's worth at most)."""
        ids = encode(self.named.select("doc_id", "text"), path=self.path)
        cut = (mix or self.mix()).join(ids.hint("merge"), "doc_id").select("shard", "slot", "source", "block_from", F.slice("ids", F.col("token_from") + 1, F.col("token_to") - F.col("token_from")).alias("part"))
        whole = cut.groupBy("shard", "slot", "source").agg(F.sort_array(F.collect_list(F.struct("block_from", "part"))).alias("parts"))
        return whole.select("shard", "slot", "source", F.flatten(F.transform("parts", lambda x: x["part"])).alias("ids"))

    def shares(self, mix: DataFrame | None = None) -> DataFrame:
        """Per named source: target and actual shares, tokens, and how often its most used block is used."""
        got = (mix or self.mix()).groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("mixed_tokens"), (F.max("pass") + 1).alias("most_uses"))
        plan = self.spark.createDataFrame(
            [(r.source, float(r.share), int(r.repeat), int(r.tokens), int(r.docs)) for r in self.plan.itertuples()],
            "source string, target_share double, max_repeat int, source_tokens long, docs long",
        )
        mixed = F.coalesce("mixed_tokens", F.lit(0))
        return plan.join(got, "source", "left").select(
            "source", "target_share", "max_repeat", "source_tokens", "docs", mixed.alias("mixed_tokens"),
            (mixed / F.lit(float(max(1, self.total)))).alias("actual_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        )
