"""Long exact spans shared between records (problem 10).

All windows of `length` code points are compared without storing them all. Each window's minimiser is the least hash of
its substrings of `minimiser` code points; consecutive windows with one minimiser form a super-k-mer, of which only
(minimiser, record, start, windows) is kept at first. Two records that share a window share its minimiser, so
super-k-mers whose minimiser occurs in one record only are dropped exactly. The others travel as one packed string to
the bucket of their minimiser, where the windows are cut and sorted by 128-bit digest and record; a window's records are
known by their number and two commutative digests of their ids. A bucket is laid out in parts of BUCKET_PART
super-k-mers by record (nearly always one). Where there are several, each part counts its own windows, the counts are
merged by window, and every part then reads those of its windows back; windows never travel once per record.

Exact copies of whole records are one class from the start: only its representative is cut into windows, and the copies
come back in by membership. Windows that stand in the same set of records are represented by one of them before pairs
are formed, so a pair is formed once per set and not once per window.

Defined results: null, empty and short texts share nothing; a span repeated within one record only is not shared;
an empty table gives empty results; other columns are ignored. Positions and lengths are in code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import ship, Staging

LENGTH, MINIMISER = 200, 96
#: Super-k-mers of a part of a bucket; windows that are sorted at once, if a part has no more; records of a set that one
#: task pairs with all others of the set.
BUCKET_PART, BLOCK_WINDOWS, PAIR_PART = 10_000, 400_000, 1_000
BLOCK_CHARS = 1_000_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_B = 0x100000001B3
_B_INV = pow(_B, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B, np.uint64)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B_INV, np.uint64)]))
    return up, down


def gram_hashes(cp: np.ndarray, m: int) -> np.ndarray:
    """A mixed 64-bit hash of every run of m code points."""
    n = len(cp)
    up, down = _powers(1 << max(10, (n - 1).bit_length()))
    with np.errstate(over="ignore"):
        x = (cp.astype(np.uint64) + np.uint64(1)) * _MULT
        x ^= x >> np.uint64(32)
        x *= up[:n]
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(x, out=sums[1:])
        h = (sums[m:] - sums[:-m]) * down[: n - m + 1]
        h ^= h >> np.uint64(29)
        h *= _MULT
        h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours (blocks of w: suffix minima of one meet prefix minima of the next)."""
    n = len(h)
    rows = -(-n // w)
    pad = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = h
    grid = pad.reshape(rows, w)
    pre = np.minimum.accumulate(grid, axis=1).reshape(-1)
    suf = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def super_kmers(texts: list[str], length: int, m: int) -> tuple[np.ndarray, ...]:
    """Minimiser, text number, start in the text and number of windows of each super-k-mer of texts of at least `length`."""
    lengths = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = sliding_min(gram_hashes(cp, m), length - m + 1)
    n = len(low)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    text_of = np.repeat(np.arange(len(texts)), lengths)[:n]
    valid = np.arange(n) + length <= ends[text_of]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | (text_of[1:] != text_of[:-1]) | ~valid[:-1]
    at = np.flatnonzero(new & valid)
    # A run ends where the next begins or where its text has no further window.
    stop = np.minimum(np.append(np.flatnonzero(new), n)[np.searchsorted(np.flatnonzero(new), at, side="right")], ends[text_of[at]] - length + 1)
    return low[at].view(np.int64), text_of[at], at - begins[text_of[at]], stop - at


def _first_pass(length: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids: list, texts: list[str]) -> pa.RecordBatch:
            v, which, start, windows = super_kmers(texts, length, m)
            return pa.RecordBatch.from_arrays(
                [pa.array(v), pa.array(np.array(ids, np.int64)[which]), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))],
                names=["minimiser", "doc_id", "start", "windows"],
            )

        for batch in batches:
            ids, texts, chars = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(t) < length:
                    continue
                ids.append(i)
                texts.append(t)
                chars += len(t)
                if chars >= BLOCK_CHARS:
                    yield emit(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield emit(ids, texts)

    return run


RUN_SCHEMA = "group binary, n int, doc_id long, start int, windows int"
#: Runs, or (doc_id null) what one part knows of a window: its digest, records and their digests.
COUNT_SCHEMA = RUN_SCHEMA + ", minimiser long, part int, x1 long, x2 long"


def _id_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        out = []
        for seed in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F):
            x = (ids.astype(np.uint64) + np.uint64(seed)) * _MULT
            x ^= x >> np.uint64(30)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
            x *= np.uint64(0x94D049BB133111EB)
            out.append(x ^ (x >> np.uint64(31)))
    return out[0], out[1]


class Windows:
    """The windows of packed strings, sorted by digest and record. Arrays with a place per occurrence (in the order of
    the strings): row, window; per window: digest, n (records), x1, x2 (exclusive or of the digests of their ids)."""

    def __init__(self, ids: np.ndarray, packed: list[str], length: int) -> None:
        import xxhash

        digest = xxhash.xxh3_128_digest
        counts = np.array([len(s) - length + 1 for s in packed], np.int64)
        raw = b"".join(digest(s[k : k + length].encode("utf-8", "surrogatepass")) for s in packed for k in range(len(s) - length + 1))
        keys = np.frombuffer(raw, np.dtype([("a", "<u8"), ("b", "<u8")]))
        self.row = np.repeat(np.arange(len(packed)), counts)
        self.place = np.arange(len(self.row)) - np.repeat(np.cumsum(counts) - counts, counts)
        doc = ids[self.row]
        self.order = order = np.lexsort((doc, keys["b"], keys["a"]))
        sorted_keys, sorted_doc = keys[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        once = new.copy()  # one occurrence of each window and record
        once[1:] |= sorted_doc[1:] != sorted_doc[:-1]
        self.first = np.flatnonzero(new)
        self.window = np.empty(len(order), np.int64)
        self.window[order] = np.cumsum(new) - 1
        h1, h2 = (np.where(once, h, np.uint64(0)) for h in _id_hashes(sorted_doc))
        self.digest = sorted_keys[self.first]
        self.n = np.add.reduceat(once.astype(np.int64), self.first) if len(order) else np.empty(0, np.int64)
        self.x1 = np.bitwise_xor.reduceat(h1, self.first) if len(order) else h1
        self.x2 = np.bitwise_xor.reduceat(h2, self.first) if len(order) else h2

    def forks(self) -> np.ndarray:
        """Windows at which runs begin that are the same text: those with another neighbour in some other place, and
        those after a window with different followers."""
        same_row = np.zeros(len(self.row), bool)
        same_row[1:] = self.row[1:] == self.row[:-1]
        before = np.where(same_row, np.roll(self.window, 1), -1)
        after = np.where(np.roll(same_row, -1), np.roll(self.window, -1), -1)
        differ = lambda x: np.minimum.reduceat(x[self.order], self.first) != np.maximum.reduceat(x[self.order], self.first)
        out = differ(before)
        ends = differ(after)
        out[self.window[1:][same_row[1:] & ends[self.window[:-1]]]] = True
        return out

    def runs(self, ids: np.ndarray, start: np.ndarray, fork: np.ndarray | None) -> pa.RecordBatch:
        """Runs of windows that stand in one and the same set of at least two records."""
        n, x1, x2 = self.n[self.window], self.x1[self.window], self.x2[self.window]
        new = np.ones(len(self.row), bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | (n[1:] != n[:-1]) | (x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1])
        if fork is not None:
            new |= fork[self.window]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(new)))
        shared = n[at] > 1
        at, size = at[shared], size[shared]
        row = self.row[at]
        return _batch(_set_names(x1[at], x2[at]), n[at], ids[row], start[row] + self.place[at], size)


def _set_names(x1: np.ndarray, x2: np.ndarray) -> pa.Array:
    return _binary(np.ascontiguousarray(np.stack([x1, x2], axis=1).astype("<u8")).view(np.uint8).reshape(-1, 16))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _batch(group: pa.Array, n, doc_id, start, windows, minimiser=None, part=None, x1=None, x2=None) -> pa.RecordBatch:
    def col(x, t):
        return pa.nulls(len(group), t) if x is None else pa.array(np.asarray(x)).cast(t)

    return pa.RecordBatch.from_arrays(
        [group, col(n, pa.int32()), col(doc_id, pa.int64()), col(start, pa.int32()), col(windows, pa.int32()), col(minimiser, pa.int64()), col(part, pa.int32()), col(x1, pa.int64()), col(x2, pa.int64())],
        names=["group", "n", "doc_id", "start", "windows", "minimiser", "part", "x1", "x2"],
    )


def _count(length: int, aligned: bool = False):
    """Of packed strings sorted by bucket and part: the runs of whole buckets, and what parts know of their windows."""

    def closed(minimiser: np.ndarray, parts: np.ndarray, part: np.ndarray, ids: np.ndarray, start: np.ndarray, packed: list[str]) -> Iterator[pa.RecordBatch]:
        whole = np.flatnonzero(parts == 1)
        if len(whole):
            w = Windows(ids[whole], [packed[i] for i in whole], length)
            yield w.runs(ids[whole], start[whole], w.forks() if aligned else None)
        if len(whole) < len(packed):
            rest = np.flatnonzero(parts > 1)
            for at in np.split(rest, np.flatnonzero((np.diff(minimiser[rest]) != 0) | (np.diff(part[rest]) != 0)) + 1):
                w = Windows(ids[at], [packed[i] for i in at], length)
                names = _binary(np.ascontiguousarray(w.digest).view(np.uint8).reshape(-1, 16))
                k = len(w.n)
                yield _batch(names, w.n, None, None, None, np.full(k, minimiser[at[0]]), np.full(k, part[at[0]]), w.x1.view(np.int64), w.x2.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
            c = {n: t.column(n) for n in t.column_names}
            yield from closed(*(c[n].to_numpy() for n in ("minimiser", "parts", "part", "doc_id", "start")), c["packed"].to_pylist())

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += int(np.sum(b.column("windows").to_numpy()))
            if size >= BLOCK_WINDOWS:  # all but the last bucket, which may go on, is complete
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column("minimiser").to_numpy(), t.column("part").to_numpy()
                cut = int(np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]))[-1]) + 1 if (key[0] != key[0][-1]).any() or (key[1] != key[1][-1]).any() else 0
                if cut:
                    yield from block(t.slice(0, cut))
                rest = t.slice(cut)
                held = rest.to_batches()
                size = 0 if cut == 0 else int(np.sum(rest.column("windows").to_numpy()))
        if held:
            yield from block(pa.Table.from_batches(held))

    return run


def _join_parts(length: int, aligned: bool):
    """The runs of one part of a bucket, given what all parts together know of its windows."""

    def run(_key, packed: pa.Table, known: pa.Table) -> pa.Table:
        ids, start = packed.column("doc_id").to_numpy(), packed.column("start").to_numpy()
        w = Windows(ids, packed.column("packed").to_pylist(), length)
        w.n, w.x1, w.x2 = np.ones_like(w.n), np.zeros_like(w.x1), np.zeros_like(w.x2)
        if known.num_rows:
            keys = np.frombuffer(b"".join(known.column("group").to_pylist()), w.digest.dtype)
            order = np.argsort(keys, order=("a", "b"))
            at = np.searchsorted(keys[order], w.digest)
            at = order[np.minimum(at, len(order) - 1)]
            hit = keys[at] == w.digest
            for name, column in (("n", "n"), ("x1", "x1"), ("x2", "x2")):
                values = known.column(column).to_numpy()[at]
                own = getattr(w, name)
                own[hit] = values[hit].astype(np.int64).view(own.dtype)
        # Neighbours in other parts are not known here, so that aligned runs are single windows.
        found = w.runs(ids, start, np.ones(len(w.n), bool) if aligned else None)
        return pa.Table.from_batches([found]).select(["group", "n", "doc_id", "start", "windows"])

    return run


class SharedSpans(Staging):
    """Spans of at least `length` code points that stand in more than one record."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, minimiser: int = MINIMISER, bucket_part: int = BUCKET_PART, aligned: bool = False) -> None:
        spark = docs.sparkSession
        super().__init__(spark)
        ship(spark)
        self.length = length
        self.docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull() & (F.char_length("text") >= length))
        self.all = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars")).filter("doc_id IS NOT NULL").distinct()
        # Classes of exact copies.
        digests = self.docs.select("doc_id", F.md5("text").alias("digest"))
        classes = digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
        classes = self.stage(classes.filter("rep < last").select("digest", "rep"), "copies")
        self.members = self.stage(digests.join(classes, "digest").select("doc_id", "rep").distinct(), "members")
        others = self.members.filter("doc_id <> rep").select("doc_id")
        reps = self.docs.join(others, "doc_id", "left_anti")
        # Super-k-mers by reference, and those whose minimiser two records share.
        schema = "minimiser long, doc_id long, start int, windows int"
        kmers = self.stage(reps.mapInArrow(_first_pass(length, minimiser), schema), "kmers")
        shared = kmers.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).filter("a < b").select("minimiser", "n")
        kept = self.stage(kmers.join(shared, "minimiser"), "kept")
        holders = self.stage(kept.select("doc_id").distinct(), "holders")
        own = reps.join(holders, "doc_id", "left_semi")

        def packed(rows: DataFrame) -> DataFrame:
            parts = F.ceil(F.col("n") / bucket_part).cast("int")
            cut = own.join(rows, "doc_id").select(
                "minimiser", parts.alias("parts"), F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"), "doc_id", "start", "windows",
                F.expr(f"substring(text, start + 1, windows + {length - 1})").alias("packed"),
            )
            return cut.repartition("minimiser", "part")

        placed = packed(kept).sortWithinPartitions("minimiser", "part")
        counted = self.stage(placed.mapInArrow(_count(length, aligned), COUNT_SCHEMA), "counted")
        # Buckets in several parts: what the parts know of a window is merged and given back to those that hold it.
        each = counted.filter("doc_id IS NULL").groupBy("minimiser", "group").agg(F.sum("n").alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.collect_list("part").alias("parts"))
        known = each.filter("n > 1").select("minimiser", "group", "n", "x1", "x2", F.explode("parts").alias("part"))
        large = packed(kept.filter(F.col("n") > bucket_part))
        late = large.groupBy("minimiser", "part").cogroup(known.groupBy("minimiser", "part")).applyInArrow(_join_parts(length, aligned), RUN_SCHEMA)
        self.counted = counted.filter("doc_id IS NOT NULL").select("group", "n", "doc_id", "start", "windows").unionByName(self.stage(late, "late"))

    def runs(self) -> DataFrame:
        """Runs of windows with the set of records they stand in: group, n (records), doc_id, start, windows."""
        return self.counted

    def classes(self) -> DataFrame:
        """Exact copies: doc_id and the representative of its class (records without copies are their own and left out)."""
        return self.members

    def links(self) -> DataFrame:
        """a < b of every two representatives that share a span; with `classes` this says what `pairs` spells out."""
        # A set of very many records is paired in parts: each part of it meets the whole set.
        parts = F.ceil(F.col("n") / PAIR_PART).cast("int")
        held = self.runs().select("group", "n", "doc_id").distinct()
        a = held.select("group", F.col("doc_id").alias("a"), F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"))
        b = held.select("group", F.col("doc_id").alias("b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        links = a.join(b.hint("merge"), ["group", "part"]).filter("a < b").select("a", "b").distinct()
        return links

    def _inside(self) -> DataFrame:
        """x < y of every two copies of one class; a class with very many is paired in parts."""
        m = self.members
        parts = m.groupBy("rep").agg(F.ceil(F.count("*") / PAIR_PART).cast("int").alias("parts"))
        m = m.join(parts, "rep")
        x = m.select("rep", F.col("doc_id").alias("x"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
        y = m.select("rep", F.col("doc_id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return x.join(y.hint("merge"), ["rep", "part"]).filter("x < y").select("x", "y")

    def pairs(self) -> DataFrame:
        """doc_id_a < doc_id_b of every two records that share a span."""
        m, links = self.members, self.links()
        links = links.join(m.select(F.col("rep").alias("a"), F.col("doc_id").alias("ma")), "a", "left").join(m.select(F.col("rep").alias("b"), F.col("doc_id").alias("mb")), "b", "left")
        links = links.select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
        return links.unionByName(self._inside()).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))

    def passages(self) -> DataFrame:
        """Each longest passage that two records have in common: doc_id_a < doc_id_b, start_a, start_b, length.

        Runs of equal text are laid side by side and joined along one distance of their starts. Copies have the passages
        of their representative; two copies have their whole text. Needs runs that are aligned.
        """
        runs = self.runs()
        texts = self.docs.join(runs.select("doc_id").distinct(), "doc_id", "left_semi")
        same = F.unhex(F.md5(F.expr(f"substring(text, start + 1, windows + {self.length - 1})")))
        runs = self.stage(texts.join(runs, "doc_id").select("group", "n", "doc_id", "start", "windows", same.alias("same")).distinct(), "same")
        parts = F.ceil(F.col("n") / PAIR_PART).cast("int")
        a = runs.select("group", "same", F.col("doc_id").alias("a"), F.col("start").alias("start_a"), "windows", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"))
        b = runs.select("group", "same", F.col("doc_id").alias("b"), F.col("start").alias("start_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        beside = a.join(b.hint("merge"), ["group", "same", "part"]).filter("a < b").withColumn("shift", F.col("start_b") - F.col("start_a"))
        w = W.partitionBy("a", "b", "shift").orderBy("start_a")
        stop = F.col("start_a") + F.col("windows")
        step = beside.withColumn("new", (F.col("start_a") > F.coalesce(F.max(stop).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
        run = step.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        found = run.groupBy("a", "b", "shift", "run").agg(F.min("start_a").alias("start_a"), F.max(stop).alias("stop"))
        found = found.select("a", "b", "start_a", (F.col("start_a") + F.col("shift")).alias("start_b"), (F.col("stop") - F.col("start_a") + self.length - 1).alias("length"))
        m = self.members
        found = found.join(m.select(F.col("rep").alias("a"), F.col("doc_id").alias("ma")), "a", "left").join(m.select(F.col("rep").alias("b"), F.col("doc_id").alias("mb")), "b", "left")
        found = found.select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"), "start_a", "start_b", "length")
        sizes = self.docs.select(F.col("doc_id").alias("x"), F.char_length("text").alias("length")).distinct()
        inside = self._inside().join(sizes, "x")
        both = found.unionByName(inside.select("x", "y", F.lit(0).alias("start_a"), F.lit(0).alias("start_b"), "length"))
        ends = lambda p, q: F.when(F.col("x") < F.col("y"), F.col(p)).otherwise(F.col(q))
        return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), ends("start_a", "start_b").alias("start_a"), ends("start_b", "start_a").alias("start_b"), "length")

    def stretches(self) -> DataFrame:
        """Maximal stretches of shared windows of each representative record: doc_id, start, end, records (most that share one window)."""
        w = W.partitionBy("doc_id").orderBy("start", "windows")
        stop = F.col("start") + F.col("windows")
        step = self.runs().withColumn("new", (F.col("start") > F.coalesce(F.max(stop).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
        run = step.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        return run.groupBy("doc_id", "run").agg(F.min("start").alias("start"), (F.max(stop) + self.length - 1).alias("end"), F.max("n").alias("records")).drop("run")

    def coverage(self, every: bool = False) -> DataFrame:
        """Of every record with shared text: n_chars, the code points covered by shared spans, and their share; with
        `every` also of the records that share nothing, or have no text."""
        parts = self.stretches()
        w = W.partitionBy("doc_id").orderBy("start")
        later = F.lead("start").over(w)
        covered = parts.withColumn("own", F.least(F.col("end"), F.coalesce(later, F.col("end"))) - F.col("start")).groupBy("doc_id").agg(F.sum("own").cast("long").alias("shared_chars"))
        sizes = self.docs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"))
        copies = self.members.select("doc_id", F.lit(True).alias("copied"))
        found = (
            sizes.join(copies, "doc_id", "left").join(covered, "doc_id", "left")
            .filter(F.col("copied") | F.col("shared_chars").isNotNull())
            .select("doc_id", "n_chars", F.when(F.col("copied"), F.col("n_chars")).otherwise(F.col("shared_chars")).alias("shared_chars"))
            .withColumn("shared_share", F.round(F.col("shared_chars") / F.col("n_chars"), 6))
        )
        if not every:
            return found
        none = self.all.join(found.select("doc_id"), "doc_id", "left_anti")
        return found.unionByName(none.select("doc_id", "n_chars", F.lit(0).cast("long").alias("shared_chars"), F.lit(0.0).alias("shared_share")))
