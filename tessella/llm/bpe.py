"""Encoding a whole corpus with a public byte-level BPE vocabulary (problem 8).

Texts are cut into pre-tokens (runs of letters, numbers, other marks or blanks, a leading space staying with the run) by
array operations over the code points of a whole batch. Each distinct pre-token of a batch is then looked up in two tiers:

1. A minimal perfect hash over the vocabulary: if the whole pre-token is a vocabulary entry, its slot gives the id at once
   (the slot's stored key is compared, so a foreign string never passes).
2. Otherwise its bytes form a linked list and a heap holds the ranks of neighbouring pairs; the lowest rank is merged,
   its neighbours' pairs are renewed, until no pair is in the vocabulary.

Ids go back to their places by array gathering; no Python object is made per token. The step is a narrow map: no shuffle,
no collected state, memory bounded by a batch. Special-token strings are ordinary text. Empty and null texts give an empty
list. Nothing is truncated.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ..session import ship, spread

#: Distinct pre-tokens a worker remembers before it forgets all.
MEMO_LIMIT = 400_000
#: Code points that are worked on at once.
BLOCK_CHARS = 2_000_000

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: The white space of the Unicode property White_Space.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE1, _BASE2 = np.uint64(0x100000001B3), np.uint64(0xD6E8FEB86659FD93)


def default_vocabulary() -> str:
    """Path of the tokenizer's rank file; a parameter everywhere, this is only its default."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, everything):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[_WHITE] = SPACE
    return out


class PerfectHash:
    """Minimal perfect hash of byte strings: buckets by one hash, per bucket the first displacement that gives its keys free slots."""

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        h1, h2 = np.array([_two(k) for k in keys], np.uint64).reshape(-1, 2).T
        which = (h1 % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(which, kind="stable")
        starts = np.searchsorted(which[order], np.arange(self.buckets + 1))
        self.displace = [0] * self.buckets
        self.slot = [-1] * n  # slot -> key index
        slot, free = self.slot, 0
        a1, a2 = h1.tolist(), h2.tolist()
        for b in np.argsort(starts[:-1] - starts[1:], kind="stable").tolist():
            own = order[starts[b] : starts[b + 1]].tolist()
            if not own:
                break
            if len(own) == 1:  # the rest have one key each and take the slots left over; -1 - slot says so
                while slot[free] >= 0:
                    free += 1
                self.displace[b], slot[free] = -1 - free, own[0]
                continue
            d = 0
            while True:
                at = [_place(a1[k], a2[k], d, n) for k in own]
                if all(slot[i] < 0 for i in at) and len(set(at)) == len(at):
                    break
                d += 1
            self.displace[b] = d
            for i, k in zip(at, own, strict=True):
                slot[i] = k

    def find(self, h1: int, h2: int) -> int:
        """Index of the only key that can have these hashes."""
        d = self.displace[h1 % self.buckets]
        return self.slot[-1 - d if d < 0 else _place(h1, h2, d, self.n)]


_M64 = (1 << 64) - 1


def _two(key: bytes) -> tuple[int, int]:
    """Two independent 64-bit hashes."""
    x = xxhash.xxh3_128_intdigest(key)
    return x >> 64, x & _M64


def _place(h1: int, h2: int, d: int, n: int) -> int:
    x = (h2 + d * (h1 | 1)) & _M64
    return ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & _M64) % n


class Encoder:
    """Byte-level BPE of one vocabulary file of ranks."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.keys = list(self.ranks)
        self.ids = [self.ranks[k] for k in self.keys]
        self.hash = PerfectHash(self.keys)
        self.memo: dict[str, np.ndarray] = {}
        self.classes = char_classes()

    def word(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        data = piece.encode("utf-8", "surrogatepass")
        at = self.hash.find(*_two(data))
        if self.keys[at] == data:
            return [self.ids[at]]
        return self.merge(data)

    def merge(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank (leftmost of equals) until none is in the vocabulary."""
        ranks, n = self.ranks, len(data)
        part = [data[i : i + 1] for i in range(n)]
        if n < 2:
            return [ranks[p] for p in part]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is rank, place and length of the pair in one number; texts are shorter than 2^32 bytes.
        heap = [r << 64 | i << 32 | 2 for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push, low = heapq.heappop, heapq.heappush, 0xFFFFFFFF
        while heap:
            e = pop(heap)
            i = e >> 32 & low
            left = part[i]
            j = after[i]
            if left is None or j >= n:
                continue
            right = part[j]
            if len(left) + len(right) != e & low:
                continue  # the pair is not there any more
            both = left + right
            if ranks.get(both) != e >> 64:
                continue
            part[i], part[j] = both, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                x = both + part[k]
                if (r := ranks.get(x)) is not None:
                    push(heap, r << 64 | i << 32 | len(x))
            h = before[i]
            if h >= 0:
                x = part[h] + both
                if (r := ranks.get(x)) is not None:
                    push(heap, r << 64 | h << 32 | len(x))
        return [ranks[p] for p in part if p is not None]

    # --- batches ------------------------------------------------------------------------------------------------------

    def cuts(self, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of pre-tokens. cp: code points of texts one after another; first: True where a text begins."""
        n = len(cp)
        kind = self.classes[cp]
        prev = np.empty_like(kind)
        prev[0], prev[1:] = 0, kind[:-1]
        prev[first] = 0
        last = np.empty(n, bool)  # the last code point of its text
        last[-1], last[:-1] = True, first[1:]
        start = kind != prev  # a run begins
        space = kind == SPACE
        # The last blank of a run, if more text follows it, stands apart from the blanks before it ...
        tail = space.copy()
        tail[:-1] &= (kind[1:] != SPACE)
        tail &= ~last
        start |= tail
        # ... and, if it is a plain space, takes the run that follows it.
        joins = tail & (cp == 32)
        after = np.flatnonzero(joins) + 1
        start[after] = False
        # Contractions: an apostrophe that begins a run of its own and is not preceded by a plain space.
        q = np.flatnonzero((cp == 39) & start)
        if len(q):
            q = q[q + 1 < n]
            q = q[~first[q + 1]]
        if len(q):
            one = np.isin(cp[q + 1], np.frombuffer(b"stmd", np.uint8))
            q2 = np.minimum(q + 2, n - 1)
            has2 = (q + 2 < n) & ~first[q2]
            a, b = cp[q + 1], cp[q2]
            two = has2 & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
            hit = one | two
            start[q[hit] + 1] = False
            end = q[hit] + np.where(one[hit], 2, 3)
            end = end[end < n]
            start[end] = True
        start[first] = True
        return np.flatnonzero(start)

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of the texts and all their ids one after another."""
        counts = np.zeros(len(texts), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        if not joined:
            return counts, np.empty(0, np.int32)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths)
        begins = (ends - lengths)[lengths > 0]
        first = np.zeros(len(cp), bool)
        first[begins] = True
        at = self.cuts(cp, first)
        to = np.append(at[1:], len(cp))
        # Distinct pre-tokens by a hash of their code points; equal hashes are compared by a second hash and the length.
        h1, h2 = self._hashes(cp, at, to)
        _, where, which = np.unique(h1, return_index=True, return_inverse=True)
        if not (np.array_equal(h2[where][which], h2) and np.array_equal((to - at)[where][which], to - at)):
            _, where, which = np.unique(np.array([joined[a:b] for a, b in zip(at.tolist(), to.tolist(), strict=True)], object), return_index=True, return_inverse=True)
        found = self._words(joined, at[where].tolist(), to[where].tolist())
        sizes = np.fromiter((len(x) for x in found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))
        offset = np.cumsum(sizes) - sizes
        size = sizes[which]
        total = np.cumsum(size)
        ids = flat[np.repeat(offset[which] - (total - size), size) + np.arange(total[-1])]
        text_of = np.searchsorted(ends, at, side="right")
        counts = np.bincount(text_of, weights=size, minlength=len(texts)).astype(np.int64)
        return counts, ids

    @staticmethod
    def _hashes(cp: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each piece: sums of mixed code points weighted by their place in the piece."""
        place = np.arange(len(cp), dtype=np.int64) - np.repeat(at, to - at)
        longest = int(place.max()) + 1
        with np.errstate(over="ignore"):
            w1 = np.cumprod(np.full(longest, _BASE1))
            w2 = np.cumprod(np.full(longest, _BASE2))
            mixed = (cp.astype(np.uint64) + np.uint64(1)) * _MULT
            mixed ^= mixed >> np.uint64(32)
            h1 = np.add.reduceat(mixed * w1[place], at)
            mixed *= _BASE2
            mixed ^= mixed >> np.uint64(29)
            h2 = np.add.reduceat(mixed * w2[place], at)
        return h1, h2

    def _words(self, joined: str, at: list[int], to: list[int]) -> list[list[int]]:
        memo, out = self.memo, []
        if len(memo) > MEMO_LIMIT:
            memo.clear()
        for a, b in zip(at, to, strict=True):
            piece = joined[a:b]
            ids = memo.get(piece)
            if ids is None:
                ids = memo[piece] = self.word(piece)
            out.append(ids)
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of any number of texts, worked on in blocks."""
        counts, ids, block, chars = [], [], [], 0
        for t in texts:
            t = t or ""
            if block and chars + len(t) > BLOCK_CHARS:
                c, i = self.encode_block(block)
                counts.append(c)
                ids.append(i)
                block, chars = [], 0
            block.append(t)
            chars += len(t)
        if block:
            c, i = self.encode_block(block)
            counts.append(c)
            ids.append(i)
        if not counts:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        return np.concatenate(counts), np.concatenate(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The kept columns and `ids`, the list of token ids of the text; one row per input row."""
    from pyspark.sql import types as T

    ship(df.sparkSession)
    path = path or default_vocabulary()
    df = spread(df.select(*keep, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts, ids = enc.encode_batch(batch.column(batch.num_columns - 1).to_pylist())
            # Lists of a batch are addressed by 32-bit offsets: very long batches leave in parts.
            ends = np.cumsum(counts)
            at, row = 0, 0
            while row < batch.num_rows:
                to = max(row + 1, int(np.searchsorted(ends, at + 20_000_000, side="right")))
                offsets = np.concatenate([[0], ends[row:to] - at]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[at : int(ends[to - 1])], pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(row, to - row) for c in batch.columns[:-1]), lists], names=[*keep, "ids"])
                at, row = int(ends[to - 1]), to

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))]))
