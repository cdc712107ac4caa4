import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, lookalike, mixture, neighbours, pieces, queries, scans, spans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(str).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


# --- 1 pieces ---------------------------------------------------------------------------------------------------------


def check_pieces(text):
    out = pieces.split(text)
    assert "".join(text[a:b] for _, a, b in out) == text
    for k, (s, a, b) in enumerate(out):
        assert pieces.unit_costs(text[s:b]).sum() <= 9600 and pieces.unit_costs(text[s:a]).sum() <= 960
        assert s >= (out[k - 1][1] if k else 0)
    return out


def test_pieces_of_any_text():
    rnd = random.Random(2)
    for alphabet in ("ab .\n", "가나 。\n", "x", "é", "🎬a ", "각"):
        for n in (0, 1, 1371, 1372, 5000, 40_000):
            check_pieces("".join(rnd.choice(alphabet) for _ in range(n)))


def test_cuts_at_sentences_where_there_are_any():
    text = "The party pays the sum of ten. " * 120
    for _, a, _ in check_pieces(text)[1:]:
        assert text[:a].endswith(". ")
    text = ("word " * 40 + "\n") * 30
    for _, a, _ in check_pieces(text)[1:]:
        assert text[a - 1] == "\n"


def test_pieces_table(spark):
    rows = [("a", "가" * 480, None), ("b", "가" * 481, "1"), ("b", "가" * 481, "1"), ("c", None, "2"), ("d", "", "3"), ("e", "x" * 1371, "4"), ("f", "x" * 1372, "5")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, clause_no string").selectExpr("*", "1 AS pieces", "2 AS piece_no", "3 AS __t0")
    got = {r.chunk_id: r.n for r in pieces.pieces(df, "chunk_id", "text", ("clause_no",)).groupBy("chunk_id").count().withColumnRenamed("count", "n").collect()}
    assert got == {"a": 1, "b": 2, "e": 1, "f": 2}
    assert pieces.pieces(df.limit(0), "chunk_id", "text").count() == 0


# --- 5 look-alikes ----------------------------------------------------------------------------------------------------


def form(text):
    m = lookalike.mapping()
    parts = [x for c in text for x in m.get(c, c)]
    out, i = [], 0
    while i < len(parts):  # canonical order
        j = i
        while j < len(parts) and unicodedata.combining(parts[j]):
            j += 1
        out += sorted(parts[i:j], key=unicodedata.combining)
        if j < len(parts):
            out.append(parts[j])
            j += 1
        i = j
    return lookalike.recompose(out)


def test_recompose_is_nfc():
    rnd = random.Random(4)
    chars = [c for c in map(chr, range(0xC0, 0x3000)) if unicodedata.category(c) != "Cn"] + [chr(x) for x in range(0xAC00, 0xAC80)] + ["́", "̧", "̊", "゙", "が"]
    for _ in range(3000):
        d = unicodedata.normalize("NFD", "".join(rnd.choice(chars) for _ in range(rnd.randint(1, 8))))
        assert lookalike.recompose(list(d)) == unicodedata.normalize("NFC", d)


def test_forms(spark):
    same = [("ａｂｃ－１", "abc-1"), ("é", "é"), ("가각", "가각"), ("Аrticle", "Article"), ("a​b­c﻿", "abc"), ("a　b c", "a b c"), ("ｶﾞ", "ガ"), ("⽇金", "日金"), ("ắ", "ắ"), ("a‑b", "a-b"), ("x \r\ny", "x\ny")]
    differ = [("e", "é"), ("1", "2"), ("a-b", "a—b"), ("a b", "ab"), ("①", "1"), ("A", "a"), ("²", "2")]
    texts = sorted({t for p in same + differ for t in p})
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None, "​"])], "k int, t string").selectExpr("*", "1 AS el", "2 AS form", "3 AS pos")
    got = {r.t: r.form for r in lookalike.same_form(df, "k", "t", ("t",)).select("t", "form").collect()}
    for a, b in same:
        assert got[a] == got[b], (a, b, got[a], got[b])
    for a, b in differ:
        assert got[a] != got[b], (a, b)
    assert got[None] is None and got[""] == "" == got["​"]
    for t in texts:
        assert got[t].replace("\n", "") == form(t).replace("\r", "").replace("\n", "").replace(" ", " ") or "\n" in t


def test_pairs_of_look_alikes(spark):
    a = spark.createDataFrame([(1, 7, "ａ b"), (1, 7, "ａ b"), (2, 7, "a b"), (3, 8, "a b"), (4, 7, None), (5, 7, "")], "id long, h long, t string")
    b = spark.createDataFrame([("x", 7, "a b"), ("y", 7, "a b"), ("z", 7, "​"), ("w", None, "ａ b")], "cid string, h long, u string")
    got = sorted(tuple(r) for r in lookalike.alike_pairs(a, "id", "t", b, "cid", "u", "h").collect())
    assert got == [(1, "x"), (1, "y"), (2, "y")]


# --- 6 scans ----------------------------------------------------------------------------------------------------------


def test_scanned_chunks(spark):
    words = "record before within number inspection approval characters number under"
    rows = [(i, 1, f"Article {i} (Records)\nThe {words} of the {words} stays.", 1, 1) for i in range(1, 9)]
    rows += [
        (20, 2, "Silver Yard licence T12345-6789\nArticle 1 (Records)\nThe record stays.", 1, 1), (21, 2, "The number\nSilver Yard licence T12345-6789  2\nof records stays.", 1, 2),
        (22, 2, "Silver Yard licenceT12345-6789\nThe record.", 3, 3), (23, 2, "The inspec-\n- 3 -\ntion of the record.", 3, 3), (24, 2, "both pre-\nand post-record", 3, 3),
        (25, 2, "The rec0rd stays bcfore the nurnber.", 3, 3), (26, 2, "Number of episodes:\n3", 3, 3), (27, 2, "text\n[3]\nmore", None, 4), (28, 2, None, 1, 1), (29, 2, "", 1, 1),
    ]
    df = spark.createDataFrame([*rows, rows[9]], "id long, contract_history_id long, chunk_text string, page_start int, page_end int").selectExpr("*", "1 AS word", "2 AS fold")
    s = scans.Scans(df, known=(("0", "o"), ("c", "e"), ("rn", "m")))  # too few words to learn from
    got = {(r.id, r.kind) for r in s.found().collect()}
    assert got == {(20, "running_head"), (21, "running_head"), (21, "page_number"), (22, "running_head"), (23, "page_number"), (23, "hyphenation"), (25, "misread"), (27, "page_number")}
    text = {}
    for r in s.paragraphs().orderBy("id", "paragraph_no").collect():
        text.setdefault(r.id, []).append(r.paragraph)
    assert text[23] == ["The inspection of the record."] and text[25] == ["The record stays before the number."] and text[21] == ["The number of records stays."]
    assert text[24] == ["both pre- and post-record"] and 29 not in text
    assert scans.Scans(df.limit(0)).found().count() == 0


# --- 7 neighbours -----------------------------------------------------------------------------------------------------


def vectors(n, seed=1, clusters=40):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, 64))
    x = centre[rng.integers(clusters, size=n)] + rng.normal(size=(n, 64)) * 0.25
    return x.astype(np.float32)


def test_recall_against_brute_force(spark):
    x = vectors(1500)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    u = neighbours.unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:5]}
    got = {(r.id, r.other) for r in neighbours.nearest(df).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_search_recall(spark):
    x = np.random.default_rng(3).normal(size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    u = neighbours.unit(x)
    got = {(r.id, r.other) for r in neighbours.search(df, F.col("id") % 50 == 0).collect()}
    s = u[::50] @ u.T
    s[np.arange(60), np.arange(0, 3000, 50)] = -2
    want = {(i * 50, int(j)) for i in range(60) for j in np.argsort(-s[i])[:5]}
    assert len(got) == 300 and len(got & want) / 300 >= 0.9
    assert neighbours.search(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_copies_and_unusable(spark):
    a, b = [1.0] + [0.0] * 63, [1.0, 0.1] + [0.0] * 62
    nan = [float("nan")] + [1.0] * 63
    rows = [(i, a) for i in range(10)] + [(3, a), (20, b), (21, nan), (22, [0.0] * 64), (23, [1.0]), (24, None), (25, [None] + [1.0] * 63), (None, a)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").selectExpr("*", "1 AS rep", "2 AS other", "3 AS cosine")
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert got[0] == {1, 2, 3, 4, 5} and got[9] == {0, 1, 2, 3, 4} and got[20] == {0, 1, 2, 3, 4} and set(got) == {*range(10), 20}
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_a_file_in_parts_is_ranked_as_a_whole(spark, monkeypatch):
    """One pivot posts all vectors in one file; in parts it gives what it gives as a whole."""
    x = vectors(600, clusters=1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    whole = neighbours.Index(pivots=1, postings=1, prefix=1, share=1.0)
    u = neighbours.unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:5]}
    for part, sampled in ((4096, 64), (50, 1)):
        monkeypatch.setattr(neighbours, "PART", part)
        monkeypatch.setattr(neighbours, "SAMPLED", sampled)
        got = {(r.id, r.other) for r in neighbours.nearest(df, index=whole, pivots=1).collect()}
        assert len(got & want) >= 0.999 * len(want)


def test_a_class_of_very_many_copies(spark):
    same = [1.0] + [0.0] * 63
    df = spark.range(20_000).selectExpr("id", "array(%s) AS embedding" % ", ".join(f"cast({v} AS float)" for v in same))
    got = neighbours.nearest(df).groupBy("id").agg(F.count("*").alias("n"), F.max("other").alias("last")).agg(F.count("*").alias("ids"), F.min("n").alias("n"), F.max("last").alias("last")).first()
    assert tuple(got) == (20_000, 5, 5)


def test_orders_are_exact():
    x, p = neighbours.unit(vectors(300)), neighbours.unit(vectors(1000, seed=2)).astype(np.float32)
    want = np.argsort(-(x.astype(np.float32) @ p.T), axis=1, kind="stable")[:, :12]
    assert (neighbours.orders(x, p, 12) == want).mean() > 0.999 and neighbours.orders(x, p[:5], 12).shape == (300, 5)


# --- 8 tokens ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_reference(reference):
    rnd = random.Random(6)
    alphabet = [*"ab 's'll're'd  \n\t\r1٣é한字—!?|<>  　​🎬", "'s", "'ve", "<|endoftext|>"]
    texts = ["", *("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(4000)), "x" * 100_000, " " * 5000, "가" * 3000]
    counts, ids = bpe.encoder(bpe.default_vocabulary()).encode_batch(texts)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == reference.encode_ordinary(t)


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot) == list(range(5000)) and all(h.find(*bpe._two(k)) == i for i, k in enumerate(keys))


def test_ids_table(spark, reference):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello <|endoftext|> world")], "doc_id long, text string").selectExpr("*", "0 AS ids")
    assert {r.doc_id: list(r.ids) for r in bpe.encode(df).collect()} == {1: [], 2: [], 3: reference.encode_ordinary("Hello <|endoftext|> world")}
    assert bpe.encode(df.limit(0)).count() == 0


# --- 9 mixture --------------------------------------------------------------------------------------------------------


def test_permutations():
    for n in (1, 2, 3, 7, 100, 1025):
        assert sorted(mixture.permute(np.arange(n), n, 9)) == list(range(n))


def test_shard_counts_add_up():
    totals = np.array([1000, 10, 333, 0])
    parts = [mixture.shard_counts(totals, 7, s, 3) for s in range(7)]
    assert sum(p[0] for p in parts).tolist() == totals.tolist()
    before = np.zeros(4, int)
    for have, first in parts:
        assert first.tolist() == before.tolist()
        before += have


def test_mixture(spark):
    rows = [(i, "Big" if i % 3 else " big ", "alpha beta " * (i % 50)) for i in range(600)] + [(1000 + i, "small", "gamma delta " * 30) for i in range(10)]
    rows += [(2000, None, "x"), (2001, "other", "x y"), (2002, "small", None), (2003, "small", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS n_tokens", "2 AS slot")
    goal = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("none", 0.2, 5)], "source string, target_share double, max_repeat int")
    m = mixture.Mixture(docs, goal, block=64)
    mix = m.mix().toPandas()
    sizes = {r.doc_id: r.n_tokens for r in m.sizes.collect()}
    use = {}
    for r in mix.itertuples():
        for t in range(r.token_from, r.token_to):
            use[r.doc_id, t] = use.get((r.doc_id, t), 0) + 1
    assert max(n for (d, _), n in use.items() if d < 1000) == 1 and max(n for (d, _), n in use.items() if d >= 1000) == 2
    assert all(t < sizes[d] for d, t in use) and not mix.duplicated(["shard", "slot", "block_from"]).any()
    shares = {r.source: r for r in m.shares().collect()}
    assert abs(shares["big"].actual_share - 0.5) < 0.01 and shares["none"].mixed_tokens == 0 and shares["small"].mixed_tokens == 2 * sum(n for d, n in sizes.items() if d >= 1000)
    assert mixture.Mixture(docs.limit(0), goal).mix().count() == 0


# --- 10 spans ---------------------------------------------------------------------------------------------------------


def brute_pairs(docs, n):
    held = {}
    for i, t in docs:
        for k in range(len(t or "") - n + 1):
            held.setdefault(t[k : k + n], set()).add(i)
    return {(a, b) for s in held.values() for a in s for b in s if a < b}


@pytest.mark.parametrize("limit", [2000, 2])
def test_spans_against_brute_force(spark, limit):
    rnd = random.Random(8)
    long = ["".join(rnd.choice("abcd é🎬한 ") for _ in range(90)) for _ in range(12)]
    docs = [(i, "".join(rnd.choice(long)[rnd.randint(0, 30) :] for _ in range(rnd.randint(1, 4)))) for i in range(60)]
    docs += [(100, "a" * 300), (101, "a" * 80), (102, None), (103, ""), (104, "short")] + [(200 + k, long[0] + long[1]) for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS group", "2 AS start")
    s = spans.SharedSpans(df, length=60, minimiser=25, bucket_part=limit)
    assert {tuple(r) for r in s.pairs().collect()} == brute_pairs(docs, 60)
    shared = {}
    for i, t in docs:
        own = bytearray(len(t or ""))
        for k in range(len(t or "") - 59):
            if any(j != i and u and t[k : k + 60] in u for j, u in docs):
                own[k : k + 60] = b"\1" * 60
        if any(own):
            shared[i] = sum(own)
    assert {r.doc_id: r.shared_chars for r in s.coverage().collect()} == shared


def test_no_spans(spark):
    df = spark.createDataFrame([(1, "x" * 500), (2, None)], "doc_id long, text string")
    s = spans.SharedSpans(df)
    assert s.pairs().count() == 0 and s.coverage().count() == 0 and spans.SharedSpans(df.limit(0)).pairs().count() == 0
