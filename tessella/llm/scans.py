"""Repairing text from scanned pages (problem 6).

Heads and feet: the lines that can stand at the edge of a page (the first and last of a chunk, and any of a chunk that goes
over a page) are compared fuzzily within their contract generation: without page number, and with any one word left
out, so that a misread word does no harm. A line that recurs so at a good share of the generation's page breaks is a
head or foot. What stands on one page only is one too if it is nearly the generation's own recurring line or, in a
generation without any, if it holds a word and a shape of number that the corpus shows in a good share of all recurring
heads. Page numbers: edge lines that hold nothing but a number in one of the usual dresses, when the number is one of
the pages of the chunk; bare numbers only where they stand at a good share of the generation's page breaks. Nothing is
taken out of the middle of a page. With heads and numbers taken out, lines are joined.
A mark at a line's end is a hyphenation if the two halves make a word of the corpus, else it stays. A word is misread if
folding commonly confused characters makes it equal to a word that the corpus has far more often.

Confusions are those the corpus shows. Words that differ in one place (one character, or two
Latin letters for one) from a word far more frequent are joined by a key with that place left out; each counts for the
right word that looks most like it (by fewest differing jamo; by the nearest ideograph, as these
stand in order of radical and strokes). A confusion is learned if few pairs of words that it joins are about equally
frequent and its wrong words stand in the generations that have heads or page numbers far more than their right words do: a
rare word of the language stands in scans and other texts alike. Where all generations are scans, or none is known to be
one, many different words must show it.

The vocabulary (word, count, count in scanned generations) is aggregated over all chunks, before and after the shuffle; it
is never collected or broadcast. Only the learned confusions (pairs of characters) and the words and shapes of numbers that
at least WORD_SHARE of all generations with heads have in them reach the driver (a head has a few dozen words at most, so
these are a few hundred at most).

Defined results: null and empty texts have no findings and no paragraphs; repeated rows count once; with a null page_start
any page up to page_end may be meant, without any page only dressed numbers count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, spread, staged, Staging
from .lookalike import INVISIBLE, mapping

#: Share of a generation's page breaks at which a line recurs that is a head or foot, or a bare number a page number; share
#: of the corpus's heads that makes a word or shape one of heads; likeness of a line to the head of its generation.
HEAD_SHARE, NUMBER_SHARE, WORD_SHARE, ALIKE = 0.6, 0.4, 0.03, 0.75
#: How often more than a misread form its right form must stand in the corpus, and how often at least.
DOMINANCE, COMMON = 4, 3
#: To learn a confusion: occurrences of a right word at least; different words that show it, or occurrences in scans and how
#: much more often its wrong words stand in scans than their right words.
LEARN_FROM, KINDS, IN_SCANS, SCAN_ODDS = 12, 5, 5, 3

_MARK = "-‐¬­"
# Signs that stand for a letter within a word, or before one.
_SIGN = "!|$@"
_MORE = rf"(?:[{_SIGN}]{{1,2}}[A-Za-zÀ-ɏ0-9]*[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ0-9]*)*"
_LAST_HALF = re.compile(rf"([A-Za-zÀ-ɏ0-9{_SIGN}]*[A-Za-zÀ-ɏ])[{_MARK}]\s*$")
_FIRST_HALF = re.compile(rf"\s*([!|]?[a-zà-ɏ0-9]*[a-zà-ɏ][A-Za-zà-ɏ0-9]*{_MORE})")
_WORD = re.compile(rf"(?:(?<![^\s(“\"'])[!|](?=[a-zà-ɏ]))?[A-Za-zÀ-ɏ0-9]*[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ0-9]*{_MORE}|[가-힣]+|[一-鿿々]+")
_DRESSED = r"[-–—\[〔(（<|]*\s*(?:page|p\.?|pg\.?|第|제)?\s*(\d{1,4})\s*(?:(?:/|of)\s*\d{1,4})?\s*(?:쪽|頁|ページ|페이지|면)?\s*[-–—\]〕)）>|]*"
_EDGE_NUMBER = re.compile(rf"^\s*{_DRESSED}\s{{2,}}(?=\S)|\s+{_DRESSED}\s*$", re.IGNORECASE)
_PAGE = re.compile(r"^\s*(?P<left>[-–—\[〔(（<|]*\s*(?:page|p\.?|pg\.?|第|제)?\s*)(?P<n>\d{1,4})(?P<right>\s*(?:(?:/|of)\s*\d{1,4})?\s*(?:쪽|頁|ページ|페이지|면)?\s*[-–—\]〕)）>|]*)\s*$", re.IGNORECASE)
# What ends a sentence or announces what follows: signs that Unicode names so, whatever their width, before closing marks.
_ENDS = "".join(c for c in map(chr, range(0x21, 0x10000)) if re.search(r"(?:^|WIDTH |IDEOGRAPHIC |^)(?:FULL STOP|EXCLAMATION MARK|QUESTION MARK|COLON)$", unicodedata.name(c, "")))
_CLOSING = "".join(c for c in map(chr, range(0x21, 0x10000)) if unicodedata.category(c) in ("Pe", "Pf")) + "\"'"
_SENTENCE_END = re.compile(rf"[{re.escape(_ENDS)}][{re.escape(_CLOSING)}]*\s*$")
_TITLE_LINE = re.compile(r"^\s*(?:article|section|clause|schedule|제\s*\d+|第\s*\d+|별표|付属|附属).{0,60}$", re.IGNORECASE)
_CJK_EDGE = re.compile(r"[぀-ヿ㐀-鿿、。「」『』（）0-9A-Z,\-]$"), re.compile(r"^[぀-ヿ㐀-鿿、。「」『』（）0-9A-Z,\-]")


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, str]:
    """Look-alike characters to one form; the marks that may stand for a hyphenation stay."""
    gone = dict.fromkeys(INVISIBLE, "")
    gone.pop(0xAD)
    table = {ord(c): unicodedata.normalize("NFC", d) for c, d in mapping().items() if not 0xAC00 <= ord(c) < 0xD7A4 and unicodedata.normalize("NFC", d) != c}
    return table | gone | {0xAD: "­", 0x2010: "‐", 0x0D: "\n"}


@lru_cache(maxsize=1)
def _to_fold() -> frozenset[str]:
    return frozenset(map(chr, _fold_table()))


def plain(text: str) -> str:
    if text.isascii():
        return text
    text = text.replace("\r\n", "\n")
    if not _to_fold().isdisjoint(text):  # most texts hold nothing to fold
        text = text.translate(_fold_table())
    return unicodedata.normalize("NFC", text)


Learned = tuple[tuple[str, str], ...]


@lru_cache(maxsize=8)
def _confusions(learned: Learned = ()) -> tuple[tuple[tuple[str, str], ...], dict[int, str], re.Pattern]:
    """Two characters that are one, one for all that are confused, and what a misread word contains."""
    both = learned
    pairs = tuple(dict.fromkeys((a, b) if len(a) == 2 else (b, a) for a, b in both if len(a) + len(b) == 3))
    root: dict[str, str] = {}

    def top(c: str) -> str:
        while c in root:
            c = root[c]
        return c

    for a, b in both:
        if len(a) == len(b) == 1 and top(a) != top(b):
            root[top(a)] = top(b)
    return pairs, {ord(c): top(c) for c in root}, re.compile("|".join(sorted({re.escape(a) for a, _ in both}, key=len, reverse=True)) or r"(?!)")


@lru_cache(maxsize=20_000)
def folded(word: str, learned: Learned = ()) -> str:
    """The word with all commonly confused characters as one."""
    pairs, single, _ = _confusions(learned)
    for wrong, right in pairs:
        word = word.replace(wrong, right)
    return word.translate(single)


def _places(words: DataFrame, keep: dict[str, str]) -> DataFrame:
    """Each word with each place left out: key, what stood there, and the columns to keep under their new names."""
    at = "transform(sequence(1, length(word)), i -> struct(concat(left(word, i - 1), '\\u0001', substring(word, i + 1)) AS key, substring(word, i, 1) AS c))"
    two = "transform(sequence(1, length(word) - 1), i -> struct(concat(left(word, i - 1), '\\u0001', substring(word, i + 2)) AS key, substring(word, i, 2) AS c))"
    places = F.expr(f"inline(IF(word < '\u0250', concat({at}, {two}), {at}))")
    return words.filter("length(word) >= 2").select(*(F.col(c).alias(k) for c, k in keep.items()), places)


def _unlike() -> str:
    """How much the characters of a confusion differ in look (SQL over a and b)."""
    x, y = "(ascii(a) - 44032)", "(ascii(b) - 44032)"
    jamo = " + ".join(f"CAST({f.format(x)} <> {f.format(y)} AS INT)" for f in ("{} div 588", "{} % 588 div 28", "{} % 28"))
    return f"CASE WHEN length(a) + length(b) > 2 THEN 1 WHEN ascii(a) BETWEEN 44032 AND 55203 THEN {jamo} WHEN ascii(a) >= 12288 THEN abs(ascii(a) - ascii(b)) ELSE 0 END"


def learn(vocabulary: DataFrame) -> Learned:
    """Confusions (wrong, right) that the corpus shows; vocabulary: word, n, and of these in scans."""
    wrong = _places(vocabulary, {"word": "w", "n": "n", "scans": "s"}).withColumnRenamed("c", "a")
    right = _places(vocabulary.filter(F.col("n") >= LEARN_FROM), {"word": "r", "n": "m", "scans": "rs"}).withColumnRenamed("c", "b")
    both = wrong.join(right, "key").filter(
        "a <> b AND n <= m AND length(a) + length(b) < 4 AND NOT (length(a) + length(b) = 3 AND (startswith(a, b) OR endswith(a, b) OR startswith(b, a) OR endswith(b, a)))"
    )
    pairs = staged(both.select("w", "n", "s", "r", "m", "rs", "a", "b", F.expr(f"m >= {DOMINANCE} * n").alias("far"), F.expr(_unlike()).alias("unlike")), "confused")
    equal = pairs.filter("NOT far").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count("*").alias("equal"))
    far = pairs.filter("far")  # of confusions that look alike, the one that more words show
    far = far.join(far.groupBy("a", "b").agg(F.count("*").alias("support")), ["a", "b"])
    one = far.groupBy("w").agg(F.min(F.struct("unlike", -F.col("support"), -F.col("m"), "r", "a", "b", "n", "s", "m", "rs")).alias("p")).select("p.*")
    shown = one.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "s", "m", "rs")), F.count("*").alias("kinds"), F.max("unlike").alias("unlike"))
    shown = shown.join(equal, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left").na.fill(0, ["equal"])
    scanned = f"s >= {IN_SCANS} AND s * (m - rs) >= {SCAN_ODDS} * (n - s) * rs AND (ascii(a) NOT BETWEEN 44032 AND 55203 OR unlike < 2 OR unlike = 2 AND kinds >= 2 AND s >= {2 * IN_SCANS} AND s * (m - rs) >= {4 * SCAN_ODDS} * (n - s) * rs)"
    kept = shown.filter(f"IF(rs > 0 AND m > rs, {scanned}, kinds >= {KINDS}) AND {KINDS} * equal <= kinds")
    return tuple(sorted((r.a, r.b) for r in kept.select("a", "b").collect()))


def core(line: str) -> tuple[str, int | None]:
    """A line without the page number at its edge, and that number."""
    m = _EDGE_NUMBER.search(line)
    if m is None:
        return line.strip(), None
    return (line[: m.start()] + line[m.end() :]).strip(), int(m[1] or m[2])


def shape(token: str) -> str:
    """Digits as '#', other letters as 'A'."""
    return "".join("#" if c.isdigit() else "A" if c.isalpha() else c for c in token)


def is_word(token: str) -> bool:
    return len(token) > 1 and not any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


@lru_cache(maxsize=20_000)
def near(a: str, b: str, least: float) -> bool:
    return a == b or abs(len(a) - len(b)) <= 0.4 * max(len(a), len(b)) and SequenceMatcher(None, a, b, autojunk=False).ratio() >= least


def looks_like_heads(line: str, words: tuple[str, ...], shapes: tuple[str, ...]) -> bool:
    """Does the line hold a word of heads and end in a number of their shape, perhaps with a character lost or misread?"""
    tokens = re.sub(r"[()（）]", " ", line).casefold().split()
    for k, t in enumerate(tokens):
        if k and is_word(t) and any(_DIGIT.search(x) and any(near(shape(x), y, 0.65) for y in shapes) for x in tokens[k + 1 : k + 3]) and any(near(t, w, 0.72) for w in words):
            return True
    squashed = "".join(tokens)  # a blank may be lost
    return any((k := squashed.find(w)) > 0 and any(near(shape(squashed[k + len(w) :]), y, 0.65) for y in shapes) for w in words)


def same_head(line: str, head: str) -> bool:
    """Is the line the head, with some characters misread or a blank lost or won? A line with words of its own is not."""
    a, b = line.casefold().split(), head.casefold().split()
    if abs(len(a) - len(b)) > 2:
        return False
    x, y = "".join(a), "".join(b)
    return abs(len(x) - len(y)) <= 3 and near(x, y, ALIKE)


def page_of(line: str, pages: tuple[int, int, int] | None, before: str) -> bool:
    """Is the line nothing but the number of one of these pages (first, last, first possible if the first is not known)?"""
    m = _PAGE.match(line)
    if m is None:
        return False
    dressed = bool(m["left"].strip() or m["right"].strip())
    if pages is None:
        return dressed
    return pages[2 if dressed else 0] <= int(m["n"]) <= pages[1] and (dressed or not before.rstrip().endswith((":", "：")))


def page_range(start: int | None, end: int | None) -> tuple[int, int, int] | None:
    """First and last page of a chunk, and the first possible one if the first is not known; None without any."""
    if start is None:  # a clause without its first page may begin on an earlier one
        return None if end is None else (end - 1, end, 1)
    return start, max(start, end if end is not None else start), start


class Page:
    """What is left of one chunk without the lines of its pages (heads, feet, numbers): its lines, where words are broken, and its words."""

    def __init__(self, text: str, gone: set[int]) -> None:
        self.lines: list[str] = [line for k, line in enumerate(plain(text).split("\n")) if k not in gone]
        self.broken: list[tuple[int, str]] = []  # line, the word its last half makes with the next line's first
        for i, (a, b) in enumerate(zip(self.lines[:-1], self.lines[1:], strict=True)):
            if (x := _LAST_HALF.search(a)) and (y := _FIRST_HALF.match(b)):
                self.broken.append((i, x[1] + y[1]))

    def joined(self, confirmed: set[str] | None = None) -> list[str]:
        """Continuous paragraphs. confirmed: broken words to mend (the halves of others stay apart with their mark);
        without it both halves are left out, for counting words."""
        out: list[str] = []
        broken = dict(self.broken)
        current = ""
        for i, line in enumerate(self.lines):
            word = broken.get(i - 1) if i else None
            if word is not None and current:
                first = _FIRST_HALF.match(line)
                if confirmed is None:
                    current = current[: _LAST_HALF.search(current).start()] + " " + line[first.end():]
                elif word in confirmed:
                    current = current[: _LAST_HALF.search(current).start()] + word + line[first.end():]
                else:
                    current += line.lstrip() if current.rstrip().endswith("­") else " " + line.strip()
            elif not current:
                current = line
            elif _CJK_EDGE[0].search(current) and _CJK_EDGE[1].search(line) and re.search("[぀-ヿ㐀-鿿]", current + line):
                current += line
            else:
                current = current.rstrip() + " " + line.strip()
            last = i + 1 == len(self.lines)
            if last or i not in broken and (not out and _TITLE_LINE.match(current) or _SENTENCE_END.search(line) and not (len(self.lines[i + 1]) and self.lines[i + 1][:1].islower())):
                out.append(current.replace("­", "") if confirmed is not None else current.replace("­", ""))
                current = ""
        if current:
            out.append(current)
        return [p for p in out if p.strip()]


_LINES = "grp long, id long, line int, breaks int, text string, number int, kind string, keys array<long>"


_DIGIT, _LETTER = re.compile(r"\d"), re.compile(r"\w")


def _key(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of each chunk that can stand at the edge of a page, with the keys by which they are compared, and a row
    (line -1) with the number of its page breaks. kind: line, bare (nothing but a number) or dressed."""
    for b in batches:
        rows: list[tuple] = []
        for g, i, t, p, q in zip(b["grp"].tolist(), b["id"].tolist(), b["t"].tolist(), b["p"].tolist(), b["q"].tolist(), strict=True):
            pages = page_range(None if p < 0 else int(p), None if q < 0 else int(q))
            if pages is not None and p >= 0 and pages[1] > pages[0]:
                rows.append((g, i, -1, pages[1] - pages[0], "", -1, "breaks", []))
            lines = t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            over = pages is None or pages[1] > pages[2]
            for k, line in enumerate(lines):
                edge = over or k == 0 and len(lines) > 1 or k == len(lines) - 1 and k > 1  # a line stays in any case
                if not edge and (len(line) > 40 or not _DIGIT.search(line)):
                    continue
                line = plain(line)
                if m := _PAGE.match(line):
                    kind = "dressed" if m["left"].strip() or m["right"].strip() else "bare"
                    if (edge or kind == "dressed") and page_of(line, pages, plain(lines[k - 1]) if k else ""):
                        rows.append((g, i, k, 0, line, int(m["n"]), kind, [_key("#" + kind)]))
                    continue
                if not edge or not line.strip() or _LAST_HALF.search(line) or _SENTENCE_END.search(line) or _TITLE_LINE.match(line) or re.search(r"[,、，;；]\s*$", line):
                    continue
                text, n = core(line)
                tokens = text.casefold().split()
                if sum(map(len, tokens)) < 4:
                    continue
                if n is not None and pages is not None and not pages[2] <= n <= pages[1]:
                    n = None
                keys = [_key(" ".join(tokens))]  # the whole line comes first
                if len(tokens) <= 12:  # a number that is another is no misread word
                    keys += [_key(key) for j, x in enumerate(tokens) if is_word(x) and len(_LETTER.findall(key := " ".join([*tokens[:j], "*", *tokens[j + 1 :]]))) >= 6]
                rows.append((g, i, k, 0, text, -1 if n is None else n, "line", keys))
        yield pd.DataFrame(rows, columns=["grp", "id", "line", "breaks", "text", "number", "kind", "keys"])


_FACTS = "tag string, id long, grp long, words array<string>"


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows: list[tuple] = []
        for i, g, t, gone in zip(b["id"].tolist(), b["grp"].tolist(), b["t"].tolist(), b["gone"].tolist(), strict=True):
            page = Page(t, set() if gone is None else set(map(int, gone)))
            if page.broken:
                rows.append(("broken", i, g, sorted({w for _, w in page.broken})))
            rows.append(("words", i, g, _WORD.findall("\n".join(page.joined()))))
        yield pd.DataFrame(rows, columns=["tag", "id", "grp", "words"])


@F.pandas_udf(T.BooleanType())
def _same_head(line: pd.Series, head: pd.Series) -> pd.Series:
    return pd.Series([same_head(a, b) for a, b in zip(line, head, strict=True)], dtype=bool)


class Scans(Staging):
    def __init__(self, chunks: DataFrame, key: str = "id", group: str = "contract_history_id", text: str = "chunk_text", start: str = "page_start", end: str = "page_end", known: Learned = ()) -> None:
        """known: confusions (wrong, right) of the scanner that are known beforehand, in addition to the learned ones."""
        super().__init__(chunks.sparkSession)
        ship(chunks.sparkSession)
        n = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1))
        self.chunks = chunks.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(group).cast("long"), F.lit(-1)).alias("grp"), F.col(text).alias("t"), n(start).alias("p"), n(end).alias("q"))
        self.chunks = spread(self.chunks.filter(F.col("id").isNotNull() & F.col("t").isNotNull()))
        self.lines = self.stage(self.chunks.mapInPandas(_edges, _LINES).dropDuplicates(["id", "line"]), "lines")
        self.marks = self.stage(self._marks(), "marks")
        self.gone = self.marks.groupBy("id").agg(F.collect_set("line").alias("gone"))
        self.facts = self.stage(self._without_edges().mapInPandas(_facts, _FACTS), "facts", by=("tag",))
        scans = self.marks.select("grp", F.lit(1).alias("scan")).distinct()
        own = self.facts.filter("tag = 'words'").join(scans, "grp", "left").select(F.explode("words").alias("word"), F.coalesce("scan", F.lit(0)).alias("scan"))
        counted = self.stage(own.groupBy("word").agg(F.count("*").alias("n"), F.sum("scan").alias("scans")), "counted")
        self.learned = learned = tuple(dict.fromkeys((*known, *learn(counted))))

        @F.pandas_udf("string")
        def fold(w: pd.Series) -> pd.Series:
            return w.map(lambda x: folded(x, learned))

        self.fold = fold
        self.vocabulary = self.stage(counted.select("word", fold("word").alias("fold"), "n"), "vocabulary")
        self.best = self.vocabulary.groupBy("fold").agg(F.max(F.struct("n", "word")).alias("m")).select("fold", F.col("m.word").alias("best"), F.col("m.n").alias("best_n"))

    def _without_edges(self) -> DataFrame:
        """Each chunk once, with the numbers of the lines that its pages added."""
        return self.chunks.join(self.gone.hint("merge"), "id", "left").dropDuplicates(["id"])

    def _marks(self) -> DataFrame:
        """grp, id, line, kind, number: the lines that pages added (running_head, page_number)."""
        lines = self.lines
        breaks = lines.filter("kind = 'breaks'").groupBy("grp").agg(F.sum("breaks").alias("all_breaks"))
        keyed = lines.filter("kind <> 'breaks'").select("grp", "id", "line", "kind", F.posexplode("keys").alias("pos", "key"))
        counts = keyed.groupBy("grp", "key", "kind").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.max("pos").alias("pos"))
        counts = counts.filter("n > 1 AND a < b OR kind <> 'line'").join(breaks, "grp", "left").withColumn("all_breaks", F.coalesce("all_breaks", F.lit(1)))
        recurring = counts.filter(f"kind = 'line' AND n >= {HEAD_SHARE} * all_breaks AND (n > 2 OR pos = 0) OR kind = 'dressed' OR kind = 'bare' AND n >= {NUMBER_SHARE} * all_breaks")
        hits = keyed.join(recurring.select("grp", "key"), ["grp", "key"], "left_semi").select("id", "line").distinct()
        found = self.stage(lines.join(hits, ["id", "line"]).select("grp", "id", "line", "text", "number", "kind"), "found")
        heads = found.filter("kind = 'line'")
        # Words and shapes that many generations' heads have in them.
        tokens = heads.select("grp", F.explode(F.split(F.lower(F.regexp_replace("text", "[()（）]", " ")), r"\s+")).alias("token")).filter("token <> ''")
        masks = F.regexp_replace(F.regexp_replace("token", r"\p{L}", "A"), r"\p{Nd}", "#")
        tokens = tokens.select("grp", F.when(F.col("token").rlike(r"\p{Nd}"), masks).otherwise(F.col("token")).alias("token"), F.col("token").rlike(r"\p{Nd}").alias("coded")).distinct()
        least = WORD_SHARE * heads.select("grp").distinct().count()
        common = tokens.groupBy("token", "coded").agg(F.count("*").alias("n")).filter(F.col("n") >= F.greatest(F.lit(least), F.lit(2))).collect()
        self.words = tuple(sorted(r.token for r in common if not r.coded and is_word(r.token)))
        self.shapes = shapes = tuple(sorted(r.token for r in common if r.coded and len(r.token) > 2))
        words = self.words

        @F.pandas_udf("boolean")
        def like_heads(line: pd.Series) -> pd.Series:
            return line.map(lambda x: looks_like_heads(x, words, shapes)).astype(bool)

        # Lines on one page only: nearly the head of their generation, or, without one, like the heads of the corpus.
        head = heads.groupBy("grp", "text").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max(F.struct("n", "text")).alias("m")).select("grp", F.col("m.text").alias("head"))
        single = lines.filter("kind = 'line'").select("grp", "id", "line", "text", "number", "kind").join(found.select("id", "line"), ["id", "line"], "left_anti").join(head, "grp", "left")
        near_head = single.filter("head IS NOT NULL").filter(_same_head("text", "head"))
        alone = single.filter("head IS NULL").filter(like_heads("text"))
        cols = ["grp", "id", "line", "number", "kind"]
        every = found.select(*cols).unionByName(near_head.select(*cols)).unionByName(alone.select(*cols))
        return every.select("grp", "id", "line", F.when(F.col("kind") == "line", "running_head").otherwise("page_number").alias("kind"), (F.col("number") >= 0).alias("numbered"))

    def misread(self) -> DataFrame:
        """id, word, best: misread words of each chunk and what they should be."""
        suspect = _confusions(self.learned)[2].pattern
        wrong = self.vocabulary.filter(F.col("word").rlike(suspect)).join(self.best, "fold").filter((F.col("word") != F.col("best")) & (F.col("best_n") >= COMMON) & (F.col("best_n") >= DOMINANCE * F.col("n")))
        own = self.facts.filter("tag = 'words'").select("id", F.explode(F.array_distinct("words")).alias("word")).filter(F.col("word").rlike(suspect))
        whole = own.join(wrong.select("word", "best"), "word").select("id", "word", "best")
        halves = self.mended().filter((F.col("word") != F.col("best")) & (F.col("best_n") >= COMMON)).select("id", "word", "best")
        return whole.unionByName(halves).distinct()

    def mended(self) -> DataFrame:
        """id, word, best, best_n: words broken over two lines."""
        broken = self.facts.filter("tag = 'broken'").select("id", F.explode("words").alias("word")).distinct()
        return broken.withColumn("fold", self.fold("word")).join(self.best, "fold").select("id", "word", "best", "best_n")

    def found(self) -> DataFrame:
        """id, kind: what page and scan added to each chunk."""
        lines = self.marks.select("id", "kind").unionByName(self.marks.filter("numbered").select("id", F.lit("page_number").alias("kind")))
        hyphens = self.mended().select("id", F.lit("hyphenation").alias("kind"))
        return lines.unionByName(hyphens).unionByName(self.misread().select("id", F.lit("misread").alias("kind"))).distinct()

    def paragraphs(self) -> DataFrame:
        """id, paragraph_no, paragraph: the clause as continuous paragraphs."""
        fixes = self.misread().select("id", F.struct("word", "best").alias("fix")).groupBy("id").agg(F.collect_list("fix").alias("fixes"))
        joins = self.mended().groupBy("id").agg(F.collect_set("word").alias("joins"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for i, t, gone, fix, join in zip(b["id"].tolist(), b["t"].tolist(), b["gone"].tolist(), b["fixes"].tolist(), b["joins"].tolist(), strict=True):
                    right = {f["word"]: f["best"] for f in fix} if fix is not None else {}
                    page = Page(t, set() if gone is None else set(map(int, gone)))
                    for k, par in enumerate(page.joined(set(join) if join is not None else set())):
                        rows.append((i, k, _WORD.sub(lambda m, r=right: r.get(m.group(), m.group()), par) if right else par))
                yield pd.DataFrame(rows, columns=["id", "paragraph_no", "paragraph"])

        one = self._without_edges().join(fixes.hint("merge"), "id", "left").join(joins.hint("merge"), "id", "left")
        return one.select("id", "t", "gone", "fixes", "joins").mapInPandas(run, "id long, paragraph_no int, paragraph string")
