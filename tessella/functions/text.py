"""Text functions: trigram similarity, keys, cleaning, language, date words."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of a text, each word padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"(?U)[^\w]+|_"), lambda w: w != "")
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard index of the trigram sets; 0 if both are empty."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def _grams(text: str) -> list[list[str]]:
    return [[f"  {w} "[i : i + 3] for i in range(len(w) + 1)] for w in re.findall(r"[^\W_]+", text.lower())]


def best_extent(a: str | None, b: str | None, whole_words: bool = False) -> float | None:
    """Greatest Jaccard index between the trigrams of a and those of any continuous extent of b."""
    if a is None or b is None:
        return None
    want = {g for w in _grams(a) for g in w}
    words = _grams(b)
    if not want or not words:
        return 0.0
    units = [set(w) for w in words] if whole_words else [{g} for w in words for g in w]
    best = 0.0
    for i in range(len(units)):
        if units[i].isdisjoint(want):
            continue  # the best extent begins with something wanted
        seen: set = set()
        for j in range(i, len(units)):
            seen |= units[j]
            best = max(best, len(seen & want) / len(seen | want))
            if len(seen) > len(want) / max(best, 1e-9):
                break  # no longer extent can do better
    return best


@F.pandas_udf(T.DoubleType())
def word_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([best_extent(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def strict_word_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([best_extent(x, y, True) for x, y in zip(a, b, strict=True)], dtype="float64")


def plain_key(c: Column) -> Column:
    """Lower case without blanks, punctuation and underscores."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s\p{Punct}_]+", ""))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def norm_key(c: str | Column) -> Column:
    """Compatibility-normalised key in lower case: only letters, digits and marks that combine with them to a character are left."""
    return F.lower(F.regexp_replace(nfkc(c), r"[^\p{L}\p{N}]+", ""))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).replace("­", ""))


def ladder(title: Column, query: Column, alias: bool = False) -> Column:
    """1.0 equal keys, 0.98 title within query, 0.96 query within title (0.01 less for an alias), else trigram similarity."""
    k, q, less = plain_key(title), plain_key(query), 0.01 if alias else 0.0
    step = F.when(k == q, 1.0 - less).when((k != "") & F.contains(q, k), 0.98 - less).when((q != "") & F.contains(k, q), 0.96 - less).otherwise(0.0)
    return F.greatest(step, similarity(title, query))


def squash(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def script_language(c: Column) -> Column:
    return F.when(c.rlike("[가-힣]"), "ko").when(c.rlike("[ぁ-ヿ一-鿿]"), "ja").otherwise("en")


def token_estimate(c: Column) -> Column:
    """Units of 1/20 token: wide characters 20, others 7."""
    return F.regexp_count(c, F.lit("[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]")) * 13 + F.char_length(c) * 7


def safe_filename(c: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(F.regexp_replace(c, r"\\", "/"), "/"), -1), F.lit("")), F.lit("upload.pdf"))


def json_part(c: Column) -> Column:
    """The outermost object of a text without reasoning blocks and code fences."""
    s = F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    return F.regexp_extract(s, r"(?s)\{.*\}", 0)


def iso_date(c: Column) -> Column:
    """First date in ISO, Korean, Japanese or English words, as a date; null if there is none."""
    months = "January February March April May June July August September October November December".split()
    named = F.regexp_extract(c, f"({'|'.join(months)}) (\\d{{1,2}}), (\\d{{4}})", 0)
    parsed = F.try_to_date(named, "MMMM d, yyyy")
    numeric = r"(\d{4})(?:-|년 ?|年)(\d{1,2})(?:-|월 ?|月)(\d{1,2})"
    text = F.concat_ws("-", *(F.regexp_extract(c, numeric, i) for i in (1, 2, 3)))
    return F.coalesce(F.try_to_date(text, "y-M-d"), parsed)


def merge_patch_value(target, patch):
    """The target after an RFC 7396 merge patch, level by level; the target itself is left as it is."""
    top = {"": target}
    todo = [(top, "", patch)]
    while todo:
        holder, key, change = todo.pop()
        if isinstance(change, dict):
            old = holder.get(key)
            kept = {k: v for k, v in old.items() if change.get(k, v) is not None or k not in change} if isinstance(old, dict) else {}
            holder[key] = kept
            todo += [(kept, k, v) for k, v in change.items() if v is not None]
        else:
            holder[key] = change
    return top[""]


@F.pandas_udf(T.StringType())
def merge_patch(target: pd.Series, patch: pd.Series) -> pd.Series:
    return pd.Series(
        [t if p is None else json.dumps(merge_patch_value(json.loads(t) if t else {}, json.loads(p)), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for t, p in zip(target, patch, strict=True)],
        dtype=object,
    )


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def replace_phrases(phrases: dict[str, str]):
    """A function of text columns that replaces phrases in one pass, longest first, whatever blanks stand between their words."""
    wanted = sorted(phrases, key=len, reverse=True)
    pattern = re.compile("|".join(r"\s+".join(map(re.escape, p.split())) for p in wanted)) if wanted else None
    by_key = {re.sub(r"\s+", " ", p.strip()): r for p, r in phrases.items()}

    @F.pandas_udf(T.StringType())
    def replace(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or pattern is None else pattern.sub(lambda m: by_key[re.sub(r"\s+", " ", m.group())], x))

    return replace


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def reading_order(boxes: pd.Series) -> pd.Series:
    """Order of boxes (x0, y0, x1, y1) as they are read: in lines from the top, each line from the left.

    A box joins the line whose middle lies within half its height."""

    def order(found) -> list[int] | None:
        if found is None:
            return None
        rows = sorted(range(len(found)), key=lambda i: ((found[i][1] + found[i][3]) / 2, found[i][0]))
        lines: list[list[int]] = []
        for i in rows:
            middle, height = (found[i][1] + found[i][3]) / 2, abs(found[i][3] - found[i][1])
            if lines:
                last = lines[-1][0]
                if abs((found[last][1] + found[last][3]) / 2 - middle) <= max(height, abs(found[last][3] - found[last][1])) / 2:
                    lines[-1].append(i)
                    continue
            lines.append([i])
        return [i for line in lines for i in sorted(line, key=lambda k: found[k][0])]

    return boxes.map(order)
