"""Similarity of texts and vectors on columns."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import col, strip, words


#: Runs of letters, digits and underscores, as ``text.WORD`` has them; combining marks end a word.
_TERM = re.compile(r"[^\W]+")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors, summed in double; 0 if a norm is 0."""
    a, b = col(a), col(b)
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm).otherwise(0.0)


def weighted_centroid(a: Column, weight_a: Column, b: Column, weight_b: Column) -> Column:
    total = F.greatest(weight_a + weight_b, F.lit(1))
    return F.zip_with(a, b, lambda x, y: (x * weight_a + y * weight_b) / total)


def word_set(c: Column | str) -> Column:
    return F.array_distinct(words(c))


def jaccard_sets(x: Column | str, y: Column | str) -> Column:
    """Shared over all members of two sets; 0 if both are empty. Sets made in a projection below are made once."""
    shared = F.size(F.array_intersect(col(x), col(y)))
    union = F.size(col(x)) + F.size(col(y)) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared words over all words; 0 if either text is blank."""
    return jaccard_sets(word_set(a), word_set(b))


def levenshtein(a: Column | str, b: Column | str) -> Column:
    """1 less the edit distance over the longer length; 0 if either is blank, 1 if equal."""
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((strip(a) == "") | (strip(b) == ""), 0.0).when(a == b, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def edit_distance(a: str, b: str) -> int:
    """Exact edit distance in code points, by the bit-parallel form of the table (Myers, Hyyrö): one column a step.

    What the texts share at their ends is left out first, which changes no distance.
    """
    start, least = 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, get = (1 << len(a)) - 1, places.get
    up, down = full, 0  # vertical steps of +1 and -1 in the current column; bits above the text's are cleared once a step
    for c in b:
        same = get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right = (down | (full ^ (diagonal | up))) << 1 | 1
        up, down = ((diagonal & up) << 1 | (full ^ (diagonal | right))) & full, right & diagonal & full
    return len(b) + up.bit_count() - down.bit_count()


def levenshtein_long(a: Column | str, b: Column | str) -> Column:
    """``levenshtein`` for texts of any length; null if either is."""

    @F.pandas_udf("bigint")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else edit_distance(p, q) for p, q in zip(x, y)], dtype="Int64")

    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((strip(a) == "") | (strip(b) == ""), 0.0).when(a == b, 1.0).otherwise(1.0 - distance(a, b) / longest)


def term_cosine(a: str, b: str) -> float:
    """Cosine of word and word-pair weights of two texts; linear in their words."""
    counts = []
    for text in (a, b):
        w = _TERM.findall(text.lower())
        counts.append(Counter(w) + Counter(map(" ".join, zip(w, w[1:]))))
    x, y = counts
    alone = 1 + math.log(1.5)
    square = lambda own, other: sum((n if t in other else n * alone) ** 2 for t, n in own.items())
    norm = math.sqrt(square(x, y)) * math.sqrt(square(y, x))
    return sum(n * y[t] for t, n in x.items() if t in y) / norm if norm else 0.0


def tfidf(a: Column | str, b: Column | str) -> Column:
    """Cosine of word and word-pair weights in the two-text corpus, with smoothed inverse frequencies.

    A term in both texts weighs 1, one in a single text 1 + ln(3/2). 0 if a text has no words, null if one is null.
    """

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else term_cosine(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(col(a), col(b))


def verdict(mean: Column) -> Column:
    return F.when(mean >= 0.8, "high").when(mean >= 0.6, "medium").when(mean >= 0.4, "low").otherwise("very low")
