"""Similarity and difference of strings and of word sequences, and their Arrow UDFs.

Two measures that must not be swapped: Indel similarity (from the longest common subsequence, computed
bit-parallel over Python's integers) and the matching-blocks ratio of the standard library's difflib.
"""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, a machine word's worth of a at a time and more."""
    if not a or not b:
        return 0
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_bits = full
    for c in b:
        hit = open_bits & where.get(c, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(a) - open_bits.bit_count()


class Lanes:
    """Texts side by side in one integer: one pass over another text finds how much of it each of them has in the same order."""

    def __init__(self, texts) -> None:
        self.where, self.full, self.spans, at = {}, 0, [], 0
        for t in texts:
            own: dict = {}
            for i, c in enumerate(t):
                own[c] = own.get(c, 0) | 1 << i
            for c, bits in own.items():
                self.where[c] = self.where.get(c, 0) | bits << at
            self.full |= ((1 << len(t)) - 1) << at
            self.spans.append((at, (1 << len(t)) - 1, len(t)))
            at += len(t) + 1  # a bit between lanes takes the carry

    def lcs_lengths(self, b) -> list[int]:
        """Length of the longest common subsequence of b with each text."""
        full, where = self.full, self.where
        open_bits = full
        for c in b:
            hit = open_bits & where.get(c, 0)
            open_bits = ((open_bits + hit) | (open_bits - hit)) & full
        return [n - (open_bits >> at & own).bit_count() for at, own, n in self.spans]


#: Classes of characters that bags count, and texts in a lane's integer.
BAG, LANES = 97, 24


def _bags(texts):
    """How often each text has characters of each class; what two texts share of that bounds what they have in the same order."""
    return np.array([np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % BAG, minlength=BAG) for t in texts], dtype=np.int32).reshape(-1, BAG)


def alike(a: list[str], b: list[str], least: float) -> list[tuple[str, str, float]]:
    """(x, y, indel_ratio) of all texts x of a and y of b, each distinct, that are at least so alike; least is over 0."""
    if len(a) < len(b):
        return [(y, x, r) for x, y, r in alike(b, a, least)]
    a = sorted(a, key=len)
    la, bags, reach, out = np.array([len(t) for t in a]), _bags(a), least / (200 - least), []
    wanted: dict[int, list[tuple[str, list[int]]]] = {}
    for y, bag in zip(b, _bags(b)):
        lo, hi = np.searchsorted(la, [len(y) * reach - 1, len(y) / reach + 1])
        n = la[lo:hi] + len(y)
        able = lo + np.flatnonzero((200 * np.minimum(la[lo:hi], len(y)) >= least * n) & (200 * np.minimum(bags[lo:hi], bag).sum(axis=1) >= least * n))
        for k in able.tolist():
            if a[k] == y:
                out.append((y, y, 100.0))
            else:
                of = wanted.setdefault(k // LANES, [])
                if not of or of[-1][0] is not y:
                    of.append((y, []))
                of[-1][1].append(k)
    for chunk, ys in wanted.items():
        first, several, single = chunk * LANES, None, {}
        for y, ks in ys:
            if len(ks) > 1:
                several = several or Lanes(a[first : first + LANES])
                found = several.lcs_lengths(y)
                lengths = [found[k - first] for k in ks]
            else:
                (k,) = ks
                single[k] = single.get(k) or Lanes([a[k]])
                lengths = single[k].lcs_lengths(y)
            out += [(a[k], y, r) for k, m in zip(ks, lengths) if (r := 200.0 * m / (len(a[k]) + len(y))) >= least]
    return out


def indel_ratio(a, b) -> float:
    """200 * LCS / (sum of lengths); two empty sequences are equal."""
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * lcs_length(a, b) / n


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of the Indel ratios between shared words, shared and own words of a, and of b. 0 if either has no words."""
    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    shared, only_a, only_b = sorted(wa & wb), sorted(wa - wb), sorted(wb - wa)
    if shared and (not only_a or not only_b):
        return 100.0
    base = " ".join(shared)
    left, right = " ".join([*shared, *only_a]), " ".join([*shared, *only_b])
    ja, jb = " ".join(only_a), " ".join(only_b)
    distance = len(ja) + len(jb) - 2 * lcs_length(ja, jb)
    best = 100.0 * (1 - distance / (len(left) + len(right)))
    if shared:
        best = max(best, *(200.0 * len(base) / (len(base) + len(x)) for x in (left, right)))
    return best


def blocks_ratio(a, b) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def bag_ratio(a, b) -> float:
    """Upper bound of blocks_ratio: overlap of the two multisets."""
    n = len(a) + len(b)
    return 1.0 if n == 0 else 2.0 * sum((Counter(a) & Counter(b)).values()) / n


def word_agreement(reference: str, other: str) -> float:
    """Share of the reference's words that the other text has in the same order, in matching runs."""
    a, b = reference.split(), other.split()
    if not a:
        return 1.0
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a)


def word_edits(old: str, new: str) -> list[tuple[str, list[str], list[str]]]:
    """(equal | replace | delete | insert, old words, new words) that turn old into new."""
    a, b = old.split(), new.split()
    ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return [(tag, a[i1:i2], b[j1:j2]) for tag, i1, i2, j1, j2 in ops]


def changed_words(edits: list[tuple[str, list[str], list[str]]]) -> int:
    return sum(max(len(o), len(n)) for tag, o, n in edits if tag != "equal")


def _scorer(score):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


#: Null if either side is null.
indel = _scorer(indel_ratio)
token_sort = _scorer(token_sort_ratio)
token_set = _scorer(token_set_ratio)
blocks = _scorer(blocks_ratio)
agreement = _scorer(word_agreement)
word_blocks = _scorer(lambda a, b: blocks_ratio(a.split(), b.split()))
word_bag = _scorer(lambda a, b: bag_ratio(a.split(), b.split()))

EDITS = ArrayType(StructType([StructField("tag", StringType()), StructField("old", ArrayType(StringType())), StructField("new", ArrayType(StringType()))]))


@F.pandas_udf(EDITS)
def edits(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else [{"tag": t, "old": o, "new": n} for t, o, n in word_edits(a, b)] for a, b in zip(old, new)], dtype=object)


def edited_words(edits_column):
    """changed_words of a column of edits, in the JVM."""
    return F.aggregate(
        F.filter(edits_column, lambda e: e["tag"] != "equal"),
        F.lit(0),
        lambda n, e: n + F.greatest(F.size(e["old"]), F.size(e["new"])),
    ).cast(IntegerType())
