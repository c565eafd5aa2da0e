"""String similarity as Arrow-batched functions. Score distinct candidate pairs only, after blocking: these run in Python.

``ratio`` is the normalised indel similarity (2 x longest common subsequence / total length), 0 to 100, and the others build on it.
"""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length in the longer, also hanging over its ends."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n, letters = len(short), set(short)
    best = ratio(short, long[:n])
    for start in range(1 - n, len(long)):
        window = long[max(0, start) : start + n]
        if (window[-1] if start < 0 else window[0]) in letters and best < 100:
            best = max(best, ratio(short, window))
    return best


def _sorted_words(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted_words(a), _sorted_words(b))


def _token_set(a: str, b: str, score) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    one, two = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    found = [score(one, two)]
    if both:
        found += [score(both, one), score(both, two)]
    return max(found)


def wratio(a: str, b: str) -> float:
    """Weighted best of the plain, word-order-free and, for unlike lengths, partial ratios."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if lengths < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), _token_set(a, b, ratio)))
    weight = 0.9 if lengths < 8 else 0.6
    best = max(best, weight * partial_ratio(a, b))
    x, y = _sorted_words(a), _sorted_words(b)
    shared = set(a.split()) & set(b.split())
    return max(best, 0.95 * weight * (100.0 if shared else partial_ratio(x, y)))


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """0 to 1; the common beginning, of four letters at most, counts for similarities above 0.7."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                first.append(x)
                break
    if not first:
        return 0.0
    second = [y for y, u in zip(b, used) if u]
    m, swaps = len(first), sum(x != y for x, y in zip(first, second)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return jaro + (start * weight * (1 - jaro) if jaro > 0.7 else 0.0)


def sequence_ratio(a: str, b: str) -> float:
    """Matching blocks, 0 to 1."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def _udf(score):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(score(x, y)) for x, y in zip(a, b)], dtype="object").astype("float64")

    return run


#: name -> function of the score as a column of two columns; null if one is null.
def column(name: str):
    return _udf({"ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "wratio": wratio,
        "jaro_winkler": jaro_winkler, "sequence_ratio": sequence_ratio}[name])
