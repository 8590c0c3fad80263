"""String metrics that Spark lacks, as Arrow-batched UDFs (F8 to F10), meant for distinct pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    """Jaro's similarity: matches within half the longer length, transpositions counted by half."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    left, used = [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                used.append(j)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(c != b[j] for c, j in zip(left, sorted(used), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def osa(a: str, b: str, most: int = 2) -> int:
    """Edit distance in which neighbours may swap once; most + 1 if it is above most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        older, old = old, row
    return min(old[-1], most + 1)


def _subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one number."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for c in b:
        m = row & where.get(c, 0)
        row = (row + m | row - m) & every
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times the share of characters that insertions and deletions keep."""
    return 100.0 * 2 * _subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    return max(ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1))


def token_ratio(a: str, b: str) -> float:
    """The better of the ratio of sorted tokens and those of the shared tokens with and without the rest."""
    x, y = sorted(a.split()), sorted(b.split())
    shared = sorted(set(x) & set(y))
    s = " ".join(shared)
    one, two = " ".join([*shared, *sorted(set(x) - set(y))]), " ".join([*shared, *sorted(set(y) - set(x))])
    return max(ratio(" ".join(x), " ".join(y)), *((ratio(s, one), ratio(s, two)) if s else (0.0,)), ratio(one, two))


def weighted_ratio(a: str, b: str) -> float:
    """A weighted maximum of ratios, 0 to 100: plain, of tokens (0.95), and where lengths differ by half or more, partial (0.9, from eightfold on 0.6)."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * token_ratio(a, b))
    scale = 0.9 if longer < 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * token_ratio(a, b))


def jaro_many(a: list[str], b: list[str]) -> np.ndarray:
    """jaro() of pairs, a character of all pairs at a time."""
    n, la, lb = len(a), np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    wide, high = int(la.max(initial=0)), int(lb.max(initial=0))
    if not n or not wide or not high:
        return np.array([float(x == y and x != "") for x, y in zip(a, b, strict=True)])

    def codes(strings: list[str], width: int, lengths: np.ndarray, filler: int) -> np.ndarray:
        out = np.full((n, width), filler, np.int64)
        out[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        return out

    x, y = codes(a, wide, la, -1), codes(b, high, lb, -2)
    reach, at, row = np.maximum(la, lb) // 2 - 1, np.arange(high), np.arange(n)
    free, of = np.ones((n, high), bool), np.full((n, wide), high)
    for i in range(wide):
        may = (y == x[:, i : i + 1]) & free & (abs(at - i) <= reach[:, None])
        j = may.argmax(1)
        hit = may[row, j]
        free[row[hit], j[hit]] = False
        of[hit, i] = j[hit]
    matched = of < high
    m = matched.sum(1)
    # characters of either in order, those without a partner at the end
    left = np.take_along_axis(x, np.argsort(~matched, axis=1, kind="stable"), 1)
    right = np.take_along_axis(np.c_[y, np.full(n, -3)], np.sort(of, axis=1), 1)
    moved = ((left != right) & (np.arange(wide) < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (m / la + m / lb + (m - moved) / m) / 3
    alike = np.array([u == v and u != "" for u, v in zip(a, b, strict=True)])
    return np.where(alike, 1.0, np.where(m > 0, out, 0.0))


@F.pandas_udf(T.DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    out, known = np.full(len(a), np.nan), (a.notna() & b.notna()).to_numpy()
    x, y = a[known].tolist(), b[known].tolist()
    # pairs of like length together, so that little is filled up
    order = sorted(range(len(x)), key=lambda i: len(x[i]) + len(y[i]))
    got = np.zeros(len(x))
    for k in range(0, len(x), 2048):
        part = order[k : k + 2048]
        got[part] = jaro_many([x[i] for i in part], [y[i] for i in part])
    out[known] = got
    return pd.Series(out)


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([99 if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else weighted_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_ratio(a: pd.Series, names: pd.Series) -> pd.Series:
    """The best weighted ratio of a string with any of some names; null without names."""
    return pd.Series([None if x is None or ys is None or not len(ys) else max(weighted_ratio(x, y) for y in ys) for x, ys in zip(a, names, strict=True)], dtype="float64")
