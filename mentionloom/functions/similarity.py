"""Jaro-Winkler similarity of character n-gram sequences (Winkler, 1990)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of the table of gram positions that are compared at once.
CELLS = 1 << 21


def _codes(texts: Sequence[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the q-grams of each text, a row a text, equal for equal grams; and how many a text has."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.zeros((len(texts), int(lengths.max(initial=0))), np.int64)
    chars[np.arange(chars.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    width = max(0, chars.shape[1] - q + 1)
    codes = chars[:, :width]
    for k in range(1, q):
        # ranks stay small, so a number never holds more than two of them
        codes = np.unique((codes << 21) | chars[:, k : width + k], return_inverse=True)[1].reshape(codes.shape)
    return codes, np.maximum(lengths - q + 1, 0)


def _scores(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Of rows of grams: every gram of a takes the first free equal one of b in reach, for all rows at once."""
    reach = np.maximum(np.maximum(n_a, n_b) // 2 - 1, 0)[:, None]
    at, real = np.arange(b.shape[1]), np.arange(b.shape[1]) < n_b[:, None]
    free, taken = real.copy(), np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        may = free & (b == a[:, i : i + 1]) & (np.abs(at - i) <= reach) & (i < n_a)[:, None]
        rows = np.flatnonzero(may.any(1))
        free[rows, may[rows].argmax(1)] = False
        taken[rows, i] = True
    m = taken.sum(1)
    # what was taken, in the order of either side
    order = lambda x, hit: np.take_along_axis(x, np.argsort(~hit, axis=1, kind="stable"), 1)
    width = min(a.shape[1], b.shape[1])
    x, y = order(a, taken)[:, :width], order(b, real & ~free)[:, :width]
    swapped = ((x != y) & (np.arange(width) < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / n_a + m / n_b + (m - swapped) / m) / 3, 0.0)
    first = min(4, width)
    same = np.cumprod((a[:, :first] == b[:, :first]) & (np.arange(first) < np.minimum(n_a, n_b)[:, None]), axis=1).sum(1)
    return np.where(jaro > 0.7, jaro + 0.1 * same * (1 - jaro), jaro)


def jaro_winkler_pairs(left: Sequence[str], right: Sequence[str], q: int = 2) -> np.ndarray:
    """Similarities from 0 to 1 of pairs of sequences of q-grams: common prefixes of up to 4 add a tenth each above 0.7.
    Texts without a gram are similar only to themselves. Works in array operations over pairs of like length."""
    size = np.fromiter((max(len(x), len(y)) for x, y in zip(left, right, strict=True)), np.int64, len(left))
    order = np.argsort(size, kind="stable")
    out, start = np.zeros(len(left)), 0
    while start < len(order):
        end = start + max(1, int(np.searchsorted(-CELLS // np.maximum(size[order[start:]], 1) + np.arange(len(order) - start), 0, side="right")))
        part = order[start:end]
        x, y = [left[i] for i in part], [right[i] for i in part]
        codes, n = _codes(x + y, q)
        n_a, n_b = n[: len(x)], n[len(x) :]
        short = (n_a == 0) | (n_b == 0)
        found = _scores(codes[: len(x)], np.maximum(n_a, 1), codes[len(x) :], np.maximum(n_b, 1)) if codes.shape[1] else np.zeros(len(x))
        found[short] = [float(x[i] == y[i] and bool(x[i])) for i in np.flatnonzero(short)]
        out[part], start = found, end
    return out


def jaro_winkler(left: str, right: str, q: int = 2) -> float:
    """The similarity of one pair."""
    return float(jaro_winkler_pairs([left], [right], q)[0])


def jaro_winkler_column(left: Column, right: Column, q: int = 2) -> Column:
    """Arrow-batched form for columns; null with null."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        some = (a.notna() & b.notna()).to_numpy()
        out[some] = jaro_winkler_pairs(a[some].tolist(), b[some].tolist(), q)
        return pd.Series(out).astype(object).where(some, None).astype("Float64")

    return score(left, right)
