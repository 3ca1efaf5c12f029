"""Jaro-Winkler similarity, batch-wise. Prefix bonus always; transpositions halved without rounding."""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler_of(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = list(range(len(b)))
    hit_a, hit_b = [], []
    for i, ch in enumerate(a):
        j = next((j for j in free if i - reach <= j <= i + reach and b[j] == ch), None)
        if j is not None:
            free.remove(j)
            hit_a.append(ch)
            hit_b.append(j)
    m = len(hit_a)
    if not m:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(hit_a, sorted(hit_b))) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    return jaro + 0.1 * len(commonprefix((a[:4], b[:4]))) * (1 - jaro)


#: Letters at most of values that are compared many at once, and pairs compared at once.
LETTERS, AT_ONCE = 64, 1 << 14


def jaro_winkler_many(values: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``jaro_winkler_of`` values[x] and values[y] for each of x and y."""
    length = np.array([len(v) for v in values])
    most = np.maximum(length[x], length[y])
    out = np.empty(len(x))
    for k in np.flatnonzero(most > LETTERS).tolist():
        out[k] = jaro_winkler_of(values[x[k]], values[y[k]])
    order = np.argsort(most, kind="stable")[: int((most <= LETTERS).sum())]
    if not len(order):
        return out
    width = max(1, int(most[order[-1]]))
    letters = np.array([v[:width] for v in values], f"U{width}").view(np.uint32).reshape(len(values), width)
    for at in range(0, len(order), AT_ONCE):
        k = order[at : at + AT_ONCE]
        w = max(1, int(most[k[-1]]))
        out[k] = _jaro_winkler_rows(letters[x[k], :w], length[x[k]], letters[y[k], :w], length[y[k]])
    return out


def _jaro_winkler_rows(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """``jaro_winkler_of`` of each row's a and b, letters as numbers, la and lb of them."""
    at = np.arange(a.shape[1])
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free, hit = at < lb[:, None], np.zeros(a.shape, bool)
    row = np.arange(len(a))
    for i in at:
        can = free & (b == a[:, i, None]) & (np.abs(at - i) <= reach[:, None]) & (i < la)[:, None]
        j = can.argmax(axis=1)
        hit[:, i] = can[row, j]
        free[row, j] &= ~hit[:, i]
    met = ~free & (at < lb[:, None])
    m = hit.sum(axis=1)
    p, q = (np.take_along_axis(v, np.argsort(~h, axis=1, kind="stable"), axis=1) for v, h in ((a, hit), (b, met)))
    moved = ((p != q) & (at < m[:, None])).sum(axis=1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / la + m / lb + (m - moved) / m) / 3
    alike = (a == b) & (at < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(alike[:, :4], axis=1).sum(axis=1)
    return np.where(m > 0, np.where((la == lb) & (alike.sum(axis=1) == la), 1.0, jaro + 0.1 * prefix * (1 - jaro)), 0.0)


def jaro_winkler(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([known[p] if p in known else known.setdefault(p, jaro_winkler_of(*p)) for p in zip(x, y)], dtype=float)

    return F.pandas_udf(run, "double")(a, b)


#: Values kept of pairs met before, for each column pair of a worker.
KEPT_PAIRS = 1 << 17


def similarities(pairs: list[tuple[Column, Column]]) -> Column:
    """An array with the similarity of each pair of columns, in one pass; only distinct pairs of values are computed, those met before in a task not again."""
    known: list[dict] = [{} for _ in pairs]

    def one(a: pa.Array, b: pa.Array, seen: dict) -> np.ndarray:
        if len(seen) > KEPT_PAIRS:
            seen.clear()
        a, b = (x.dictionary_encode(null_encoding="encode") for x in (a, b))
        x, y = a.dictionary.to_pylist(), b.dictionary.to_pylist()
        both, at = np.unique(a.indices.to_numpy().astype(np.int64) * max(1, len(y)) + b.indices.to_numpy(), return_inverse=True)
        value = np.empty(len(both))
        for k, p in enumerate(both.tolist()):
            v = x[p // len(y)], y[p % len(y)]
            value[k] = seen[v] if v in seen else seen.setdefault(v, jaro_winkler_of(*v))
        return value[at]

    @F.arrow_udf("array<double>")
    def run(*columns: pa.Array) -> pa.Array:
        each = np.stack([one(columns[2 * i], columns[2 * i + 1], seen) for i, seen in enumerate(known)], axis=1)
        return pa.ListArray.from_arrays(np.arange(0, each.size + 1, each.shape[1], dtype=np.int32), each.ravel())

    return run(*(c for p in pairs for c in p))
