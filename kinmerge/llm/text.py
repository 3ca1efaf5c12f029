"""Words of many texts at once: spans and 64-bit hashes by numpy over Arrow's text buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
#: Bytes or code points that one step of a hash goes over: what its tables are long.
_STEP = 1 << 16
_tables: dict[int, np.ndarray] = {}


def _power_table(base: int) -> np.ndarray:
    """base**i modulo 2**64 for i to ``_STEP``, by doubling."""
    if base not in _tables:
        held = np.ones(1, np.uint64)
        while len(held) <= _STEP:
            held = np.concatenate([held, held * _U(pow(base, len(held), 1 << 64))])
        _tables[base] = held[: _STEP + 1]
    return _tables[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; a null text counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``most`` bytes each, whole rows always; bounds numpy's temporaries."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words; row i has the words first[i] to first[i + 1]."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = _IS_WORD[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]  # texts lie side by side: a word ends with its text
    opens[edges] = word[edges]
    closes[edges - 1] = word[edges - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def polynomial_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each span of data, whose items ``value_of`` turns into 64-bit values; spans are in order and do not overlap.

    Prefix sums of the values times powers of an odd base give every span's
    polynomial in a few vector operations, ``_STEP`` values at a time; a
    finaliser spreads the bits.
    """
    out = np.zeros(len(starts), np.uint64)
    power, inverse = _power_table(_BASE), _power_table(_INVERSE)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = int(np.searchsorted(ends, base + _STEP, "right"))
        if hi <= lo:  # one span longer than a step: the polynomial in blocks
            value = 0
            for k, at in enumerate(range(base, int(ends[lo]), _STEP)):
                block = value_of(data[at : min(at + _STEP, int(ends[lo]))])
                value += int(np.sum(block * power[: len(block)], dtype=np.uint64)) * pow(_BASE, k * _STEP, 1 << 64)
            out[lo] = _U(value & 0xFFFFFFFFFFFFFFFF)
            lo += 1
            continue
        a, z = starts[lo:hi] - base, ends[lo:hi] - base
        prefix = np.zeros(int(z[-1]) + 1, np.uint64)
        np.cumsum(value_of(data[base : base + int(z[-1])]) * power[: int(z[-1])], out=prefix[1:])
        out[lo:hi] = (prefix[z] - prefix[a]) * inverse[a]
        lo = hi
    return mix(out + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes (A-Z lower-cased if asked)."""
    keyed = _BYTE[_LOWER] if lower else _BYTE
    return polynomial_hashes(data, starts, ends, lambda x: keyed[x])


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    data, offsets = as_bytes(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for lo, hi in slices(offsets):
        own = offsets[lo : hi + 1]
        _, _, first = spans(data[own[0] : own[-1]], own - own[0])
        out[lo:hi] = np.diff(first)
    return out
