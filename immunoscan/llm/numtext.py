"""Numpy helpers over the flat byte buffer of an Arrow text column: chunks, words, substring hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U8 = np.uint64
_rng = np.random.default_rng(90210)
BYTE_VALUE = _rng.integers(1, 2**63, 256).astype(U8) * U8(2) + U8(1)
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, U8), np.ones(1, U8)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if _powers[0].size < n:
        size = max(n, 1 << 16)
        for at, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U8)
            steps[0] = 1
            _powers[at] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of a polynomial hash depend on all input."""
    x = x ^ (x >> U8(32))
    x = x * U8(0xD6E8FEB86659FD93)
    x ^= x >> U8(29)
    x *= U8(0xA0761D6478BD642F)
    x ^= x >> U8(32)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(values.size + 1, U8)
    np.cumsum(values * powers(values.size + 1)[0][: values.size], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols from start to end; equal symbols give equal hashes anywhere in the chunk."""
    return mix((sums[end] - sums[start]) * powers(sums.size)[1][start])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = 1 << 18):
    """Ranges of rows whose texts hold about ``limit`` bytes; a longer text stands alone."""
    i, n = 0, off.size - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of the first word of each row."""
    n = data.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(off.size, np.int64)
    gap = np.ones(n + 1, bool)
    solid = ~SPACE[data]
    gap[1:n] = ~solid[:-1]
    gap[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(solid & gap[:n])
    gap[:] = True
    gap[: n - 1] = ~solid[1:]
    cut = off[1:] - 1
    gap[cut[(cut >= 0)]] = True
    ends = np.flatnonzero(solid & gap[:n]) + 1
    return starts, ends, np.searchsorted(starts, off)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum over each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out
