"""Vectorised word and shingle hashing over Arrow string columns.

Every function works on whole texts.  A word is a maximal run of bytes other
than ``[\\x20\\x09-\\x0D]``; upper-case A-Z is folded, nothing else is.  Hashes
are 64 bits and do not depend on the process, batch or partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = {True: _LOWER.astype(np.uint64) + np.uint64(1), False: np.arange(1, 257, dtype=np.uint64)}

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK + 4096)
        up = np.full(size, _MULT, dtype=np.uint64)
        down = np.full(size, _INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and n + 1 row offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and n + 1 offsets of the rows into them.

    ``fold``: upper-case A-Z count as lower-case.
    """
    codes = _CODES[fold]
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    row_starts = offsets[(offsets < n)]
    begins[row_starts] = ~space[row_starts]
    ends = ~space
    ends[:-1] &= space[1:]
    row_ends = offsets[(offsets > 0)] - 1
    ends[row_ends] = ~space[row_ends]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    out = np.empty(len(first), np.uint64)
    k = 0
    while k < len(first):  # blocks of whole words, so that memory follows BLOCK
        base = first[k]
        end = max(k + 1, int(np.searchsorted(last, base + BLOCK)))
        f, e = first[k:end] - base, last[k:end] - base
        up, down = _power_tables(int(e[-1]) + 2)
        sums = np.zeros(int(e[-1]) + 2, np.uint64)
        np.cumsum(codes[data[base : base + e[-1] + 1]] * up[: e[-1] + 1], out=sums[1:])
        out[k:end] = (sums[e + 1] - sums[f]) * down[f]
        k = end
    return mix64(out), np.searchsorted(first, offsets).astype(np.int64)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one document, not yet distinct.

    With fewer words the whole sequence is the one shingle; no words give none.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(size, n)
    acc = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        acc = acc * _STEP + words[k : n - width + 1 + k]
    return mix64(acc)
