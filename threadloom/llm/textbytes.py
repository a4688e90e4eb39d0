"""Vectorised views of Arrow string columns: UTF-8 bytes, words and their hashes.

Everything here works on flat numpy arrays inside a task, so that no Python string is made per row.  A chunk of rows is
bounded by bytes, not by rows, so a batch with very long texts takes no more memory than one with short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_U = np.uint64
_M1, _M2, _G = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays (wraps around)."""
    x = x + _G
    x ^= x >> _U(30)
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix(np.arange(256, dtype=np.uint64) + _U(1_000_003)) | _U(1)
_POWERS = np.ones(64, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """At least n powers of one odd multiplier, grown on demand for long words."""
    global _POWERS
    if len(_POWERS) < n or _POWERS[1] == 1:
        m = max(64, 1 << int(n).bit_length())
        p = np.full(m, 0xD1342543DE82EF95, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the row offsets; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offs - offs[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about `limit` bytes; one longer row stands alone."""
    data, offs = utf8(col)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8; other characters stay."""
    out = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    if len(lead):
        c = data[lead]
        up = lead[(c >= 0x80) & (c <= 0x9E) & (c != 0x97)]
        out[up] += 32
    return out


def spans(data: np.ndarray, offs: np.ndarray, is_break: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of maximal runs of bytes outside `is_break` (a table of 256 flags), within rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~is_break[data]
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = word[:-1]
    starts = np.flatnonzero(word & (~prev | first[:n]))
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = word[1:] & ~first[1:n]
    ends = np.flatnonzero(word & ~nxt) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    ids = np.repeat(np.cumsum(size) - size - starts, size)
    at = np.arange(int(size.sum()), dtype=np.int64)
    pos = at - ids  # position in data
    k = pos - np.repeat(starts, size)
    powers = _powers(int(size.max()))
    terms = _BYTE_CODE[data[pos]] * powers[k]
    sums = np.add.reduceat(terms, np.cumsum(size) - size)
    return mix(sums ^ (size.astype(np.uint64) * _M1))


def word_hashes(data: np.ndarray, offs: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every white-space separated word."""
    if fold:
        data = lower(data)
    starts, ends, rows = spans(data, offs, WHITE)
    return span_hashes(data, starts, ends), rows


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets of a sorted row-number array."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(words: np.ndarray, rows: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of k words; a row of fewer words, but not none, has one shingle of all its words."""
    m = len(words)
    if m == 0:
        return words, rows
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    same = np.concatenate([rows, np.full(k, -1, rows.dtype)])
    h, whole = np.zeros(m, np.uint64), np.ones(m, bool)
    for i in range(k):
        inside = same[i : i + m] == rows
        h = mix(h * _U(3) + np.where(inside, padded[i : i + m], _U(i + 1)))
        whole &= inside
    bounds = row_bounds(rows, n)
    size = np.diff(bounds)
    short = bounds[:-1][(size > 0) & (size < k)]
    whole[short] = True
    return h[whole], rows[whole]
