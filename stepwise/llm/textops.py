"""Text kernels over Arrow buffers: words, hashes and runs as flat arrays.

A batch of texts is one byte array plus document offsets, so every step is
a numpy pass over all documents of the batch; no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)

# White space of the word contracts: blank and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix64(np.arange(1, 257, dtype=U64))
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]       # A-Z hash like a-z

_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` for i < n, modulo 2**64."""
    if len(_powers["up"]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(m, U64(base), U64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, off_buf, data = texts.buffers()
    if off_buf is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(off_buf, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``max_bytes`` text (one long text may exceed it)."""
    _, off = flat(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def owners(off: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Document index of each byte position."""
    return np.searchsorted(off, positions, "right") - 1


def per_doc(off: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sum of a per-byte flag over each document."""
    c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]


def segments(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``inside`` bytes within a document."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word (run of non-space bytes)."""
    starts, ends = segments(~SPACE[buf], off)
    return starts, ends, owners(off, starts)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray,
              codes: np.ndarray = BYTE_CODE) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes anywhere."""
    up, down = powers(len(buf) + 1)
    pre = np.concatenate((np.zeros(1, U64), np.cumsum(codes[buf] * up[:len(buf)], dtype=U64)))
    h = (pre[ends] - pre[starts]) * down[starts]
    return mix64(h ^ mix64((ends - starts).astype(U64)))


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values (len(h) - size + 1 of them)."""
    out = np.zeros(max(0, len(h) - size + 1), U64)
    for i in range(size):
        out = (out * U64(_BASE)) + h[i:i + len(out)]
    return mix64(out)


def repeated(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Flag of the entries whose (group, key) occurs twice or more."""
    if len(key) == 0:
        return np.zeros(0, bool)
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    flag = np.zeros(len(key), bool)
    flag[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    return flag


def first_of(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Flag of the first entry of every distinct (group, key), in input order."""
    if len(key) == 0:
        return np.zeros(0, bool)
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    flag = np.zeros(len(key), bool)
    flag[order] = np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])))
    return flag


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(start, start + length)`` for every pair."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
