"""Texts of an Arrow column as flat numpy arrays: bytes, words, hashes of fixed-length grams, sliding minima."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20_240_501)
#: A random 64-bit number for each byte.
BYTE_HASH = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = np.uint64(0x5851F42D4C957F2D)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes and len + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _K2
        x = (x ^ (x >> np.uint64(29))) * _K3
        return x ^ (x >> np.uint64(32))


def gram_hash(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of x[i : i + k] for each i, by doubling."""
    done, out, size, power = 0, None, 1, x
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if out is None:
                    out, done = power, size
                else:
                    n = len(x) - done - size + 1
                    if n <= 0:
                        return np.zeros(0, np.uint64)
                    z = out[:n] * _K1
                    z += power[done : done + n]
                    z ^= z >> np.uint64(31)
                    z *= _K2
                    out, done = z, done + size
            if 2 * size > k:
                return out
            n = len(power) - size
            if n <= 0:
                return np.zeros(0, np.uint64)
            z = power[:n] * _K1
            z += power[size:]
            z ^= z >> np.uint64(32)
            z *= _K2
            power, size = z, 2 * size


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size, out = 1, x
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (w - size)], out[w - size :]) if w > size else out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and len + 1 offsets of texts in words. A word never crosses texts."""
    word = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], word])
    after = np.concatenate([word, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    with np.errstate(over="ignore"):
        power = np.ones(int(size.max()), np.uint64)
        power[1:] = _BASE
        power = np.multiply.accumulate(power)
        at = np.arange(starts[0], ends[-1]) - np.repeat(starts, np.diff(np.append(starts, ends[-1])))
        inside = at < np.repeat(size, np.diff(np.append(starts, ends[-1])))
        terms = np.where(inside, BYTE_HASH[data[starts[0] : ends[-1]]] * power[np.minimum(at, len(power) - 1)], np.uint64(0))
        return mixed(np.add.reduceat(terms, starts - starts[0]) + size.astype(np.uint64) * _K1)


def cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive stretches of rows whose sizes stay near `most` together."""
    if not len(sizes):
        return []
    bin_ = (np.cumsum(sizes) - sizes) // most
    at = [0, *(np.flatnonzero(np.diff(bin_)) + 1).tolist(), len(sizes)]
    return list(zip(at, at[1:], strict=False))
