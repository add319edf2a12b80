"""Vectorised word and shingle hashing over Arrow batches.

Texts are handled in chunks of about CHUNK bytes, so memory does not follow the
size of an Arrow batch; only a single longer text makes a larger chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
#: Everything in ASCII but letters and digits.
PUNCTUATED = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BASE = 0x9E3779B97F4A7C15
_GRAM = [np.uint64(int(x)) for x in _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    """_BASE ** 0 .. n-1 modulo 2**64."""
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 256), _BASE, np.uint64)
        out[0] = 1
        _powers = np.cumprod(out, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about CHUNK bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each maximal run of bytes not marked in between (white space by default), A-Z lowered, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~between[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = np.flatnonzero(word)
    at = np.searchsorted(inside, starts)
    lengths = np.diff(np.append(at, len(inside)))
    place = np.arange(len(inside)) - np.repeat(at, lengths)
    values = _BYTE_LOWER[data[inside]] * _power_table(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(values, at) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, begins: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes; with fewer words, the whole sequence as one."""
    n = len(hashes)
    grams = np.zeros(max(0, n - k + 1), np.uint64)
    if len(grams):
        for j in range(k):
            grams += hashes[j : n - k + 1 + j] * _GRAM[j]
        grams = mix(grams)
    for b, e in zip(begins[:-1], begins[1:], strict=True):
        m = e - b
        if m >= k:
            yield np.unique(grams[b : e - k + 1])
        elif m:
            whole = np.full(1, _GRAM[k + m], np.uint64)
            for j in range(m):
                whole += hashes[b + j : b + j + 1] * _GRAM[j]
            yield mix(whole)
        else:
            yield np.zeros(0, np.uint64)
