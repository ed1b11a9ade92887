"""Whole columns of texts as NumPy vectors: words, their 64-bit hashes and shingles, without a Python loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words longer than this many bytes are hashed one at a time.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def chunks(texts: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, row offsets) of consecutive rows; over most_bytes only where one text alone is."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    binary = texts.fill_null("").cast(pa.large_binary())
    _, offset_buffer, data_buffer = binary.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, np.uint8)
    first = 0
    while first < len(binary):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1)
        last = min(last, len(binary))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of every word."""
    return stretches(~_SPACE[data], offsets)


def stretches(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the longest stretches of bytes inside, which rows' ends cut."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(inside)]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def packed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, row of each): the words as an Arrow array of bytes."""
    starts, ends, row = words(data, offsets)
    return packed(data, starts, ends), row


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces of ``data`` from starts to ends, which are ordered and don't overlap, as an Arrow array of bytes."""
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1
    inside = data[np.cumsum(edges[:-1], dtype=np.int8).astype(bool)]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(inside)])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, of A-Z lower-cased if asked."""
    data = _LOWER[data] if lower else data
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    left, at, active = size.copy(), starts.copy(), np.arange(len(starts))
    long_words = np.flatnonzero(size > LONG)
    if len(long_words):
        active = np.flatnonzero(size <= LONG)
        left, at = left[active], at[active]
    while len(active):
        part = eight[at]
        short = left < 8
        keep = np.where(short, (U(1) << (np.minimum(left, 7).astype(U) * U(8))) - U(1), U(0xFFFFFFFFFFFFFFFF))
        out[active] = mix(out[active] ^ (part & keep)) + U(0x632BE59BD9B4E019)
        more = left > 8
        active, left, at = active[more], left[more] - 8, at[more] + 8
    for i in long_words:
        out[i] = U(int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little"))
    return out


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): the distinct hashes of each row's windows of ``width`` words, sorted, as one vector.

    A row of fewer words has one window, all of its words; a row without words has none.
    """
    counts = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    windows = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    at = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(np.arange(rows), windows)
    start = first[owner] + np.arange(at[-1]) - at[owner]
    value = mix(np.minimum(counts, width)[owner].astype(U))
    for k in range(width):
        reach = start + k < first[owner + 1]
        nxt = hashes[np.minimum(start + k, len(hashes) - 1)] if len(hashes) else value
        value = np.where(reach, mix(value * U(0x9E3779B97F4A7C15) + nxt), value)
    out, bounds = [], np.zeros(rows + 1, np.int64)
    for i in range(rows):
        s = np.sort(value[at[i] : at[i + 1]])
        if len(s) > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
        bounds[i + 1] = bounds[i] + len(s)
    return (np.concatenate(out) if out else np.zeros(0, U)), bounds


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, values, bounds) by chunk."""
    for first, last, data, offsets in chunks(texts):
        starts, ends, row = words(data, offsets)
        values, bounds = shingles(word_hashes(data, starts, ends), row, last - first, width)
        yield first, last, values, bounds
