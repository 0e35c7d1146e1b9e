"""Words as spans of Arrow buffers: where they stand, 64-bit hashes of them, and whether they are equal.

A span is a pair of byte positions in one buffer that holds the texts of a batch end to end,
so no string is made for a word.  ``lanes`` reads eight bytes from any position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SPACE_BYTES = (32, 9, 10, 11, 12, 13)
#: A word that is no longer than this is hashed and compared in lanes of eight bytes, all words at once.
LANE_WORDS = 64
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SALT = np.uint64(0x9E3779B97F4A7C15)


def byte_table(members: object) -> np.ndarray:
    """For each byte value, whether it is one of ``members``."""
    return np.isin(np.arange(256), list(members))


SPACE = byte_table(SPACE_BYTES)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (string or binary, without nulls), and where each begins; the last entry is the end."""
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset :][: len(column) + 1].astype(np.int64)
    held = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of every maximal run of bytes of the class; runs end with their text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def lanes_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def hashes(data: np.ndarray, lanes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - begin
    h = mixed(size.astype(np.uint64) * SALT)
    live = np.flatnonzero(size <= LANE_WORDS)
    for k in range(0, LANE_WORDS, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        h[live] = mixed(h[live] * SALT + (lanes[begin[live] + k] & MASKS[np.minimum(size[live] - k, 8)]))
    for i in np.flatnonzero(size > LANE_WORDS):
        h[i] = xxhash.xxh64_intdigest(data[begin[i] : end[i]])
    return h


def equal(data: np.ndarray, lanes: np.ndarray, begin: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the spans numbered ``a`` hold the same bytes as those numbered ``b``."""
    size = end - begin
    same = size[a] == size[b]
    live = np.flatnonzero(same & (size[a] <= LANE_WORDS))
    for k in range(0, LANE_WORDS, 8):
        live = live[size[a[live]] > k]
        if not len(live):
            break
        apart = (lanes[begin[a[live]] + k] ^ lanes[begin[b[live]] + k]) & MASKS[np.minimum(size[a[live]] - k, 8)]
        same[live[apart != 0]] = False
    for i in np.flatnonzero(same & (size[a] > LANE_WORDS)):
        same[i] = np.array_equal(data[begin[a[i]] : end[a[i]]], data[begin[b[i]] : end[b[i]]])
    return same


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``size`` of them, one range after the other."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(size.sum())
