"""Texts of an Arrow column as byte arrays: words, word hashes and shingles with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Low bytes of a little-endian load that belong to a word of 0 to 8 bytes left.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place)."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


def slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, end, bytes and offsets.

    A null counts as empty. A text longer than the limit is a run of its own.
    """
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type):
        width = "<i8"
    else:
        width = "<i4"
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, width, count=len(column) + 1, offset=column.offset * int(width[2])).astype(np.int64) if at is not None else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        part = offsets[start : end + 1]
        yield start, end, data[part[0] : part[-1]], part - part[0]
        start = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each text (one more at the end)."""
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, inside[:-1]] if len(inside) else inside
    after = np.r_[inside[1:], False] if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z lowered, eight bytes at a time."""
    lower = np.zeros(len(data) + 8, np.uint8)
    lower[: len(data)] = LOWER[data]
    loads = np.ndarray((len(data) + 1,), "<u8", lower, strides=(1,))
    length = ends - starts
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    active = np.flatnonzero(length <= _LONG)
    at = 0
    while len(active):
        left = np.minimum(length[active] - at, 8)
        chunk = loads[starts[active] + at] & _MASK[left]
        h[active] = mix((h[active] ^ chunk) * np.uint64(0x9FB21C651E98DF25))
        at += 8
        active = active[length[active] > at]
    for i in np.flatnonzero(length > _LONG):
        h[i] = xxhash.xxh64_intdigest(lower[starts[i] : ends[i]].tobytes())
    return h


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words per text, as sorted 64-bit hashes.

    h: word hashes of all texts; first: number of the first word of each text.
    A text with fewer words has one shingle, its whole sequence; one without
    words has none. Returns the hashes, grouped by text, and their bounds.
    """
    count = np.diff(first)
    texts = len(count)
    each = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(texts), each)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    used = np.minimum(count, size)[doc]
    s = used.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    padded = np.r_[h, np.zeros(size, np.uint64)]
    for j in range(size):
        s = np.where(j < used, mix((s ^ padded[at + j]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(j + 1)), s)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    fresh = np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])] if len(s) else np.zeros(0, bool)
    s, doc = s[fresh], doc[fresh]
    return s, np.searchsorted(doc, np.arange(texts + 1))
