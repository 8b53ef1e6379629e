"""Vectorised word and shingle hashing over UTF-8 byte buffers (numpy only).

A *word* is a maximal run of bytes other than space and 0x09-0x0D; upper-case
A-Z count as lower case.  Every function works on whole texts: a slice of
texts is laid out in one buffer and hashed by a few array passes, so cost and
memory are linear in the slice's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed in slices of about this many bytes; one longer text makes a slice alone.
SLICE_BYTES = 1 << 20

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BYTE = np.arange(256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: nearby inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_FOLD = _BYTE.copy()
_FOLD[65:91] += _U(32)
_CODE = mix((_FOLD + _U(1)) * _ODD)
_POW_ROOT = _U(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = _POW_ROOT
        np.multiply.accumulate(out, out=out)
    return out


def trim() -> None:
    """Give memory that a finished task has freed back to the system: workers stay for the next stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def slices(values: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive (start, values) runs of at most ``limit`` bytes, or one longer value."""
    start, size = 0, 0
    for i, v in enumerate(values):
        if i > start and size + len(v) > limit:
            yield start, values[start:i]
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, values[start:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word index of each text and the total)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate((np.zeros(1, np.int64), edge))
    first, last = edge[0::2], edge[1::2]
    bounds = np.concatenate((np.zeros(1, np.int64), np.searchsorted(first, ends)))
    if not len(first):
        return np.zeros(0, np.uint64), bounds
    span = last - first
    # sum of code(byte) * root^(offset in word), by prefix sums over the words' bytes alone
    at = np.flatnonzero(~space)
    begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(span)))
    offset = np.arange(len(at), dtype=np.int64) - np.repeat(begin[:-1], span)
    value = _CODE[buf[at]] * _powers(int(span.max()))[offset]
    return mix(np.add.reduceat(value, begin[:-1]) + span.astype(np.uint64) * _ODD), bounds


_LANES = mix(np.arange(1, 65, dtype=np.uint64) * _ODD) | _U(1)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, index of its text), in order of place, with repeats.

    A text with fewer words than ``width`` gives one shingle of all its words, and one
    without words gives none.
    """
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    start = np.repeat(bounds[:-1], count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    out = np.zeros(len(start), dtype=np.uint64)
    length = np.minimum(n, width)[doc]
    for k in range(width):
        use = length > k
        if use.all():
            out += words[start + k] * _LANES[k]
        else:
            out[use] += words[start[use] + k] * _LANES[k]
    return mix(out ^ length.astype(np.uint64)), doc


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, one after another; bounds)."""
    words, bounds = word_hashes(texts)
    h, doc = shingle_hashes(words, bounds, width)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))
