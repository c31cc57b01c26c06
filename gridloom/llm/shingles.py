"""Sets of word shingles as sorted 64-bit hashes, computed over whole Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import blocks, mix, raw

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_C = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the rows between the offsets, and the row that it stands in."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[offsets < n]] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    nextrow = np.empty(n, bool)
    nextrow[-1], nextrow[:-1] = True, first[1:n]
    ends = np.flatnonzero(word & (~after | nextrow)) + 1
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[data]
    eight = np.ndarray((n + 1,), "<u8", padded.data, strides=(1,))
    length = ends - starts
    h = length.astype(np.uint64) * _C
    at, left, live = starts, length, None
    while len(at):
        x = eight[at] & _MASK[np.minimum(left, 8)]
        if live is None:
            h = mix((h ^ x) * _C + np.uint64(1))
            live = np.flatnonzero(left > 8)
            at, left = at[live] + 8, left[live] - 8
        else:
            h[live] = mix((h[live] ^ x) * _C + np.uint64(1))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    return h, np.searchsorted(offsets, starts, "right") - 1


def sets_of(texts: pa.Array, width: int = 5):
    """For each text in turn its set: sorted distinct uint64 hashes of `width`-word shingles.

    A text of fewer words gives the hash of its whole sequence, one without words an empty array.
    """
    data, offsets = raw(texts)
    for i, j in blocks(offsets, 1 << 20):
        off = offsets[i : j + 1] - offsets[i]
        h, row = word_hashes(data[offsets[i] : offsets[j]], off)
        count = np.bincount(row, minlength=j - i) if len(row) else np.zeros(j - i, np.int64)
        at = np.concatenate([[0], np.cumsum(count)])
        m = len(h) - width + 1
        if m > 0:
            s = h[:m].copy()
            for k in range(1, width):
                s = mix((s ^ (h[k : k + m] + _C)) * _C)
        for r in range(j - i):
            a, b = at[r], at[r + 1]
            if b - a >= width:
                x = np.sort(s[a : b - width + 1])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])]
            elif b > a:
                x = h[a : a + 1].copy()
                for k in range(1, b - a):
                    x = mix((x ^ (h[a + k : a + k + 1] + _C)) * _C)
                yield mix(x + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
