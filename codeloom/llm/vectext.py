"""Array-at-a-time text primitives shared by the corpus operators.

A slice of documents is handled as one byte buffer.  Words are found by a byte-class table and hashed by
prefix sums of a polynomial over the buffer, so the cost is a few numpy passes and no Python call a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)

#: Letters, digits and every byte of a non-ASCII character make up a word.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
#: All but ASCII white space, for words that keep their case and punctuation.
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False

_SYMBOL = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((_MULT, _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def lowered(column: pa.Array) -> pa.Array:
    """Lower case with every character at its old byte offset: one whose length would change stays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    low = pc.utf8_lower(column)
    if pc.all(pc.equal(pc.binary_length(low), pc.binary_length(column))).as_py() in (True, None):
        return low
    fixed = []
    for old, new in zip(column.to_pylist(), low.to_pylist()):
        if len(old.encode()) != len(new.encode()):
            new = "".join(x if len((x := c.lower()).encode()) == len(c.encode()) else c for c in old)
        fixed.append(new)
    return pa.array(fixed, type=pa.large_string())


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Runs (first, last) of documents of about limit bytes; a longer document is a run of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = last


class Words:
    """Words of documents first..last: begin and end (bytes from the first document), hash, document."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, first: int, last: int, kind: np.ndarray) -> None:
        self.first, self.base = first, int(offsets[first])
        b = raw[offsets[first] : offsets[last]]
        self.bounds = offsets[first : last + 1] - offsets[first]
        self.n_docs = last - first
        inside = kind[b]
        edge = np.empty(len(b) + 1, dtype=bool)
        if len(b):
            edge[0], edge[-1] = inside[0], inside[-1]
            np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        else:
            edge[:] = False
        # A document's start ends a word that would run over it, and begins another.
        cut = self.bounds[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(b))])
        joined = cut[inside[cut] & inside[cut - 1]] if len(cut) else cut
        at = np.flatnonzero(edge)
        if len(joined):
            at = np.sort(np.concatenate([at, joined, joined]))
        self.begin, self.end = at[0::2], at[1::2]
        power, inverse = _powers_to(len(b) + 1)
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_SYMBOL[b] * power[: len(b)], out=total[1:])
        self._total, self._inverse = total, inverse
        self.hash = self.hash_between(self.begin, self.end)
        self.starts = np.searchsorted(self.begin, self.bounds)  # of each document, in words

    def hash_between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes begin[i]..end[i]."""
        return mix((self._total[end] - self._total[begin]) * self._inverse[begin])

    def all_grams(self, n: int, salt: int = 0) -> np.ndarray:
        """Hash of the n words from each position on, over the bounds of documents too."""
        h = mix(self.hash + np.uint64(salt)) if salt else self.hash
        if len(h) < n:
            return np.zeros(0, dtype=np.uint64)
        power, inverse = _powers_to(len(h) + 1)
        total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * power[: len(h)], out=total[1:])
        return mix((total[n:] - total[:-n]) * inverse[: len(h) - n + 1])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each position on, and the positions where n words of one document are left."""
        g = self.all_grams(n)
        sizes = np.diff(self.starts)
        left = np.repeat(self.starts[1:], sizes)[: len(g)] - np.arange(len(g))
        at = np.flatnonzero(left >= n)
        return g[at], at

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == w else np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1])


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
