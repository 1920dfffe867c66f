"""Vectorised word handling over the bytes of an Arrow batch.

All word classes used here are decided by single ASCII bytes, so working on UTF-8 bytes gives the
same words as working on code points.  A batch is cut into slices of bounded size, and every array
below is as long as one slice, so memory does not follow the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
SPACE_WORD = ~SPACE
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z)
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of at most ``limit`` text bytes each; one longer text is a range of its own."""
    at = batch.schema.get_field_index(column)
    if not batch.num_rows:
        return
    col = batch.column(at)
    if not pa.types.is_large_string(col.type) and not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    ends = _offsets(col)[1:]
    base = int(_offsets(col)[0])
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        base, start = int(ends[stop - 1]), stop


def _offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * np.dtype(kind).itemsize)


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = _offsets(col).astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return _LOWER[data]


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(int(_BASE), -1, 1 << 64)
        for name, x in (("up", _BASE), ("down", np.uint64(inverse))):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


class Words:
    """The words of one slice: ``start``/``end`` byte positions, ``doc`` row and ``first`` word of each row."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray = SPACE_WORD):
        self.data, self.off, self.rows = data, off, len(off) - 1
        n = len(data)
        inside = table[data]
        if n:
            cut = off[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            left = np.empty(n, bool)
            left[0], left[1:] = False, inside[:-1]
            left[cut] = False
            right = np.empty(n, bool)
            right[-1], right[:-1] = False, inside[1:]
            right[cut - 1] = False
            self.start = np.flatnonzero(inside & ~left)
            self.end = np.flatnonzero(inside & ~right) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.rows), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)

    def windows(self, n: int) -> np.ndarray:
        """Word positions at which ``n`` consecutive words of one row start."""
        at = np.arange(max(0, len(self) - n + 1))
        return at[self.doc[at] == self.doc[at + n - 1]] if len(at) else at


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _M2)


def chained(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` consecutive values of ``hashes`` from each place in ``at``."""
    out = np.full(len(at), n, np.uint64)
    for i in range(n):
        out = out * _BASE + hashes[at + i]
        out ^= out >> np.uint64(29)
    return mix(out)


def rolled(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A rolling hash of the ``n`` consecutive values of ``hashes`` from each place in ``at``: a polynomial whose prefix
    sums are taken once, so that a window costs the same whatever its length."""
    up, down = _power(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[at + n] - total[at]) * down[at] + np.uint64(n))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in a group of two or more, not the first of its group in input order) for each key."""
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        many[order[1:][same]] = many[order[:-1][same]] = True
        later[order[1:][same]] = True
    return many, later


def covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of ``words`` positions lie in a run of ``n`` from a place in ``at``."""
    step = np.bincount(at, minlength=words + 1) - np.bincount(at + n, minlength=words + 1)
    return np.cumsum(step[:words]) > 0


def points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position (length + 1)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def text_of(col: pa.Array) -> list[str]:
    return [x or "" for x in col.to_pylist()]
