"""Byte kernels over Arrow batches: every loop is linear in the bytes and in what is found."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a batch that is given back.
ROWS = 1 << 16


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the bounds of its values in them; a null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def places(data: np.ndarray, pattern: tuple[int | None, ...] | bytes) -> np.ndarray:
    """All places, overlapping ones too, of bytes with wildcards (None)."""
    n = len(data) - len(pattern) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    fixed = [(k, x) for k, x in enumerate(pattern) if x is not None]
    if not fixed:
        return np.arange(n)
    (k, x), *rest = fixed
    at = np.flatnonzero(data[k : k + n] == x)
    for k, x in rest:
        at = at[data[at + k] == x]
    return at


def greedy(at: np.ndarray, width: int, free: int = 0) -> np.ndarray:
    """Of ascending places those that a left-to-right search without overlaps takes, from `free` on."""
    if not len(at) or at[0] >= free and (np.diff(at) >= width).all():
        return at
    out = []
    for place in at.tolist():
        if place >= free:
            out.append(place)
            free = place + width
    return np.array(out, np.int64)


def find(column: pa.Array, pattern: tuple[int | None, ...] | bytes, no_overlap: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the pattern's places in each value of a column, in order."""
    data, bounds = buffer(column)
    at = places(data, pattern)
    row = np.searchsorted(bounds, at, side="right") - 1
    inside = at + len(pattern) <= bounds[row + 1]
    at, row = at[inside], row[inside]
    if no_overlap and len(at):
        taken = greedy(at, len(pattern))  # no match reaches into the next value
        row = np.searchsorted(bounds, taken, side="right") - 1
        at = taken
    return row, at - bounds[row]


def spans(pattern, subject, size: int = ROWS) -> Iterator[np.ndarray]:
    """(start, end) of the leftmost matches of a compiled regex, empty ones too, in arrays of `size` rows at most.

    The next search begins where a match ended; an empty match there is skipped by one place. The engine goes on as well
    with a longer match where an empty one came first; there it is set to the next place.
    """
    found, last, was_empty = pattern.finditer(subject), -1, False
    while got := [m.span() for m in islice(found, size)]:
        each = np.array(got, np.int64)
        start, end = each[:, 0], each[:, 1]
        empty, before = start == end, np.concatenate(([last], end[:-1]))
        again = start == before
        longer = np.flatnonzero(again & ~empty & np.concatenate(([was_empty], empty[:-1])))
        stop = int(longer[0]) if len(longer) else len(each)
        yield each[:stop][~(again & empty)[:stop]]
        last, was_empty = int(end[stop - 1] if stop == len(each) else start[stop]), bool(empty[-1] if stop == len(each) else True)
        if len(longer):
            found = pattern.finditer(subject, last + 1)


def matches(pattern, subject) -> list[tuple[int, int]]:
    return [(a, b) for part in spans(pattern, subject) for a, b in part.tolist()]


def pieces(batch: pa.RecordBatch, *columns: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose binary columns hold about `limit` bytes at most; a longer single row stays whole."""
    if not batch.num_rows:
        return
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in columns)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def slices(held: tuple[np.ndarray, np.ndarray], row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The bytes [start, stop) of the rows' values in a column's buffer."""
    data, bounds = held
    size = stop - start
    ends = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(ends[-1]) + np.repeat(bounds[row] + start - ends[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data[index].tobytes())]).cast(pa.binary())


def differences(a: bytes | np.ndarray, b: bytes | np.ndarray) -> np.ndarray:
    """Ascending places at which two values differ; past the end of one everything does."""
    a, b = (x if isinstance(x, np.ndarray) else np.frombuffer(x, np.uint8) for x in (a, b))
    n = min(len(a), len(b))
    return np.concatenate((np.flatnonzero(a[:n] != b[:n]), np.arange(n, max(len(a), len(b)))))
