"""Vectorised text kernels over Arrow string columns: splitting into words and hashing them."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel call works on; a longer document is worked on alone.
SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII that is neither letter nor digit.
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets (n + 1) and bytes of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], whole[at[0] : at[-1]]


def give_back() -> None:
    """Returns free memory to the system: a worker is used by many tasks, of different operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        return


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most ``limit`` bytes of text, or one row."""
    give_back()
    for batch in batches:
        at, _ = utf8(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
        del batch
    give_back()


class Words:
    """Words of a run of documents: byte spans, 64-bit hashes and the row each belongs to."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray):
        self.starts, self.ends, self.hashes = starts, ends, hashes
        #: first[r] .. first[r + 1] are the words of row r.
        self.first = first
        self.counts = np.diff(first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


class Hasher:
    """Polynomial hashing modulo 2**64 with tables that grow as needed; one for each task."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(n, _BASE, _U), np.full(n, _INVERSE, _U)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up, self.down

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each span, independent of where it stands."""
        up, down = self.tables(len(values) + 1)
        sums = np.zeros(len(values) + 1, _U)
        np.cumsum((values.astype(_U) + _U(1)) * up[: len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))

    def words(self, column: pa.Array, lower: bool, breaks: np.ndarray = _SPACE) -> Words:
        at, data = utf8(column)
        if lower:
            data = _LOWER[data]
        inside = np.zeros(len(data) + 2, bool)
        np.logical_not(breaks[data], out=inside[1:-1])
        starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = at[(at > 0) & (at < len(data))]
        starts[edges] |= inside[1:-1][edges]
        ends[edges - 1] |= inside[1:-1][edges - 1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return Words(starts, ends, self.spans(data, starts, ends), np.searchsorted(starts, at))

    def windows(self, words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rolling hash of each run of ``size`` words in one row: (row, first word in the row, hash)."""
        n = np.maximum(words.counts - size + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = words.first[:-1][row] + pos
        return row, pos, self.spans(words.hashes, start, start + size)
