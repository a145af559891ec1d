"""Count-min sketches built by task, merged by slice, and sent to all workers.

Counters never underestimate: they only add, and stop at the greatest value of their type. The size is fixed by a power
of two between ``LEAST_BITS`` and ``MOST_BITS`` cells a row, so what the driver holds and broadcasts is bounded (two rows
of one-byte cells: 128 MB at most; sketches of wider cells stay within ``WIDE_BITS``) whatever the data; with more data
the estimates get looser, and nothing is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyrion.llm.text import arrow
from papyrion.runtime import session_of, store

ROWS, LEAST_BITS, MOST_BITS, WIDE_BITS = 2, 16, 26, 22
SLICE = 1 << 16


def bits_for(items: int) -> int:
    """Cells a row for so many different items: at least twice as many, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, int(2 * max(items, 1)).bit_length()))


class Sketch:
    def __init__(self, bits: int, cells: np.ndarray | None = None, kind: str = "uint8"):
        self.bits = bits
        self.cells = np.zeros((ROWS, 1 << bits), kind) if cells is None else cells
        self.most = np.iinfo(self.cells.dtype).max

    def _at(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return ((hashes >> np.uint64(0 if row == 0 else 64 - self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for row in range(ROWS):
            at, n = np.unique(self._at(hashes, row), return_counts=True)
            self.cells[row, at] = np.minimum(self.cells[row, at].astype(np.int64) + n, self.most)

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum(self.cells[0, self._at(hashes, 0)], self.cells[1, self._at(hashes, 1)])

    def slices(self) -> Iterator[tuple[int, bytes]]:
        flat = self.cells.reshape(-1)
        for start in range(0, flat.size, SLICE):
            part = flat[start : start + SLICE]
            if part.any():
                yield start // SLICE, zlib.compress(part.tobytes(), 1)


def _pack(slices: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return arrow({"slice": ([s for s, _ in slices], pa.int32()), "cells": ([c for _, c in slices], pa.binary())})


def merged(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, kind: str = "uint8") -> Sketch:
    """The sketch of all hashes that ``hashes_of`` yields for the batches of ``df``. Each task sends the slices it
    touched; slices are merged one at a time as they stream by, and only the merged ones reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(bits, kind=kind)
        for batch in batches:
            for hashes in hashes_of(batch):
                own.add(hashes)
        found = list(own.slices())
        for i in range(0, len(found), 64):
            yield _pack(found[i : i + 64])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(zlib.decompress(cells), kind)
                old = sums.get(s)
                sums[s] = new.copy() if old is None else np.minimum(old.astype(np.uint64) + new, np.iinfo(kind).max).astype(kind)
        for s, cells in sums.items():
            yield _pack([(s, zlib.compress(cells.tobytes(), 1))])

    schema = "slice int, cells binary"
    total = Sketch(bits, kind=kind)
    flat = total.cells.reshape(-1)
    parts = max(1, min(64, (ROWS << bits) // SLICE // 4))
    for row in store(df.mapInArrow(count, schema).repartition(parts, "slice").mapInArrow(merge, schema), "sketch").toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["cells"]), kind)
        flat[row["slice"] * SLICE : row["slice"] * SLICE + len(part)] = part
    return total


def share(df: DataFrame, sketch: Sketch):
    """The sketch as a broadcast, compressed: every executor keeps a copy on its disk. Its size is fixed, see above."""
    packed = pa.compress(sketch.cells.tobytes(), codec="zstd", asbytes=True)
    return session_of(df).sparkContext.broadcast((sketch.bits, sketch.cells.dtype.str, packed))


def opened(value: tuple[int, str, bytes]) -> Sketch:
    """A worker's own copy of a sketch that was shared."""
    bits, kind, packed = value
    size = (ROWS << bits) * np.dtype(kind).itemsize
    return Sketch(bits, np.frombuffer(pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True), kind).reshape(ROWS, -1))
