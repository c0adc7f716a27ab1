"""A count-min sketch of content hashes, built from merged partition sketches.

Each task counts its own hashes and emits, for every touched block of 2^16 cells, the cells as
16-bit places: those counted once, and those counted more often with their counts.  Blocks are
merged by key in the cluster; counts are added exactly before they are stored as powers of two in
four bits, rounded down, so every power from two up still proves "may repeat" and one proves "once".
A stored cell is never below the true level of a hash in it.

The table that reaches the driver and is broadcast has at most ``rows * max_cells / 2`` bytes
(64 MB by default).  A text of more than ``OVERLOAD`` times what those cells are meant for would fill them, so
that everything seems to repeat; there counts are tables instead, which grow with the input and never leave the
cluster: hashes are counted by a shuffle, and those that occur more than once come back to their documents (``returned``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

BITS = 16
ROWS = 2
MAX_CELLS = 1 << 26
OVERLOAD = 2
FLUSH = 1 << 22
U = np.uint64
MULTIPLIERS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)]
SCHEMA = "block int, once binary, more binary, counts binary"
_ARROW = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])


def cells(hashes: np.ndarray, log_cells: int, rows: int = ROWS) -> Iterator[np.ndarray]:
    # Least hashes have small high bits, so every row multiplies before it takes them.
    for k in range(rows):
        yield ((hashes * MULTIPLIERS[k]) >> U(64 - log_cells)).astype(np.int64) + (k << log_cells)


def _emit(found: list[np.ndarray], log_cells: int, n_rows: int) -> Iterator[pa.RecordBatch]:
    hashes = np.concatenate(found)
    for at in cells(hashes, log_cells, n_rows):
        at.sort()
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        counts, at = np.diff(np.append(first, len(at))).astype(np.uint32), at[first]
        block, place = at >> BITS, (at & ((1 << BITS) - 1)).astype(np.uint16)
        ids, starts = np.unique(block, return_index=True)
        rows: list[tuple] = []
        for b, s, e in zip(ids, starts, np.append(starts[1:], len(at))):
            single = counts[s:e] == 1
            rows.append((int(b), place[s:e][single].tobytes(), place[s:e][~single].tobytes(), counts[s:e][~single].tobytes()))
            if len(rows) >= 1024:
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in rows], _ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in rows], _ARROW)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, once, more, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if (cell := total.get(b)) is None:
                cell = total[b] = np.zeros(1 << BITS, np.uint32)
            cell[np.frombuffer(once, np.uint16)] += np.uint32(1)
            at = np.frombuffer(more, np.uint16)
            if len(at):
                more_counts = np.frombuffer(counts, np.uint32)
                cell[at] = np.minimum(cell[at].astype(np.int64) + more_counts, 1 << 31).astype(np.uint32)
    for b, cell in total.items():
        level = np.minimum(np.frexp(cell.astype(np.float64))[1], 15).astype(np.uint8)
        yield pa.RecordBatch.from_pylist([{"block": b, "level": (level[::2] | (level[1::2] << 4)).tobytes()}], pa.schema([("block", pa.int32()), ("level", pa.binary())]))


class Sketch:
    """Levels: 0 for none, 1 for a count of one, k for 2^(k-1) up to 2^k - 1, at most 15."""

    def __init__(self, table: np.ndarray, log_cells: int, rows: int = ROWS):
        self.table, self.log_cells, self.rows = table, log_cells, rows

    def level(self, hashes: np.ndarray) -> np.ndarray:
        least = None
        for at in cells(hashes, self.log_cells, self.rows):
            x = self.table[at >> 1]
            x = np.where(at & 1, x >> 4, x & 15)
            least = x if least is None else np.minimum(least, x)
        return least


def size_for(docs: DataFrame, bytes_per_cell: int, max_cells: int = MAX_CELLS) -> int | None:
    """log2 of the cells of a row, from the bytes of all texts; None where a sketch would be overloaded."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if n > OVERLOAD * bytes_per_cell * max_cells:
        return None
    return min(max(n // bytes_per_cell, 1 << BITS), max(max_cells, 1 << BITS)).bit_length() - 1


class Known:
    """Exact levels of the hashes that occur more than once, as they came back to some documents."""

    def __init__(self, found: pa.ListArray):
        each = found.flatten()
        hashes, levels = (each.field(k).to_numpy(zero_copy_only=False) for k in ("h", "level"))
        self.hashes, at = np.unique(hashes.view(U), return_index=True)
        self.levels = levels.astype(np.uint8)[at]

    def level(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(hashes), np.uint8)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.levels[at], 1).astype(np.uint8)


RETURNED = "array<struct<h:bigint,level:int>>"


def returned(docs: DataFrame, hashes_of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``docs`` with ``found``, the hashes of each row that occur more than once in all rows, and their levels.

    ``hashes_of`` gives the hashes of a block and the document of each.  A hash in a third of all documents is counted in
    each task first; on the way back its rows are an ordinary join's, which the skew join splits."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            for row, data, offsets in kernel.blocks(batch):
                hashes, doc = hashes_of(data, offsets)
                order = np.lexsort((hashes, doc))
                hashes, doc = hashes[order], doc[order]
                new = np.ones(len(order), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[row + doc[at]]), pa.array(hashes[at].view(np.int64)), pa.array(times.astype(np.int32))], ["of", "h", "times"])

    rows = docs.select("row_key", "text").mapInArrow(kernel.task(each), "of long, h long, times int")
    counts = rows.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1")
    level = F.least(F.floor(F.log2("n")) + 1, F.lit(15)).cast("int")
    back = rows.select("of", "h").join(counts.select("h", level.alias("level")), "h").groupBy("of").agg(F.collect_set(F.struct("h", "level")).alias("found"))
    return docs.join(back, F.col("row_key") == F.col("of"), "left").drop("of").withColumn("found", F.coalesce("found", F.array().cast(RETURNED)))


def build(docs: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log_cells: int, rows: int = ROWS) -> Sketch:
    """The merged sketch of ``hashes_of`` over all batches of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            for h in hashes_of(batch):
                found.append(h)
                n += len(h)
                if n >= FLUSH:
                    yield from _emit(found, log_cells, rows)
                    found, n = [], 0
        if n:
            yield from _emit(found, log_cells, rows)

    parts = docs.mapInArrow(kernel.task(count), SCHEMA).repartition(F.col("block")).mapInArrow(kernel.task(_merge), "block int, level binary")
    table = np.zeros((rows << log_cells) >> 1, np.uint8)
    half = 1 << (BITS - 1)
    for row in parts.collect():
        table[row.block * half : (row.block + 1) * half] = np.frombuffer(row.level, np.uint8)
    return Sketch(table, log_cells, rows)
