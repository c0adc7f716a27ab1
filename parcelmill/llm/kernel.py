"""Vectorised text kernels over Arrow batches: words, rolling hashes, sliding minima.

All hashes are 64-bit and depend on content alone, so equal spans get equal hashes in any
document, task and run.  ``block_bytes`` bounds the text that is expanded into numpy arrays at
a time; only a single document larger than that makes a block of its own.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 19
# A space and tab to carriage return part words.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[32, *range(9, 14)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# What an operator keeps in a Python worker from task to task.  Workers outlive their tasks, so other
# functions' tasks let go of it: a worker's memory is for the operator at work.
worker_caches: dict[str, object] = {}


def task(f: Callable, keep: str = "") -> Callable:
    """For a function over Arrow batches: when its task begins, caches other than ``keep`` are let go, and when it ends, memory that
    the worker has freed goes back to the system.  Workers are used again, and allocators keep what one operator once needed."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [k for k in worker_caches if k != keep]:
            del worker_caches[name]
        try:
            yield from f(batches)
        finally:
            tidy()

    return run


def tidy() -> None:
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, in place."""
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Rolling:
    """Hashes of all spans of a sequence by prefix sums of value * base^position modulo 2^64."""

    def __init__(self, seed: int):
        self.base = int(mix(np.array([seed], U))[0]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(0, U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)]), dtype=U) for b in (self.base, self.inverse))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = prefix[ends] - prefix[starts]
        x *= self.down[starts]
        return mix(x)

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k values from each place, as far as they go."""
        n = max(0, len(prefix) - k)
        x = prefix[k:] - prefix[:n]
        x *= self.down[:n]
        return mix(x)


_BYTES = [mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(s)) for s in (11, 77)]
_ROLL = {s: Rolling(s) for s in range(1, 9)}


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``limit`` bytes; nulls are empty."""
    limit = limit or BLOCK_BYTES
    col = batch.column(column)
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(col) == 0:
        return
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], kind, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a block: byte ``start``/``end`` of each, ``first`` word of each document (one more
    at the end), and ``last``, the end of its document's words for each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray = WORD_BYTE):
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = word_byte[data]
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:n]
        before[offsets] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n + 1, bool)  # a word byte followed by none, or by another document
        after[:n] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.last = np.repeat(self.first[1:], self.count)

    def hashes(self, data: np.ndarray, seed: int = 0) -> np.ndarray:
        roll = _ROLL[1 + seed]
        prefix = roll.prefix(_BYTES[seed][data])
        return roll.spans(prefix, self.start, self.end)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from each place; one value for each full window."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        done += step
    return x


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.maximum(x[:-step], x[step:]) if len(x) > step else x[:0]
        done += step
    return x


def group_hashes(values: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each run of k values."""
    roll = _ROLL[3 + seed]
    return roll.windows(roll.prefix(values), k)


def minimizers(grams: np.ndarray, w: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of w grams the least hash; which runs lie in one document; which grams are
    least in such a run.  ``room``: grams from each place to its document's end."""
    n = len(grams)
    least = sliding_min(grams, w)
    fits = room[: len(least)] >= w
    seen = np.zeros(n + w - 1, U)
    seen[w - 1 : w - 1 + len(least)] = np.where(fits, least, U(0))
    chosen = (sliding_max(seen, w)[:n] == grams) & (grams != U(0)) if len(least) else np.zeros(n, bool)
    return least, fits, chosen


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a span of ``width`` from one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0
