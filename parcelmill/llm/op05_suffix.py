"""Suffix-array de-duplication by longest-previous-factor (LPF) arrays.

A byte is removed if a ``length``-byte string over it also starts earlier: in a document of smaller
doc_id, or earlier in the same one.  In terms of LPF: all ``length`` bytes from each place whose
longest previous factor is ``length`` or more.

One suffix array of a whole corpus fits no machine, so suffixes are dealt out by content:

1. A merged count-min sketch holds how often short grams occur.  A string with a gram seen once
   cannot repeat, which settles nearly all places of unrepeated text.  The sketch is broadcast; where the corpus is too
   large for one (``sketch.OVERLOAD``), grams (of wider neighbourhoods, ``WIDE``) are counted by a shuffle and the
   levels of repeated ones come back to their documents.
2. Every other string is dealt by its *rarest* gram (least level in the sketch, then least hash), which
   equal strings share.  Strings in a row with the same rarest gram travel as one segment.  The
   rarest gram keeps a common phrase out of its neighbours' buckets: only strings that lie
   wholly in the phrase are dealt by it, and those are the same in all copies.
3. Equal segments are merged before the shuffle, within each task, keeping the earliest; so a
   passage in a third of all documents sends one row from each task.
4. In its bucket, sorted suffixes of the distinct segments are ranked by prefix doubling; LPF comes
   from the previous and next smaller position in suffix order, with the least common prefix on
   the way.  Buckets are streamed in sorted order, a few MB at a time.
5. What returns to the documents is small and never skewed: for each distinct segment's earliest
   place, the strings there that have no earlier match.  All else of a segment goes.

Edge cases: null and empty texts have no bytes; texts shorter than ``length`` stay; repeated rows of
one doc_id keep one copy each of the text's own first occurrence: rows of equal doc_id
and equal text are ranked as one document that stands once and are kept alike; rows sharing a
doc_id with other text follow each other by text hash; a null doc_id comes first; an empty table gives an
empty result; other columns are ignored.  Grams are compared by 64-bit hash, suffixes by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from . import sketch
from .common import table, with_key

LENGTH = 100
GRAM = 24
SPREAD, WIDE = 28, 60
HOT = 12  # levels are powers of two
HASHED = 16  # bytes of a string's hash
BYTES_PER_CELL = 4
MAX_CELLS = 1 << 27  # one row, 64 MB: as good here as two of half the size, and half as much to merge
CHUNK = 1 << 20
NO_ID = -(1 << 63)


def _shape(length: int, exact: bool = False) -> tuple[int, int]:
    gram = max(1, min(GRAM, length // 4))
    return gram, max(1, min(WIDE, length - gram) if exact else min(SPREAD, length // 2 - gram + 1))


def _grams(data: np.ndarray, offsets: np.ndarray, gram: int, spread: int):
    """Least gram hash of each run of ``spread`` places; bytes from each place to its document's end."""
    roll = K._ROLL[5]
    hashes = roll.windows(roll.prefix(K._BYTES[0][data]), gram)
    hashes |= K.U(1)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    fits = room[: len(hashes)] >= gram
    hashes[~fits] = 0
    return hashes, room, K.minimizers(hashes, spread, room[: len(hashes)] - gram + 1)


def segments(data: np.ndarray, offsets: np.ndarray, counts: sketch.Sketch | sketch.Known, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rarest gram's level and hash, first string, last string) of the segments of strings that may repeat."""
    gram, spread = _shape(length, isinstance(counts, sketch.Known))
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(K.U), none, none
    _, room, (least, _, _) = _grams(data, offsets, gram, spread)
    turn = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    # Level, then hash: one number that orders grams from rare to common.
    rank = (counts.level(least[turn]).astype(K.U) << K.U(60)) | (least[turn] >> K.U(4))
    rank = K.sliding_min(np.repeat(rank, np.diff(np.append(turn, len(least)))), length - gram - spread + 2)
    can = (rank >> K.U(60) > 1) & (room[: len(rank)] >= length)
    edge = np.flatnonzero(np.diff(can.astype(np.int8), prepend=0, append=0))
    change = np.flatnonzero(np.concatenate([[False], can[1:] & can[:-1] & (rank[1:] != rank[:-1])]))
    first = np.union1d(edge[::2], change)
    last = np.union1d(edge[1::2] - 1, change - 1)
    # Equal neighbours of one rank may belong to two documents.
    doc_edge = np.searchsorted(offsets, first, "right") != np.searchsorted(offsets, last, "right")
    assert not doc_edge.any()
    return (rank[first] if len(first) else none.astype(K.U)), first, last


def _bucket(hashes: np.ndarray, shift: int) -> np.ndarray:
    """32 bits of a gram's hash, the same ones from the hash (shift 12) and from its rank (shift 8)."""
    return ((hashes >> K.U(shift)) & K.U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def suffix_order(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first ``length`` bytes, ties by position, and the common prefix of each
    with the one before: exact up to ``length`` where it is that long, else a lower bound (the
    largest doubling step that still agrees)."""
    n = len(data) - length + 1
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(len(data), K.U)
    for k in range(8):
        key = (key << K.U(8)) | pad[k : k + len(data)].astype(K.U)
    at = len(data) - 7 if len(data) > 7 else 0
    step, levels = 8, []
    if length < 8:
        key, step = key >> K.U(8 * (8 - length)), length
        at = n
    rank = np.unique(key[:at] if at else key, return_inverse=True)[1].reshape(-1)
    levels.append((step, rank))
    while step < length:
        jump = min(step, length - step)
        m = len(data) - (step + jump) + 1
        pair = (rank[:m].astype(K.U) << K.U(32)) | rank[jump : jump + m].astype(K.U)
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
        step += jump
        levels.append((step, rank))
    order = np.argsort(rank[:n], kind="stable")
    common = np.zeros(n, np.int64)
    for size, level in levels:
        same = level[order[1:]] == level[order[:-1]]
        common[1:][same] = size
    return order, common


def previous_factors(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """LPF by suffix position: the longer common prefix with the nearest smaller position before,
    and after, in suffix order; found by jumping along smaller positions."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    for flip in (False, True):
        pos = order[::-1] if flip else order
        # with_before[i]: common prefix of i and i - 1 in this direction
        with_before = np.zeros(n, np.int64)
        with_before[1:] = common[:0:-1] if flip else common[1:]
        jump, least = np.arange(-1, n - 1), with_before.copy()
        live = np.flatnonzero((jump >= 0) & (least > 0))
        live = live[pos[jump[live]] > pos[live]]
        while len(live):
            # The place jumped to has resolved its own way at least one step: go where it points.
            to = jump[live]
            least[live] = np.minimum(least[live], least[to])
            jump[live] = jump[to]
            on = (jump[live] >= 0) & (least[live] > 0)
            least[live[jump[live] < 0]] = 0
            live = live[on]
            live = live[pos[jump[live]] > pos[live]]
        least[jump < 0] = 0
        out[pos] = np.maximum(out[pos], least)
    return out


SEGMENTS = "gram int, doc_id long, row_key int, first int, body binary"
_NAMES = [x.split()[0] for x in SEGMENTS.split(", ")]
KEPT = "row_key int, doc_id long, first int, last int"


def _sizes(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all bodies, one after the other, and where each begins (one more at the end)."""
    at = np.frombuffer(bodies.buffers()[1], np.int32, len(bodies) + 1 + bodies.offset)[bodies.offset :].astype(np.int64)
    return np.frombuffer(bodies.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def _earliest(doc: np.ndarray, key: np.ndarray, first: np.ndarray, bodies: pa.Array) -> np.ndarray:
    """Rows that are the earliest (doc_id, row_key, first) of their body, by 128 bits of hash."""
    data, at = _sizes(bodies)
    h1, h2 = np.empty(len(doc), K.U), np.empty(len(doc), K.U)
    k = 0
    while k < len(doc):  # about a MB of bodies at a time
        e = max(k + 1, int(np.searchsorted(at, at[k] + K.BLOCK_BYTES, "right")) - 1)
        part = data[at[k] : at[e]]
        for h, seed in ((h1, 0), (h2, 1)):
            roll = K._ROLL[7 + seed]
            h[k:e] = roll.spans(roll.prefix(K._BYTES[seed][part]), at[k:e] - at[k], at[k + 1 : e + 1] - at[k])
        k = e
    order = np.lexsort((first, key, doc, h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    return order[new]


def _unmatched(gram: np.ndarray, doc: np.ndarray, key: np.ndarray, first: np.ndarray, bodies: pa.Array, length: int) -> Iterator[pa.RecordBatch]:
    """Runs of strings with no earlier match, for whole buckets."""
    pick = _earliest(doc, key, first, bodies)
    # Of strings that came as hashes the earliest is free, and all others are not.
    at = np.frombuffer(bodies.buffers()[1], np.int32, len(bodies) + 1 + bodies.offset)[bodies.offset :]
    short = np.diff(at)[pick] == HASHED
    if length > HASHED and short.any():
        own = pick[short]
        yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(doc[own]), pa.array(first[own]), pa.array(first[own])], ["row_key", "doc_id", "first", "last"])
        pick = pick[~short]
    if not len(pick):
        return
    # A bucket's only segment has no earlier match but in itself, for which its gram must come twice.
    data, at = _sizes(bodies.take(pa.array(pick)))
    seg = np.repeat(np.arange(len(pick)), np.diff(at))
    grams = _bucket(K._ROLL[5].windows(K._ROLL[5].prefix(K._BYTES[0][data]), _shape(length)[0]), 12)
    same = grams == gram[pick][seg[: len(grams)]]
    _, of, many = np.unique(gram[pick], return_inverse=True, return_counts=True)
    alone = (many[of] == 1) & (np.bincount(seg[: len(grams)][same], minlength=len(pick)) < 2)
    lone = pick[alone]
    if len(lone):
        last = first[lone] + np.diff(at)[alone] - length
        yield pa.RecordBatch.from_arrays([pa.array(key[lone]), pa.array(doc[lone]), pa.array(first[lone]), pa.array(last.astype(np.int32))], ["row_key", "doc_id", "first", "last"])
    pick = pick[~alone]
    if not len(pick):
        return
    pick = pick[np.lexsort((first[pick], key[pick], doc[pick]))]  # text order
    bodies = bodies.take(pa.array(pick))
    raw, start = _sizes(bodies)
    sizes, start = np.diff(start), start[:-1]
    order, common = suffix_order(raw, length)
    # Suffixes that would run from one segment into the next aren't strings of the text.
    room = np.repeat(start + sizes, sizes)[: len(order)] - np.arange(len(order))
    own = room[order] >= length
    # Taking suffixes out of the order leaves, between two that stay, the least prefix on the way.
    group = np.cumsum(own) - 1
    kept_common = np.full(int(own.sum()), length, np.int64)
    inside = group >= 0
    np.minimum.at(kept_common, np.where(own, group, group + 1)[inside & (np.where(own, group, group + 1) < len(kept_common))], common[inside & (np.where(own, group, group + 1) < len(kept_common))])
    order = order[own]
    dense = np.cumsum(room >= length) - 1
    lpf = previous_factors(dense[order], kept_common)
    free = np.zeros(len(raw) + 1, bool)
    places = np.flatnonzero(room >= length)
    free[places] = lpf < length
    seg = np.repeat(np.arange(len(pick)), sizes)
    edge = np.zeros(len(raw) + 1, bool)
    edge[start] = True
    begin = np.flatnonzero(free[:-1] & (edge[:-1] | ~np.concatenate([[False], free[:-2]])))
    stop = np.flatnonzero(free[:-1] & (edge[1:] | ~free[1:]))
    of = seg[begin]
    base = first[pick][of] - start[of]
    yield pa.RecordBatch.from_arrays([pa.array(key[pick][of]), pa.array(doc[pick][of]), pa.array((begin + base).astype(np.int32)), pa.array((stop + base).astype(np.int32))], ["row_key", "doc_id", "first", "last"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove(docs: DataFrame, length: int = LENGTH, max_cells: int = MAX_CELLS, with_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, digest of what is kept (and, on
    request, the kept bytes as ``kept``)."""
    spark = docs.sparkSession
    # 32 bits tell rows of one doc_id apart.
    docs = with_key(docs).select("doc_id", "text", "row_key", F.hash("row_key").alias("short_key"))

    texts = docs.select("text")
    log_cells = sketch.size_for(texts, BYTES_PER_CELL, max_cells)
    exact = log_cells is None
    gram, spread = _shape(length, exact)

    def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) < gram + spread:
            return np.zeros(0, K.U), np.zeros(0, np.int64)
        hashes, _, (_, _, chosen) = _grams(data, offsets, gram, spread)
        at = np.flatnonzero(chosen)
        return hashes[at], np.searchsorted(offsets, at, "right") - 1

    if exact:
        shared = None
        docs = sketch.returned(docs, anchors)
    else:
        shared = spark.sparkContext.broadcast(sketch.build(texts, lambda batch: (anchors(data, offsets)[0] for _, data, offsets in K.blocks(batch)), log_cells, rows=1))
        docs = docs.withColumn("found", F.lit(None).cast(sketch.RETURNED))
    docs = docs.drop("row_key")

    def counts_for(batch: pa.RecordBatch, row: int, n: int) -> sketch.Sketch | sketch.Known:
        return sketch.Known(batch.column("found").slice(row, n)) if exact else shared.value

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of a task, equal ones merged as far as they are held together."""
        held: list[tuple[list[np.ndarray], pa.Array]] = []
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            gram, doc, key, first = (np.concatenate([h[0][k] for h in held]) for k in range(4))
            bodies = pa.concat_arrays([h[1] for h in held])
            pick = _earliest(doc, key, first, bodies)
            for k in range(0, len(pick), 20_000):
                p = pick[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[p]) for c in (gram, doc, key, first)), bodies.take(pa.array(p))], _NAMES)

        for batch in batches:
            keys = batch.column("short_key").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for row, data, offsets in K.blocks(batch):
                rarest, first, last = segments(data, offsets, counts_for(batch, row, len(offsets) - 1), length)
                if not len(first):
                    continue
                often = rarest >> K.U(60) >= hot
                if length > HASHED and often.any():
                    sizes = (last - first + 1)[often]
                    at = np.repeat(first[often] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    pair = [K._ROLL[7 + seed].spans(K._ROLL[7 + seed].prefix(K._BYTES[seed][data]), at, at + length) for seed in (0, 1)]
                    doc = np.searchsorted(offsets, at, "right") - 1
                    body = np.stack(pair, axis=1).reshape(-1).view(np.uint8)
                    place = np.arange(0, len(body) + 1, HASHED, dtype=np.int32)
                    bodies = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(place.tobytes()), pa.py_buffer(body.tobytes())])
                    held.append(([_bucket(pair[0], 8), ids[row + doc], keys[row + doc], (at - offsets[doc]).astype(np.int32)], bodies))
                    size += 2 * len(body)
                    rarest, first, last = rarest[~often], first[~often], last[~often]
                if not len(first):
                    continue
                doc = np.searchsorted(offsets, first, "right") - 1
                ends = np.cumsum(last + length - first)
                body = np.empty(int(ends[-1]), np.uint8)
                src = np.repeat(first - np.concatenate([[0], ends[:-1]]), last + length - first) + np.arange(len(body))
                np.take(data, src, out=body)
                place = np.concatenate([[0], ends]).astype(np.int32)
                bodies = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(place.tobytes()), pa.py_buffer(body)])
                held.append(([_bucket(rarest, 8), ids[row + doc], keys[row + doc], (first - offsets[doc]).astype(np.int32)], bodies))
                size += len(body)
                if size >= 16 * CHUNK:
                    yield from merged()
                    held, size = [], 0
        if held:
            yield from merged()

    def settle_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            whole = whole.combine_chunks()
            yield from _unmatched(*(whole.column(c).to_numpy() for c in _NAMES[:4]), whole.column("body").chunk(0), length)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK:
                whole = pa.Table.from_batches(held)
                grams = whole.column("gram").to_numpy()
                edge = int(np.searchsorted(grams, grams[-1]))  # the last bucket may go on
                if edge:
                    yield from flush(whole.slice(0, edge))
                held = whole.slice(edge).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held) if edge else 0
        if held and sum(b.num_rows for b in held):
            yield from flush(pa.Table.from_batches(held))

    parts = docs.mapInArrow(K.task(found), SEGMENTS).repartition(F.col("gram")).sortWithinPartitions("gram")
    kept = parts.mapInArrow(K.task(settle_buckets), KEPT)
    kept = kept.groupBy(F.col("row_key").alias("key"), F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("first", "last")).alias("free"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, free = batch.column("doc_id"), batch.column("free")
            for row, data, offsets in K.blocks(batch):
                n = len(offsets) - 1
                _, first, last = segments(data, offsets, counts_for(batch, row, n), length)
                gone = np.zeros(len(data) + 1, np.int32)
                np.add.at(gone, first, 1)
                np.add.at(gone, last + 1, -1)
                part = free.slice(row, n)
                spans = part.flatten()
                if len(spans):
                    shift = np.repeat(offsets[:-1], part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                    np.add.at(gone, spans.field("first").to_numpy(zero_copy_only=False) + shift, -1)
                    np.add.at(gone, spans.field("last").to_numpy(zero_copy_only=False) + shift + 1, 1)
                gone = K.covered(np.flatnonzero(np.cumsum(gone[:-1]) > 0), length, len(data))
                before = np.concatenate([[False], gone[:-1]])
                before[offsets[:-1][offsets[:-1] < len(data)]] = False
                lost, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, gone & ~before))
                lost, runs = lost[offsets[1:]] - lost[offsets[:-1]], runs[offsets[1:]] - runs[offsets[:-1]]
                out = []
                for d in range(n):
                    own = data[offsets[d] : offsets[d + 1]]
                    own = (own[~gone[offsets[d] : offsets[d + 1]]] if lost[d] else own).tobytes()
                    out.append((hashlib.sha256(own).hexdigest(), own if with_bytes else None))
                cols = [ids.slice(row, n), pa.array(np.diff(offsets)), pa.array(lost.astype(np.int64)), pa.array(runs.astype(np.int64)), pa.array([x[0] for x in out])]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([x[1] for x in out], pa.binary())] * with_bytes, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes)

    same = (F.col("short_key") == F.col("key")) & (F.coalesce(F.col("doc_id"), F.lit(NO_ID).cast("long")) == F.col("id"))
    joined = docs.join(kept.hint("shuffle_hash"), same, "left")
    return joined.select("doc_id", "text", "found", "free").mapInArrow(K.task(settle), RESULT + ", kept binary" * with_bytes)


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"))
