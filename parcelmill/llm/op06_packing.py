"""Best-fit packing of tokenised documents into sequences of a fixed size.

A document is its ids and one closing id; only documents longer than ``capacity`` are cut.
Packing runs in bulk-synchronous rounds:

* pieces are range-sorted by falling length in the cluster, which gives every piece its rank;
* a length is at most ``capacity``, so the sorted pieces are runs of equal length, and the
  sorted gaps are runs of sequences that share a gap.  The rounds work on those runs;
* in a round every open sequence looks up its successor, the longest piece that fits it: one
  sweep over both sorted run lists.  Where several want the same piece, rank decides: the
  k-th gets index max(its own successor, the one before plus one);
* gaps are updated, runs split where they have to, and the next round begins.  What fits no gap
  opens new sequences, as many as its tokens need at least.

The runs have at most ``capacity`` lengths, so the tables of a round are small whatever the
number of documents; the pieces themselves never leave the cluster.  Each finds its place
by rank in the list of matched runs.

Edge cases: null and empty texts are one closing id; repeated rows are packed as often as they
occur; equal lengths are ranked by digest, id and piece; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import cut, table

CAPACITY = 4096
END_ID = 1
MEMO_BYTES = 120 << 20  # for a worker's chunks and their ids, with what Python needs for an entry
ENTRY_BYTES = 190
DIGITS = "0123456789"
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII's, without the apostrophe
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANKED = PIECES + ", part int, place long"
RESULT = PIECES + ", sequence_id long, offset long"


class Encoder(dict):
    """Ids of blank-separated chunks, as bytes.  Chunks never share a token, so the ids of a text are
    those of its chunks in turn; frequent chunks are looked up instead of encoded again.

    Nor do a chunk's runs of letters, of ASCII signs and its single digits.  A run that the normaliser changes letter
    by letter at most goes straight to the tokeniser's model, spelled as its normaliser and byte level spell those letters;
    all else, apostrophes among it (they open endings such as 's), goes through the whole tokeniser."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spelled = {ord(c): c for c in SIGNS + DIGITS}
        letters = ""
        # Latin, Greek and Cyrillic: no two letters of these compose.  A letter joins its neighbours' run, a mark doesn't.
        for c in map(chr, range(0x41, 0x530)):
            plain = self.tokenizer.normalizer.normalize_str(c)
            parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{plain}a")
            if len(plain) == len(parts) == 1:
                self.spelled[ord(c)] = parts[0][0][1:-1]
                letters += c
        self.runs = re.compile(f"[{letters}]+|[{DIGITS}]|[{re.escape(SIGNS)}]+")
        self.plain = re.compile(f"[{letters}{DIGITS}{re.escape(SIGNS)}]+")
        self.size = 0

    def __missing__(self, chunk: str) -> bytes:
        if "<|" in chunk or not self.plain.fullmatch(chunk):
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes() if chunk else b""
        elif len(runs := self.runs.findall(chunk)) > 1:
            ids = b"".join(map(self.__getitem__, runs))
        else:
            found = [token.id for token in self.model.tokenize(chunk.translate(self.spelled))]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(chunk) <= 64:
            if self.size >= MEMO_BYTES:
                for old in list(self)[len(self) // 2 :]:  # the first chunks met are mostly frequent ones
                    del self[old]
                self.size = sum(ENTRY_BYTES + len(k) + len(v) for k, v in self.items())
            self[chunk] = ids
            self.size += ENTRY_BYTES + len(chunk) + len(ids)
        return ids

    def ids(self, text: str) -> bytes:
        if text.isascii() and "<|" not in text:
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def encoder_of(path: str) -> Encoder:
    """One encoder for each Python worker, kept over its tasks until another operator's task comes."""
    if path not in kernel.worker_caches:
        kernel.worker_caches[path] = Encoder(path)
    return kernel.worker_caches[path]


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenised(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it starts in its document, its length and the digest of its ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        close = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows, ids = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = encoder.ids(text.as_py() or "") + close
                for k in range(0, len(data), 4 * capacity):
                    part = data[k : k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
                    ids.append(part) if with_ids else None
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(kernel.task(pieces, vocabulary), PIECES + ", ids binary" * with_ids)


def match(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Matched runs (length, first rank, sequences, first sequence, offset, copies): pieces of that
    length from that rank on go, ``copies`` to each, into the sequences from the first one on.

    ``lengths`` falls strictly; rank counts the pieces of a length from 0.
    """
    left = counts.astype(np.int64).copy()
    rank = np.zeros(len(lengths), np.int64)
    lengths = lengths.astype(np.int64)
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), by falling gap
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    while left.any():
        live = np.flatnonzero(left)
        size, number = lengths[live], left[live].copy()
        first = np.concatenate([[0], np.cumsum(number)])  # index of each length's first piece
        taken = np.zeros(len(live), np.int64)
        after: list[tuple[int, int, int]] = []
        at, moved = 0, False
        for gap, seq, n in gaps:
            fit = int(np.searchsorted(-size, -gap))  # the successor: the longest length that fits
            at = max(at, int(first[fit]) if fit < len(size) else int(first[-1]))
            while n and at < first[-1]:
                k = int(np.searchsorted(first, at, "right")) - 1
                room = int(first[k + 1]) - at
                copies = max(1, min(gap // int(size[k]), room // n))
                m = min(n, room // copies)
                runs.append((int(size[k]), int(rank[live[k]] + at - first[k]), m, seq, capacity - gap, copies))
                taken[k] += m * copies
                after.append((gap - int(size[k]) * copies, seq, m))
                at, seq, n, moved = at + m * copies, seq + m, n - m, True
            if n:
                after.append((gap, seq, n))
        # Pieces are taken as unbroken index ranges of a length only if sweeps don't leave holes in it.
        if moved:
            _settle(runs, size, first, rank, live, taken)
            left[live] -= taken
            rank[live] += taken
        else:
            opened = min(int(number.sum()), max(1, -(-int((size * number).sum()) // capacity)))
            for k in range(len(live)):
                m = min(opened, int(number[k]))
                if not m:
                    break
                runs.append((int(size[k]), int(rank[live[k]]), m, sequences, 0, 1))
                after.append((capacity - int(size[k]), sequences, m))
                left[live[k]] -= m
                rank[live[k]] += m
                sequences, opened = sequences + m, opened - m
        smallest = int(lengths[left > 0][-1]) if left.any() else capacity + 1
        gaps = sorted((g for g in after if g[0] >= smallest), reverse=True)
    return np.array(runs, np.int64).reshape(-1, 6)


def _settle(runs: list, size: np.ndarray, first: np.ndarray, rank: np.ndarray, live: np.ndarray, taken: np.ndarray) -> None:
    """Close the holes a sweep left within a length: pieces of one length are alike, so the runs
    of this round take their ranks without gaps."""
    following = {int(s): int(rank[live[k]]) for k, s in enumerate(size) if taken[k]}
    total = int(taken.sum())
    k = len(runs)
    while total:
        k -= 1
        total -= runs[k][2] * runs[k][5]
    for j in range(k, len(runs)):
        s, _, m, seq, offset, copies = runs[j]
        runs[j] = (s, following[s], m, seq, offset, copies)
        following[s] += m * copies


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    spark = docs.sparkSession

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n))], [*batch.schema.names, "part", "place"])
            place += n

    pieces = cut(tokenised(docs, vocabulary, capacity))
    order = [F.col("length").desc(), "ids_crc32", "doc_id", "piece"]
    ranked = cut(pieces.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(kernel.task(number), RANKED))
    # Parts are ranges of length, so there are at most as many rows as lengths and parts together.
    runs = ranked.groupBy("part", "length").count().orderBy("part", F.desc("length")).toPandas()
    by_length = runs.groupby("length")["count"].sum().sort_index(ascending=False)
    matched = match(by_length.index.to_numpy(np.int64), by_length.to_numpy(np.int64), capacity)
    matched = matched[np.lexsort((matched[:, 1], matched[:, 0]))]
    runs["first"] = runs.groupby("length")["count"].cumsum() - runs["count"]  # rank at the part's first piece
    runs["skip"] = runs.groupby("part")["count"].cumsum() - runs["count"]  # its place in the part
    shift = {(int(p), int(n)): int(f - s) for p, n, f, s in runs[["part", "length", "first", "skip"]].itertuples(index=False)}
    shared = spark.sparkContext.broadcast((matched, shift))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matched, shift = shared.value
        scale = 1 << 40
        starts = matched[:, 0] * scale + matched[:, 1]
        for batch in batches:
            length, part, place = (batch.column(c).to_numpy() for c in ("length", "part", "place"))
            pair, at = np.unique(np.stack([part.astype(np.int64), length]), axis=1, return_inverse=True)
            moved = np.array([shift[int(p), int(n)] for p, n in pair.T], np.int64)
            rank = place + (moved[at.reshape(-1)] if len(moved) else 0)
            run = matched[np.searchsorted(starts, length * scale + rank, "right") - 1]
            within = rank - run[:, 1]
            sequence, copy = run[:, 3] + within // run[:, 5], within % run[:, 5]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(run[:, 4] + copy * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(kernel.task(assign), RESULT)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"))
