"""Substring de-duplication with a count-min prefilter.

A window is ``width`` consecutive words of one document.  A word is removed if some window
over it occurs anywhere else in the corpus (another place of the same document included).

1. *Merged partition sketches.*  A window's count is at most that of any of its sub-grams, so
   the sketch counts sub-grams only, and of these only such as are least-hashed among
   ``SPREAD`` neighbours (every window holds several, the same ones in each of its copies).  The sketch is broadcast; where the
   corpus is too large for one (``sketch.OVERLOAD``), sub-grams (of wider neighbourhoods, ``WIDE``) are counted by a shuffle
   and the levels of repeated ones come back to their documents.
2. *Estimate.*  A window's estimate is the least of its sub-grams' cells, over sub-gram
   groups that lie wholly in the window.  It is never below the true count, so windows with
   an estimate of one are unique.
3. *Exact pass.*  Only windows estimated repeated are grouped, by 128 bits of content hash,
   with map-side counts, so a passage in a third of all documents is one row a task.
   What goes back to the documents is the opposite of the answer: the few windows that
   were estimated repeated but occur once.  Each has one place, so no hot key comes back.

Edge cases: null and empty texts and those of fewer than ``width`` words keep all their words;
repeated rows (same id and text) are occurrences of their own and remove each other; rows
sharing a doc_id with other text are told apart by the text; an empty table gives an
empty result; other columns are ignored.  Window identity rests on 128-bit hashes.
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

WIDTH = 35
SPREAD, WIDE = 8, 20
BYTES_PER_CELL = 16


def _gram(width: int, spread: int) -> int:
    """Words of a sub-gram; a few groups of ``spread`` of them fit into a window."""
    return max(1, min(10, width // 2 - spread + 1))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[K.Words, np.ndarray]:
    words = K.Words(data, offsets)
    return words, words.hashes(data)


def _groups(words: K.Words, hashes: np.ndarray, k: int, spread: int):
    grams = K.group_hashes(hashes, k, 0)
    room = words.last[: len(grams)] - np.arange(len(grams)) - k + 1
    grams = np.where(room > 0, grams | K.U(1), K.U(0))
    return grams, K.minimizers(grams, spread, room)


def estimated(words: K.Words, hashes: np.ndarray, counts: sketch.Sketch | sketch.Known, width: int, k: int, spread: int) -> np.ndarray:
    """Starts of the windows whose estimate is over one."""
    _, (least, fits, _) = _groups(words, hashes, k, spread)
    turn = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(least) else np.zeros(0, np.int64)
    level = np.repeat(counts.level(least[turn]), np.diff(np.append(turn, len(least))))
    worst = K.sliding_min(level, width - k - spread + 2)
    starts = np.flatnonzero(worst > 1)
    return starts[words.last[starts] - starts >= width]


CANDIDATES = "h1 long, h2 long, row_key long, doc_id long, place int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove(docs: DataFrame, width: int = WIDTH, spread: int = SPREAD, max_cells: int = sketch.MAX_CELLS, with_text: bool = False) -> DataFrame:
    """One row per document: words, removed words, digest of what is kept (and, on request, the
    kept words as ``kept_text``)."""
    if width < 2:
        raise ValueError("a window needs two words at least")
    spread = max(1, min(spread, width // 2))
    k = _gram(width, spread)
    spark = docs.sparkSession
    docs = with_key(docs)
    texts = docs.select("text")
    log_cells = sketch.size_for(texts, BYTES_PER_CELL, max_cells)
    if log_cells is None:
        spread = max(spread, min(WIDE, width - k))

    def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, hashes = _words(data, offsets)
        grams, (_, _, chosen) = _groups(words, hashes, k, spread)
        at = np.flatnonzero(chosen)
        return grams[at], np.searchsorted(words.first, at, "right") - 1

    if log_cells is None:
        shared = None
        docs = sketch.returned(docs, anchors)
    else:
        shared = spark.sparkContext.broadcast(sketch.build(texts, lambda batch: (anchors(data, offsets)[0] for _, data, offsets in K.blocks(batch)), log_cells))
        docs = docs.withColumn("found", F.lit(None).cast(sketch.RETURNED))

    def counts_for(batch: pa.RecordBatch, row: int, n: int) -> sketch.Sketch | sketch.Known:
        return sketch.Known(batch.column("found").slice(row, n)) if shared is None else shared.value

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id")
            for row, data, offsets in K.blocks(batch):
                words, hashes = _words(data, offsets)
                starts = estimated(words, hashes, counts_for(batch, row, len(offsets) - 1), width, k, spread)
                if not len(starts):
                    continue
                doc = np.searchsorted(words.first, starts, "right") - 1
                pair = [K.group_hashes(hashes, width, 0)[starts], K.group_hashes(words.hashes(data, 1), width, 1)[starts]]
                yield pa.RecordBatch.from_arrays([*(pa.array(h.view(np.int64)) for h in pair), pa.array(keys[row + doc]), ids.take(pa.array(row + doc)), pa.array((starts - words.first[doc]).astype(np.int32))], ["h1", "h2", "row_key", "doc_id", "place"])

    once = (
        docs.mapInArrow(K.task(candidates), CANDIDATES)
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), *(F.max(c).alias(c) for c in ("row_key", "doc_id", "place")))
        .where("n = 1")
        .groupBy(F.col("row_key").alias("key"), F.col("doc_id").alias("id"))
        .agg(F.collect_list("place").alias("single"))
    )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single = batch.column("single")
            ids = batch.column("doc_id")
            for row, data, offsets in K.blocks(batch):
                words, hashes = _words(data, offsets)
                starts = estimated(words, hashes, counts_for(batch, row, len(offsets) - 1), width, k, spread)
                part = single.slice(row, len(offsets) - 1)
                lone = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(lone):
                    n = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                    starts = np.setdiff1d(starts, lone + np.repeat(words.first[:-1], n), assume_unique=True)
                gone = K.covered(starts, width, len(words.start))
                out = []
                lost = np.concatenate([[0], np.cumsum(gone)])
                lost = lost[words.first[1:]] - lost[words.first[:-1]]
                raw = data.tobytes()
                for d in range(len(offsets) - 1):
                    own = raw[offsets[d] : offsets[d + 1]].split()
                    if lost[d]:
                        keep = ~gone[words.first[d] : words.first[d + 1]]
                        own = [w for w, stays in zip(own, keep) if stays]
                    text = b" ".join(own)
                    out.append((hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if with_text else None))
                cols = [ids.slice(row, len(out)), pa.array(words.count.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array([x[0] for x in out])]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([x[1] for x in out], pa.string())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    joined = docs.join(once.hint("shuffle_hash"), (F.col("row_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select("doc_id", "text", "found", "single").mapInArrow(K.task(settle), RESULT + ", kept_text string" * with_text)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"))
