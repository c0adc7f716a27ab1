"""Ranked lexical search over a tiered index.

A document's score for an item is the sum over the item's terms of its *gains*: a term's weight times a part that grows with the term's
occurrences and falls with the document's length (all whole numbers, see ``gains``).

1. *Forward pass.*  All documents are cut into terms; kept are each document's number of terms and its occurrences of the terms that
   the items ask for.  Postings of other terms are never asked for, so they are not made.
2. *Tiers.*  Documents are put into blocks, and a block's postings into ``TIERS`` columns by their gain, the highest first, so a search reads the
   tiers that it needs and no others.  Each term has a *residual bound* for each tier: its largest gain in the tiers below.
3. *Search.*  From the tiers read so far each document has a lower bound.  The k-th best lower bound of an item is its floor.  A document
   that was not met can have the sum of the item's residual bounds at most.  If that is below the floor, the item is *proven*: only documents
   whose lower bound and residual bounds of terms not met reach the floor can be among the best, and they are scored in full
   from the forward table.  Items without that proof go on to the next tier, and in the last one every posting has been read.

So results are exact for every item, whatever its terms.  No pair of item and document is moved before it is among the best of its task or
a candidate of a proven item.  Items are searched in slices whose terms fit into ``TERMS``, which bounds what the driver and each task hold.

Edge cases: a null text has no terms; documents without terms don't count; of benchmark rows equal in id and text one is answered, and rows that
share an id with other texts, or have none, are answered each; documents with equal scores are ordered by doc_id, those without one last, and
repeated rows all stand in the result; an item without terms, or whose terms no document has, gives no row; empty tables give an
empty result; other columns are ignored, whatever their names.  Terms are compared by 64-bit hash.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import kernel as K
from .common import cut, dropped, shared_dir, small, table

BEST = 20
#: A posting's tier: the first whose share of the largest possible gain it reaches.
TIERS = (1 / 8, 1 / 16, 1 / 32, 0)
#: Terms of items (with repeats in different items) that are searched at a time, 20 bytes each.
TERMS = 1_000_000
#: Documents and postings of a block, at most.
DOCS, POSTINGS = 2048, 400_000
#: Gains that are added up at a time in a task.
STEP = 1 << 21
ROWS = 200_000
TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of terms of each document; document, term, occurrences of each distinct pair) of a block."""
    data = K.LOWER[data]
    words = K.Words(data, offsets, TERM_BYTE)
    term = words.hashes(data)
    doc = np.repeat(np.arange(len(words.count)), words.count)
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return words.count, doc[at], term[at], np.diff(np.append(at, len(doc)))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of the items."""
    for batch in batches:
        item = batch.column("item").to_numpy()
        for row, data, offsets in K.blocks(batch):
            _, doc, term, times = terms_of(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(item[row + doc]), pa.array(term.view(np.int64)), pa.array(times.astype(np.int64))], ["item", "term", "times"])


FORWARD = "row long, doc_id long, n long, terms binary, times binary"


def _forward(wanted: np.ndarray) -> Callable:
    """Each document's number of terms, and places in ``wanted`` and occurrences of those that are asked for."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in K.blocks(batch):
                count, doc, term, times = terms_of(data, offsets)
                at = np.searchsorted(wanted, term)
                at[at == len(wanted)] = 0
                hit = wanted[at] == term if len(wanted) else np.zeros(len(term), bool)
                doc, at, times = doc[hit], at[hit].astype(np.int32), times[hit].astype(np.int64)
                ends = np.searchsorted(doc, np.arange(len(count) + 1))
                cuts = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                part = [batch.column(c).slice(row, len(count)) for c in ("row", "doc_id")]
                yield pa.RecordBatch.from_arrays([*part, pa.array(count.astype(np.int64)), cuts(at), cuts(times)], ["row", "doc_id", "n", "terms", "times"])

    return K.task(f)


def postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, term, occurrences, terms of the document) of each posting of forward rows."""
    terms = [np.frombuffer(x.as_py(), np.int32) for x in batch.column("terms")]
    times = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("times")]
    sizes = [len(x) for x in terms]
    row = np.repeat(np.arange(batch.num_rows), sizes)
    if not len(row):
        return row, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return row, np.concatenate(terms), np.concatenate(times), np.repeat(batch.column("n").to_numpy(), sizes)


def _held(size: int) -> Callable:
    """In how many documents each term is."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("terms"):
                total[np.frombuffer(x.as_py(), np.int32)] += 1  # distinct in a document
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    return K.task(f)


@dataclass(frozen=True)
class Weights:
    """A slice's terms: their weights, and the totals of all documents."""

    weight: np.ndarray
    docs: int
    terms: int

    def gains(self, term: np.ndarray, times: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 75 + (25 * n * self.docs) // self.terms
        return self.weight[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m))

    def floors(self) -> list[int]:
        """The least gain of each tier."""
        most = 1_000_000 * int(self.weight.max(initial=0))
        return [max(1, math.ceil(most * share)) for share in TIERS]


def weight_of(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def packed(term: np.ndarray, place: np.ndarray, gain: np.ndarray) -> bytes:
    order = np.lexsort((place, term))
    return np.int64(len(term)).tobytes() + term[order].astype(np.int32).tobytes() + place[order].astype(np.int32).tobytes() + gain[order].astype(np.int64).tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int32, n, 8), np.frombuffer(raw, np.int32, n, 8 + 4 * n), np.frombuffer(raw, np.int64, n, 8 + 8 * n)


TIER = [f"tier{t}" for t in range(len(TIERS))]
BLOCK = "docs long, rows binary, ids binary, " + ", ".join(f"{t} binary" for t in TIER)
NO_ID = np.iinfo(np.int64).max


def _blocked(weights: Weights) -> Callable:
    """Blocks of documents with their postings by tier."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = np.array(weights.floors())
        held: list[tuple[np.ndarray, ...]] = []
        docs = size = 0

        def block() -> pa.RecordBatch:
            row, ids, place, term, gain = (np.concatenate(x) for x in zip(*held))
            tier = (gain[:, None] < floors).sum(axis=1)
            tiers = [packed(term[tier == t], place[tier == t], gain[tier == t]) for t in range(len(floors))]
            return pa.RecordBatch.from_arrays([pa.array([len(row)]), *(pa.array([x], pa.binary()) for x in (row.tobytes(), ids.tobytes(), *tiers))], ["docs", "rows", "ids", *TIER])

        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                at, term, times, n = postings(batch)
                gain = weights.gains(term, times, n)
                at, term, gain = at[gain > 0], term[gain > 0], gain[gain > 0]
                met, place = np.unique(at, return_inverse=True)  # documents without a posting can't be found
                if not len(met):
                    continue
                if held and (docs + len(met) > DOCS or size + len(at) > POSTINGS):
                    yield block()
                    held, docs, size = [], 0, 0
                ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
                held.append((batch.column("row").to_numpy()[met], ids[met], place + docs, term, gain))
                docs, size = docs + len(met), size + len(at)
        if held:
            yield block()

    return K.task(f)


def _largest(size: int) -> Callable:
    """The largest gain of each term in each tier."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros((len(TIERS), size), np.int64)
        for batch in batches:
            for t, name in enumerate(TIER):
                for raw in batch.column(name):
                    term, _, gain = unpacked(raw.as_py())
                    np.maximum.at(most[t], term, gain)
        t, at = np.nonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(at), pa.array(most[t, at])], ["tier", "term", "gain"])

    return K.task(f)


@dataclass(frozen=True)
class Asked:
    """Items and their terms, sorted by item: ``first`` and ``last`` of the pairs (term, times) of each."""

    item: np.ndarray
    first: np.ndarray
    last: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, pairs: pd.DataFrame, place: np.ndarray) -> Asked:
        item, term, times = pairs["item"].to_numpy(), place, pairs["times"].to_numpy()
        order = np.lexsort((term, item))
        item, term, times = item[order], term[order], times[order]
        each, first = np.unique(item, return_index=True)
        return cls(each, first, np.append(first[1:], len(item)), term, times)

    def only(self, keep: np.ndarray) -> Asked:
        """Those of the items ``keep`` (flags)."""
        return Asked(self.item[keep], self.first[keep], self.last[keep], self.term, self.times)

    def sums(self, value: np.ndarray) -> np.ndarray:
        """For each item the sum over its terms of times x value."""
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.times * value[self.term])])
        return total[self.last] - total[self.first]


def met(asked: Asked, docs: int, tiers: list[bytes], residual: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first item, lower bounds, residual bounds of the terms met) by items and documents of a block, some items at a time."""
    term, place, gain = (np.concatenate(x) for x in zip(*map(unpacked, tiers)))
    order = np.argsort(term, kind="stable")
    term, place, gain = term[order], place[order], gain[order]
    starts = np.searchsorted(term, np.arange(len(residual) + 1))
    k = 0
    while k < len(asked.item):
        sizes = starts[1:] - starts[:-1]
        end, total = k, 0
        while end < len(asked.item) and (end == k or total + docs <= STEP):
            own = asked.term[asked.first[end] : asked.last[end]]
            total += docs + int(sizes[own].sum())
            end += 1
        pairs = np.concatenate([np.arange(a, b) for a, b in zip(asked.first[k:end], asked.last[k:end])])
        item = np.repeat(np.arange(end - k), (asked.last - asked.first)[k:end])
        n = sizes[asked.term[pairs]]
        at = np.repeat(starts[asked.term[pairs]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        cell = np.repeat(item, n) * docs + place[at]
        times = np.repeat(asked.times[pairs], n)
        low, seen = np.zeros((end - k) * docs, np.int64), np.zeros((end - k) * docs, np.int64)
        np.add.at(low, cell, times * gain[at])
        np.add.at(seen, cell, times * residual[term[at]])
        yield k, low.reshape(-1, docs), seen.reshape(-1, docs)
        k = end


def _floors(asked: Asked, tier: int, size: int, best: int) -> Callable:
    """The best lower bounds of a task for each item."""
    none = np.zeros(size, np.int64)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((len(asked.item), best), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                raw = [batch.column(t)[row].as_py() for t in TIER[: tier + 1]]
                for k, low, _ in met(asked, batch.column("docs")[row].as_py(), raw, none):
                    both = np.concatenate([top[k : k + len(low)], low], axis=1)
                    top[k : k + len(low)] = np.partition(both, both.shape[1] - best, axis=1)[:, -best:]
        i, j = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(asked.item[i]), pa.array(top[i, j])], ["item", "low"])

    return K.task(f)


FOUND = "item long, row long, doc_id long, score long"


def _candidates(asked: Asked, tier: int, residual: np.ndarray, floor: np.ndarray, best: int) -> Callable:
    """Documents that can be among the best of proven items.  In the last tier lower bounds are scores, and a task's best do."""
    rest = asked.sums(residual)
    last = tier == len(TIERS) - 1

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                raw = [batch.column(t)[at].as_py() for t in TIER[: tier + 1]]
                row, ids = (np.frombuffer(batch.column(c)[at].as_py(), np.int64) for c in ("rows", "ids"))
                for k, low, seen in met(asked, len(row), raw, residual):
                    part = slice(k, k + len(low))
                    i, j = np.nonzero(low + rest[part, None] - seen >= np.maximum(floor[part, None], 1))
                    some = np.stack([asked.item[k + i], row[j], ids[j], low[i, j]], axis=1)
                    if last:
                        held = best_of(np.concatenate([held, some]), best)
                    elif len(some):
                        yield found(some)
        if len(held):
            yield found(held)

    return K.task(f)


def found(rows: np.ndarray) -> pa.RecordBatch:
    item, row, ids, score = rows.T
    return pa.RecordBatch.from_arrays([pa.array(item), pa.array(row), pa.array(ids, mask=ids == NO_ID), pa.array(score)], ["item", "row", "doc_id", "score"])


def best_of(rows: np.ndarray, best: int) -> np.ndarray:
    """Of each item the best rows (item, row, doc_id, score)."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2], -rows[:, 3], rows[:, 0]))]
    starts = np.searchsorted(rows[:, 0], rows[:, 0])
    return rows[np.arange(len(rows)) - starts < best]


def _scored(asked: Asked, weights: Weights) -> Callable:
    """Full scores of documents for the items in ``items``."""
    at = {int(x): k for k, x in enumerate(asked.item)}

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.zeros(len(weights.weight), np.int64)
        for batch in batches:
            doc, term, times, n = postings(batch)
            gain = weights.gains(term, times, n)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            rows, ids = batch.column("row").to_numpy(), batch.column("doc_id").fill_null(NO_ID).to_numpy()
            out = []
            for k, items in enumerate(batch.column("items").to_pylist()):
                own = term[ends[k] : ends[k + 1]]
                value[own] = gain[ends[k] : ends[k + 1]]
                for item in items:
                    part = slice(asked.first[at[item]], asked.last[at[item]])
                    out.append((item, rows[k], ids[k], int((asked.times[part] * value[asked.term[part]]).sum())))
                value[own] = 0
            if out:
                yield found(np.array(out, np.int64))

    return K.task(f)


class Index:
    """Documents by tiers, for the terms of some items, below ``folder``."""

    def __init__(self, docs: DataFrame, wanted: np.ndarray, folder: str):
        spark = docs.sparkSession
        self.folder = folder
        rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())  # stays what it was once written
        rows.mapInArrow(_forward(wanted), FORWARD).write.parquet(f"{folder}/forward")
        self.forward = spark.read.schema(FORWARD).parquet(f"{folder}/forward")
        docs_, terms = self.forward.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        held = self.forward.select("terms").mapInArrow(_held(len(wanted)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
        weight = np.zeros(len(wanted), np.int64)
        weight[held["term"]] = [weight_of(df, docs_) for df in held["df"]]
        self.weights = Weights(weight, docs_, terms or 1)
        self.forward.mapInArrow(_blocked(self.weights), BLOCK).write.parquet(f"{folder}/blocks")
        self.blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
        largest = self.blocks.select(*TIER).mapInArrow(_largest(len(wanted)), "tier long, term long, gain long").groupBy("tier", "term").agg(F.max("gain").alias("gain")).toPandas()
        most = np.zeros((len(TIERS), len(wanted)), np.int64)
        most[largest["tier"], largest["term"]] = largest["gain"]
        #: For each tier the residual bounds of the terms: their largest gains in the tiers below.
        self.residual = np.concatenate([np.maximum.accumulate(most[::-1], axis=0)[::-1][1:], np.zeros((1, len(wanted)), np.int64)])

    def floors(self, asked: Asked, tier: int, best: int) -> np.ndarray:
        """For each item the best-th lower bound, 0 where fewer documents were met."""
        lows = self.blocks.select("docs", *TIER[: tier + 1]).mapInArrow(_floors(asked, tier, len(self.weights.weight), best), "item long, low long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
        got = lows.withColumn("place", place).where(F.col("place") <= best).where(F.col("place") == best).toPandas()
        out = np.zeros(len(asked.item), np.int64)
        out[np.searchsorted(asked.item, got["item"])] = got["low"]
        return out

    def search(self, asked: Asked, best: int = BEST) -> tuple[DataFrame, list[int]]:
        """(item, row, doc_id, score) of documents among which are each item's best, and how many items each tier has proven."""
        out, proven = [], []
        for tier in range(len(TIERS)):
            if not len(asked.item):
                break
            floor = np.maximum(1, self.floors(asked, tier, best))
            sure = asked.sums(self.residual[tier]) < floor
            proven.append(int(sure.sum()))
            if sure.any():
                some = asked.only(sure)
                candidates = self.blocks.select("rows", "ids", *TIER[: tier + 1]).mapInArrow(_candidates(some, tier, self.residual[tier], floor[sure], best), FOUND)
                if tier < len(TIERS) - 1:
                    # A document is read once for all items that it is a candidate of; items of a slice are bounded.
                    candidates = small(cut(candidates.groupBy(F.col("row").alias("of")).agg(F.collect_list("item").alias("items")), narrow=True), ROWS)
                    read = self.forward.join(candidates, F.col("row") == F.col("of")).select(*(x.split()[0] for x in FORWARD.split(", ")), "items")
                    candidates = read.mapInArrow(_scored(some, self.weights), FOUND)
                out.append(candidates)
            asked = asked.only(~sure)
        return reduce(DataFrame.unionByName, out), proven


def search(docs: DataFrame, items: DataFrame, best: int = BEST, terms: int = TERMS, report: list[list[int]] | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's best documents.  ``report`` gets for each slice how many items each tier has proven."""
    spark = docs.sparkSession
    items = cut(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()), narrow=True)
    asked = cut(items.select("item", "text").mapInArrow(K.task(_asked), "item long, term long, times long"), narrow=True)
    slices = math.ceil(asked.count() / terms)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    parts = []
    for k in range(slices):
        pairs = asked.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == k).toPandas()  # at most about ``terms``, or one item's
        if not len(pairs):
            continue
        wanted, place = np.unique(pairs["term"].to_numpy().view(K.U), return_inverse=True)
        index = Index(docs, wanted, f"{shared_dir(spark)}/tiers-{uuid.uuid4().hex}")
        rows, proven = index.search(Asked.of(pairs, place), best)
        if report is not None:
            report.append(proven)
        parts.append(cut(rows.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best), narrow=True))
        dropped(spark, index.folder)
    if not parts:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score")).where("false")
    return reduce(DataFrame.unionByName, parts).join(items, "item").select("item_id", "rank", "doc_id", "score")


def op12_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH items AS (
  SELECT item_id, text, row_number() OVER () AS item FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (
  SELECT item, term, count(*) AS times FROM (
    SELECT item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items)
  GROUP BY item, term
), numbered AS (
  SELECT doc_id, text, row_number() OVER () AS r FROM documents
), terms AS (
  SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM (
    SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM numbered)
  GROUP BY r, term
), lengths AS (
  SELECT r, sum(tf)::BIGINT AS n FROM terms GROUP BY r
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM terms, totals GROUP BY term, docs
), sizes AS (
  SELECT r, 75 + (25 * n * docs) // words AS m FROM lengths, totals
), scores AS (
  SELECT a.item, t.r, any_value(t.doc_id) AS doc_id, sum(a.times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked a JOIN terms t ON a.term = t.term JOIN weights w ON w.term = a.term JOIN sizes s ON s.r = t.r
  GROUP BY a.item, t.r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (item) WHERE rank <= 20
"""
