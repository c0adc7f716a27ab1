"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives P; the texts of labelled rows, whatever their label, are the unlabelled
sample U, and the share ``prior`` of toxic text is known or measured.  A linear classifier on hashed words and
word beginnings minimises, by mini-batches in numpy,

    prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])

where l is the logistic loss.  The second term estimates the risk on clean text; it can't be
negative, so once it falls under zero the step goes the other way instead of fitting noise.

Features are presence of a word and of its beginnings (4 to 6 bytes), hashed to ``DIM`` places.
Only places that ``MIN_SUPPORT`` positives (and ``MIN_SHARE`` of them) share, and that are ``MIN_LIFT / prior`` times as frequent
in P as in U, get a weight; a document's logit is the sum of
its places' weights and a bias.  Nothing but the text enters a score.

The fit uses at most ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` documents of the rows in ``labels``, chosen by hash of the
doc_id; hashing and choosing run in the cluster, and only hashed places that enough positives share come to the driver.
Scoring reads every whole text.

Edge cases: null and empty texts have no features and get the bias alone; null labels and
labels of unknown documents are left out; repeated rows get equal scores, and an id counts once in the fit
however many rows it has; with no positives
every score is the prior; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, table

LOG_DIM = 22
DIM = 1 << LOG_DIM
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
MIN_SUPPORT = 6
MIN_SHARE = 0.006
MIN_LIFT = 0.5
STEMS = (4, 5, 6)
FOLDS, HELD = 5, 0
DEFAULT_PRIOR = 0.05


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of the distinct features of each document of a block, in order."""
    data = K.LOWER[data]
    words = K.Words(data, offsets)
    roll = K._ROLL[1]
    prefix = roll.prefix(K._BYTES[0][data])
    doc = np.repeat(np.arange(len(offsets) - 1), words.count)
    # Signs around a word don't count; what is left may be empty.
    size = words.end - words.start
    keys, docs = [roll.spans(prefix, words.start, words.end)], [doc]
    for n in STEMS:
        long = size > n
        keys.append(K.mix(roll.spans(prefix, words.start[long], words.start[long] + n) + K.U(n)))
        docs.append(doc[long])
    at = (np.concatenate(docs).astype(np.int64) << LOG_DIM) | (np.concatenate(keys) >> K.U(64 - LOG_DIM)).astype(np.int64)
    at = np.unique(at)
    return at >> LOG_DIM, at & (DIM - 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in K.blocks(batch):
            doc, place = places(data, offsets)
            ends = np.searchsorted(doc, np.arange(len(offsets)))
            cells = [place[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, len(cells)) for c in ("positive", "doc_id")), pa.array(cells, pa.binary())], ["positive", "doc_id", "places"])


class Model:
    """Weights of the places that have one; spread out over all places where it is first used."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float):
        self.places, self.values, self.bias = places, weights, bias
        self.dense: np.ndarray | None = None

    def logits(self, doc: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        if self.dense is None:
            self.dense = np.zeros(DIM, np.float32)
            self.dense[self.places] = self.values
        return np.bincount(doc, self.dense[place], n) + self.bias


class Sets:
    """Documents' distinct places, end to end, and where each document begins (one more at the end)."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        self.values, self.starts = values, starts

    def __len__(self) -> int:
        return len(self.starts) - 1

    def rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position among ``rows``, place) of these documents."""
        size = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(size)
        at = np.repeat(self.starts[rows] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(np.arange(len(rows)), size), self.values[at]

    def kept(self, index: np.ndarray) -> Sets:
        """With places renumbered by ``index``, those below zero left out."""
        new = index[self.values]
        stays = np.concatenate([[0], np.cumsum(new >= 0)])
        return Sets(new[new >= 0], stays[self.starts])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(positive: Sets, unlabelled: Sets, prior: float, epochs: int = 40, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Model:
    """The non-negative risk minimiser by Adagrad."""
    prior = clipped(prior)
    bias = float(np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), bias)
    support = np.bincount(positive.values, minlength=DIM)
    places = np.flatnonzero(support >= least_support(len(positive)))
    # A place of toxic text alone is 1 / prior times as frequent in P as in U; places below a share
    # of that add noise.
    common = np.bincount(unlabelled.values, minlength=DIM)[places]
    lift = (support[places] / len(positive)) / ((common + 1) / (len(unlabelled) + 1))
    places = places[lift >= MIN_LIFT / prior]
    index = np.full(DIM, -1, np.int32)
    index[places] = np.arange(len(places))
    sets = [positive.kept(index), unlabelled.kept(index)]
    del support, index
    w, g2, b2 = np.zeros(len(places)), np.full(len(places), 1e-8), 1e-8
    rng = np.random.default_rng(seed)
    batch_p = max(1, min(256, len(positive)))
    steps = max(8, len(unlabelled) // 512)
    for _ in range(epochs):
        order = [rng.permutation(len(part)) for part in sets]
        for step in range(steps):
            p_rows, u_rows = np.take(order[0], np.arange(step * batch_p, (step + 1) * batch_p), mode="wrap"), order[1][step::steps]
            if not len(u_rows):
                continue
            (pd, pa_), (ud, ua) = sets[0].rows(p_rows), sets[1].rows(u_rows)
            zp, zu = np.bincount(pd, w[pa_], len(p_rows)) + bias, np.bincount(ud, w[ua], len(u_rows)) + bias
            clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            up, un = sigmoid(zu) / len(zu), prior * sigmoid(zp) / len(zp)
            if clean >= 0:
                dp, du = -prior * sigmoid(-zp) / len(zp) - un, up
            else:  # undo the over-fit part of the clean risk
                dp, du = un, -up
            grad = np.bincount(pa_, dp[pd], len(w)) + np.bincount(ua, du[ud], len(w)) + decay * w
            gb = dp.sum() + du.sum()
            g2 += grad * grad
            b2 += gb * gb
            w -= rate * grad / np.sqrt(g2)
            bias -= rate * gb / np.sqrt(b2)
    z = []
    for part in sets:
        doc, at = part.rows(np.arange(len(part)))
        z.append(np.bincount(doc, w[at], len(part)))
    return Model(places, w.astype(np.float32), -cut_point(z[0], z[1], prior))


def cut_point(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The logit with the least non-negative PU risk for the 0-1 loss; of equals, the middle of the
    widest gap."""
    at = np.unique(np.concatenate([positive, unlabelled]))
    at = np.concatenate([[at[0] - 2], at, [at[-1] + 2]])
    mid = (at[1:] + at[:-1]) / 2
    caught = 1 - np.searchsorted(np.sort(positive), mid) / len(positive)
    flagged = 1 - np.searchsorted(np.sort(unlabelled), mid) / len(unlabelled)
    risk = prior * (1 - caught) + np.maximum(0, flagged - prior * caught)
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(mid[best[np.argmax(np.diff(at)[best])]])


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never used: crc32(doc_id as text) mod 5 is 0 (null ids too)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).select("doc_id", "toxic").distinct()
    prior = known.agg(F.avg("toxic")).first()[0]
    toxic = known.where("toxic = 1").select("doc_id").distinct()
    texts = docs.select("doc_id", "text").where(~held_out("doc_id"))
    pick = F.xxhash64("doc_id", F.lit(17))
    # Ids are chosen first, so that only chosen texts are read on.
    positive = texts.select("doc_id").join(toxic, "doc_id", "left_semi").distinct().orderBy(pick).limit(max_positive).select("doc_id", F.lit(True).alias("positive"))
    listed = labels.select("doc_id").distinct()
    unlabelled = texts.select("doc_id").join(listed, "doc_id", "left_semi").distinct().orderBy(F.xxhash64("doc_id", F.lit(23))).limit(max_unlabelled).select("doc_id", F.lit(False).alias("positive"))
    # At most max_positive + max_unlabelled ids, so texts stay where they are.
    chosen = texts.join(F.broadcast(positive.unionByName(unlabelled)), "doc_id").select("positive", "doc_id", "text")
    # An id counts once in each set, however many rows it has; of several texts the one of least places is taken.
    rows = chosen.mapInArrow(K.task(_features), "positive boolean, doc_id long, places binary").groupBy("positive", "doc_id").agg(F.min("places").alias("places"))
    prior = DEFAULT_PRIOR if prior is None else float(prior)
    rows = _narrowed(cut(rows.select("positive", "places"), narrow=True), prior).toArrow().combine_chunks()
    return fit(*(_sets(rows.filter(rows.column("positive") if on else pc.invert(rows.column("positive")))) for on in (True, False)), prior)


def clipped(prior: float) -> float:
    return min(max(prior, 1e-4), 0.9)


def least_support(positives: int) -> float:
    """Positives that must share a place.  Few positives share few places, so it follows them."""
    return max(1, min(MIN_SUPPORT, positives // 8), MIN_SHARE * positives)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many positives and how many others have each place."""
    total = np.zeros((2, DIM), np.int32)
    for batch in batches:
        for positive, x in zip(batch.column("positive").to_pylist(), batch.column("places")):
            total[0 if positive else 1, np.frombuffer(x.as_py(), np.int32)] += 1  # distinct in a document
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (at, total[0, at], total[1, at])], ["place", "p", "u"])
    rest = np.flatnonzero((total[0] == 0) & (total[1] > 0))
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (rest, total[0, rest], total[1, rest])], ["place", "p", "u"])


def _narrowed(rows: DataFrame, prior: float) -> DataFrame:
    """``rows`` with the places that can get a weight: the others, nearly all, stay in the cluster.  ``fit`` judges the rest again."""
    sizes = {r.positive: r["count"] for r in rows.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    count = rows.mapInArrow(K.task(_counted), "place long, p long, u long").groupBy("place").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    lift = (F.col("p") / max(1, n_p)) / ((F.col("u") + 1) / (n_u + 1))
    some = count.where((F.col("p") >= least_support(n_p)) & (lift >= MIN_LIFT / clipped(prior) * (1 - 1e-9)))
    known = np.sort(some.select("place").toArrow().column("place").to_numpy())  # some hundreds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("places"):
                own = np.frombuffer(x.as_py(), np.int32)
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                out.append(own[known[at] == own].tobytes() if len(known) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(out, pa.binary())], ["positive", "places"])

    return rows.mapInArrow(K.task(run), "positive boolean, places binary")


def _sets(rows: pa.Table) -> Sets:
    """The documents in an order that doesn't depend on the tasks'."""
    cells = rows.column("places").to_pylist()
    cells.sort(key=lambda x: (len(x), x))
    starts = np.cumsum([0, *(len(x) // 4 for x in cells)])
    return Sets(np.frombuffer(b"".join(cells), np.int32), starts)


def score(docs: DataFrame, model: Model, extra: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The score, as column ``name``, for every row, beside the columns named."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in K.blocks(batch):
                doc, place = places(data, offsets)
                n = len(offsets) - 1
                values = sigmoid(shared.value.logits(doc, place, n))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, n) for c in extra), pa.array(values)], [*extra, name])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*extra, *({"text"} - set(extra))).mapInArrow(K.task(run), ", ".join(f"`{c}` {kinds[c]}" for c in extra) + f", `{name}` double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
