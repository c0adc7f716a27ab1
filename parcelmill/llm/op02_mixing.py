"""Language-model scores by online logistic context mixing, beside an exact unigram base.

A text is its lower-cased words in order and one end token.  It is coded by yes/no decisions, every one
of which several hashed-context bit predictors foretell from what stands before it:

* *Phrase.*  Words are cut into phrases where a hash of two neighbouring words says so (about every
  ``PHRASE`` words), so repeated passages are cut alike.  Does the next phrase occur in another
  training text?  If so, it is named at its share of all phrases and its words cost no more.
* *Word.*  Else, word by word: did the next word occur before in this text?
* *Class.*  Of which of ``CLASSES`` classes is the word, bit by bit?  The previous word and the previous two foretell that, and the classes of the text so far.
  Within its class a word that occurred is named at its share of the text so far; any other comes from the training vocabulary at its share of first occurrences, or is new.
* *Bit.*  A new word is spelled, byte by byte and each byte bit by bit, up to a closing blank.

Each kind of decision has its own mixer:

* *Hashed-context bit predictors.*  Slots hold how often no and yes followed.  Contexts of words are the
  place and the share of new words, the last outcomes, the previous word, and the previous word with the last outcomes; of
  a class's bits the previous word, the previous two, and what the text so far leans to, each with the bits known and whether the word occurred; of
  phrases the last outcomes, how common the last phrase is, and the run of hits; of bits one to three bytes and the word so far.
* *Gated mixing.*  Predictions are added in the logistic domain with weights chosen by a gate,
  trained online, each decision being foretold before it is learnt from, over every slice of the corpus;
  slices' weights are averaged by their decisions.
* *Adaptive refinement.*  A last table maps gate and mixed prediction to what followed on average, interpolated;
  half of it is mixed in.

What a training text itself has taught is taken out when it is scored: its own phrases, its own count among the texts of a word,
and each decision's own outcome.  So a text that stands once in the corpus is as new as a held-out one,
and one that occurs twice is told apart.

What is gathered grows with the input: the vocabulary (a row a word) and the phrases (a row a
phrase) are tables that are joined; only the most frequent words (``DICTIONARY``) are broadcast, which decides how a word
meets its counts and not what they are.  Slots of the classes' and the spelling's contexts follow the numbers of training words and tokens, up
to 2^21 and 2^22 for the longest.  A document's phrases and rare words travel in its own row; a phrase in a third of all texts is counted
in each task first.

Edge cases: null and empty texts are one end token; repeated rows get equal rows and, in training,
count each; rows sharing a doc_id with other text are scored apart; a null doc_id trains;
with no training rows all counts are zero; ties between frequent words go to the dictionary together; an empty table gives an empty
result; other columns are ignored.  Words within a task, words before a decision, phrases, and rows (by id and text) are compared by 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, small, table, with_key

U = np.uint64
END = b"\n"
HELD, FOLDS = 2, 7
DICTIONARY = 1 << 19
FLUSH = 1_500_000
BLOCK = 16
KNOTS = 33
STEP = 1 << 14
PHRASE, LONGEST = 16, 64
PHRASE_ROWS = 500_000
_SEED = [int(x) for x in K.mix(np.arange(21, 31, dtype=U) * U(0x9E3779B97F4A7C15))]
_END_HASH = U(0x6A09E667F3BCC909)


class Mixer:
    """Yes/no decisions of one kind: counts of both outcomes by hashed context, mixed by gated weights, refined."""

    def __init__(self, log_slots: tuple[int, ...], gates: int, counts: np.ndarray | None = None):
        self.log_slots, self.gates, self.inputs = tuple(log_slots), gates, len(log_slots) + 1
        self.first = np.concatenate([[0], np.cumsum([1 << n for n in log_slots])])
        # Of slot k, place 2 k counts no and the next one yes.
        self.counts = np.zeros(2 * int(self.first[-1]), np.float32) if counts is None else counts
        self.weights = np.full((gates, self.inputs), 1.0 / (self.inputs - 1), np.float32)
        self.slope = np.full((gates, self.inputs), 1e-2)
        self.met = np.zeros((2, gates * KNOTS))  # mixed predictions by gate and knot: how often met, and a yes
        self.refine: np.ndarray | None = None
        self.mass = 0.0

    def slots(self, contexts: list[np.ndarray]) -> list[np.ndarray]:
        """Places of the counts of no for hashed contexts (any integers)."""
        out = []
        for c, s, n, f in zip(contexts, _SEED, self.log_slots, self.first.tolist()):
            x = c.astype(U)
            x += U(s)
            x *= U(0x9E3779B97F4A7C15)
            x ^= x >> U(29)
            x *= U(0xD6E8FEB86659FD93)
            x >>= U(64 - n)
            out.append((x.astype(np.int64) + f) * 2)
        return out

    def stretched(self, at: list[np.ndarray], bit: np.ndarray, own: np.ndarray | float) -> np.ndarray:
        """Predictions in the logistic domain, ``own`` of each decision's outcome being left out."""
        x = np.empty((self.inputs, len(bit)), np.float32)
        minus = None if own is None else (own * (1 - bit), own * bit)
        for k, a in enumerate(at):
            no, yes = self.counts[a], self.counts[a + 1]
            if minus is not None:
                no, yes = np.maximum(no - minus[0], 0), np.maximum(yes - minus[1], 0)
            no += np.float32(0.1)
            yes += np.float32(0.1)
            np.divide(yes, no, out=x[k])
        np.log(x[:-1], out=x[:-1])
        np.clip(x[:-1], -9, 9, out=x[:-1])
        x[-1] = 0.3
        return x

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = x[0] * self.weights[:, 0][gate]
        for k in range(1, self.inputs):
            z += x[k] * self.weights[:, k][gate]
        return np.clip(z, -11, 11)

    def probability(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Of a yes, refined."""
        p = 1 / (1 + np.exp(-z.astype(np.float64)))
        if self.refine is None:
            return p
        knot = (z + 12) * ((KNOTS - 1) / 24)
        low = np.minimum(knot.astype(np.int64), KNOTS - 2)
        part = knot - low
        at = gate * KNOTS + low
        return 0.5 * p + 0.5 * (self.refine[at] * (1 - part) + self.refine[at + 1] * part)

    def bits(self, at: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, own: np.ndarray | float | None = None) -> np.ndarray:
        """What the decisions cost."""
        p = self.probability(self.mixed(self.stretched(at, bit, own), gate), gate)
        return -np.log2(np.where(bit == 1, p, 1 - p))

    def learn(self, at: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, count: bool = True, own: float | None = None, times: np.ndarray | None = None) -> None:
        """One batch, online: foretell, move the weights against the error, note the outcome (``times`` over)."""
        one = bit.astype(np.float32)
        x = self.stretched(at, one, own)
        z = self.mixed(x, gate)
        p = 1 / (1 + np.exp(-z))
        error = one - p if times is None else (one - p) * times
        for k in range(self.inputs):
            grad = np.bincount(gate, error * x[k], self.gates)
            self.slope[:, k] += grad * grad
            self.weights[:, k] += 0.05 * grad / np.sqrt(self.slope[:, k])
        knot = (z + 12) * ((KNOTS - 1) / 24)
        low = np.minimum(knot.astype(np.int64), KNOTS - 2)
        near = knot - low
        low += gate * KNOTS
        n = self.gates * KNOTS
        for shift, share in ((0, 1 - near), (1, near)):
            share = share if times is None else share * times
            self.met[0] += np.bincount(low + shift, share, n + 1)[:n]
            self.met[1] += np.bincount(low + shift, share * one, n + 1)[:n]
        if count:
            self.note(at, bit)
        self.mass += len(bit) if times is None else float(times.sum())

    def note(self, at: list[np.ndarray], bit: np.ndarray, times: np.ndarray | float = 1) -> None:
        for a in at:
            np.add.at(self.counts, a + bit, np.float32(times) if np.isscalar(times) else times)

    def settled(self, weights: np.ndarray | None, met: np.ndarray | None) -> Mixer:
        """With the weights and the refinement that all slices have come to."""
        if weights is not None:
            self.weights = weights.reshape(self.gates, self.inputs).astype(np.float32)
        prior = np.tile(1 / (1 + np.exp(-(np.arange(KNOTS) * (24 / (KNOTS - 1)) - 12))), self.gates)
        seen, yes = (np.zeros((2, len(prior))) if met is None else met.reshape(2, -1))
        self.refine = np.clip((yes + 20 * prior) / (seen + 20), 1e-6, 1 - 1e-6)
        return self


# --- What slices have learnt, gathered: weights, refinement and, in sparse blocks, slots.

_PARTS = ("at", "zeros", "ones", "big_at", "big_zeros", "big_ones")
_SHARE = pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in _PARTS)])
SHARE = "block int, " + ", ".join(f"{c} binary" for c in _PARTS)


def _share(block: int, zeros: np.ndarray, ones: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """A block's used slots: small counts in a byte each, the few larger ones apart."""
    large = np.maximum(zeros, ones) > 255
    row = {"block": block}
    for name, on, kind in (("", ~large, np.uint8), ("big_", large, np.float32)):
        row |= {f"{name}at": at[on].astype(np.uint16).tobytes(), f"{name}zeros": zeros[on].astype(kind).tobytes(), f"{name}ones": ones[on].astype(kind).tobytes()}
    return pa.RecordBatch.from_pylist([row], _SHARE)


def _counts(row) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for name, kind in (("", np.uint8), ("big_", np.float32)):
        yield np.frombuffer(row[f"{name}at"], np.uint16).astype(np.int64), np.frombuffer(row[f"{name}zeros"], kind), np.frombuffer(row[f"{name}ones"], kind)


MANY = 1 << 16  # blocks of a mixer, at most


def _shares(mixer: Mixer, number: int = 0) -> Iterator[pa.RecordBatch]:
    """The slots of the ``number``-th mixer of a pass."""
    zeros, ones = mixer.counts[::2], mixer.counts[1::2]
    used = np.flatnonzero(zeros + ones)
    for b in np.unique(used >> BLOCK):
        at = used[np.searchsorted(used, b << BLOCK) : np.searchsorted(used, (b + 1) << BLOCK)]
        yield _share(int(b) + number * MANY, zeros[at], ones[at], at & ((1 << BLOCK) - 1))


def _learnt(mixer: Mixer, number: int = 0) -> pa.RecordBatch:
    """Weights times decisions and the refinement's sums, as a row of block -1 (-2 for the second mixer, and so on)."""
    sums = np.concatenate([[mixer.mass], mixer.weights.reshape(-1).astype(np.float64) * mixer.mass, mixer.met.reshape(-1)])
    return pa.RecordBatch.from_pylist([{"block": -1 - number, "big_ones": sums.tobytes()}], _SHARE)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if (b := row["block"]) < 0:
                sums = np.frombuffer(row["big_ones"])
                total[b] = total[b] + sums if b in total else sums
                continue
            sums = total.setdefault(row["block"], np.zeros((2, 1 << BLOCK), np.float32))
            for at, zeros, ones in _counts(row):
                sums[0, at] += zeros
                sums[1, at] += ones
    for b, sums in total.items():
        if b < 0:
            yield pa.RecordBatch.from_pylist([{"block": b, "big_ones": sums.tobytes()}], _SHARE)
        else:
            at = np.flatnonzero(sums.any(axis=0))
            yield _share(b, sums[0, at], sums[1, at], at)


def _blocks(rows: DataFrame, learn: Callable) -> Iterator:
    """What the slices of ``rows`` have taught, added up by block in the cluster."""
    return iter(rows.mapInArrow(K.task(learn), SHARE).repartition(F.col("block")).mapInArrow(K.task(_add), SHARE).collect())


def gathered(rows: DataFrame, learn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], make: Callable[[], Mixer]) -> Mixer:
    """A mixer with all that the slices of ``rows`` have taught."""
    return all_gathered(rows, learn, make)[0]


def all_gathered(rows: DataFrame, learn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *makes: Callable[[], Mixer]) -> list[Mixer]:
    """Mixers that one pass teaches."""
    mixers = [make() for make in makes]
    sums: dict[int, np.ndarray] = {}
    for r in _blocks(rows, learn):
        if r["block"] < 0:
            sums[-1 - r["block"]] = np.frombuffer(r["big_ones"])
            continue
        number, block = divmod(r["block"], MANY)
        for at, zeros, ones in _counts(r):
            at = 2 * (at + (block << BLOCK))
            mixers[number].counts[at], mixers[number].counts[at + 1] = zeros, ones
    out = []
    for number, mixer in enumerate(mixers):
        found, n = sums.get(number), mixer.weights.size
        out.append(mixer.settled(None, None) if found is None else mixer.settled(found[1 : n + 1] / found[0] if found[0] else None, found[n + 1 :]))
    return out


# Counts travel in a byte: exact up to 32, then eight steps for each doubling.
DECODE = np.concatenate([np.arange(32), 32 * 2.0 ** (np.arange(224) / 8)]).astype(np.float32)


def _narrow(counts: np.ndarray) -> np.ndarray:
    big = 32 + np.rint(8 * np.log2(np.maximum(counts, 32) / 32))
    return np.where(counts < 32, counts, np.minimum(big, 255)).astype(np.uint8)


def _wide(counts: np.ndarray) -> np.ndarray:
    return DECODE[counts]


def ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of key, then place, and where a new key begins."""
    n = len(key)
    low = U(max(n, 2).bit_length())
    whole = np.sort((key >> low << low) | np.arange(n, dtype=U))  # plain numbers sort several times faster than places
    order = (whole & ((U(1) << low) - U(1))).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = (whole[1:] ^ whole[:-1]) >> low != 0
    if (key[order[1:]] != key[order[:-1]])[~new[1:]].any():  # keys that differ in their low bits only
        order = np.argsort(key, kind="stable")
        new[1:] = key[order[1:]] != key[order[:-1]]
    return order, new


# --- Bits: the spelling of new words.

REACH = 4  # bytes before, in the word


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, each with its closing blank (the end token is a byte of its own), and ends."""
    text = [w if w == END else w + b" " for w in words]
    return np.frombuffer(b"".join(text), np.uint8), np.cumsum([len(w) for w in text])


def packed(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte the ``REACH`` bytes before it in its word (none: 0), the nearest one lowest, and the byte itself on top."""
    n = len(data)
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(n) - np.repeat(starts, np.diff(ends, prepend=0))
    out = data.astype(U) << U(8 * REACH)
    for k in range(1, min(REACH, n - 1) + 1):
        byte = data[:-k].astype(U)
        byte[place[k:] < k] = 0
        out[k:] |= byte << U(8 * (k - 1))
    return out


class Code:
    """Bytes as bits: the 15 most frequent in four, all others in an escape of four and their eight.
    A byte so takes five steps on average instead of eight."""

    def __init__(self, counts: np.ndarray):
        self.rank = np.full(256, 15, np.uint8)
        self.rank[np.argsort(-counts, kind="stable")[:15]] = np.arange(15)

    def steps(self, context: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray, np.ndarray]]:
        """For each bit: the bytes that have it, its contexts (inputs x bytes), its value."""
        rank = self.rank[data]
        for k in range(4):
            yield slice(None), self._nodes(context, (1 << k) | (rank >> (4 - k)).astype(np.uint32)), (rank >> (3 - k)) & 1
        rare = np.flatnonzero(rank == 15)
        if len(rare):
            context, data = context[:, rare], data[rare]
            for k in range(8):
                yield rare, self._nodes(context, np.uint32(256) + ((1 << k) | (data.astype(np.uint32) >> (8 - k)))), (data >> (7 - k)) & 1

    @staticmethod
    def _nodes(context: np.ndarray, node: np.ndarray) -> np.ndarray:
        return context + node.astype(U) * U(0xD1342543DE82EF95)


class Speller:
    GATES = 16 * 4

    def __init__(self, code: Code, mixer: Mixer):
        self.code, self.mixer = code, mixer

    @staticmethod
    def slots_for(words: int) -> tuple[int, ...]:
        """Slots that follow the number of training words, 2^24 in all at most."""
        n = min(max((4 * words).bit_length(), 14), 22)
        return (14, min(n, 18), min(n, 20), n)

    @staticmethod
    def situations(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (bytes before, byte) of all words: contexts, byte and times; which one each byte is; words' ends.  What a
        bit costs depends on nothing else, so each situation is worked out once."""
        data, ends = spelled(words)
        key = packed(data, ends)
        order, new = ordered(K.mix(key.copy()))
        first = np.flatnonzero(new)
        found, times = key[order[first]], np.diff(np.append(first, len(key)))
        which = np.empty(len(key), np.int64)
        which[order] = np.repeat(np.arange(len(first)), times)
        before = found & U((1 << (8 * REACH)) - 1)
        context = np.stack([K.mix((before & U((1 << (8 * k)) - 1)) + U(_SEED[k])) for k in range(1, REACH + 1)])
        return context, (found >> U(8 * REACH)).astype(np.uint8), times.astype(np.float32), which, ends

    def gate(self, at: list[np.ndarray], own: float | None) -> np.ndarray:
        """How much the two longest contexts have been seen."""
        part, whole = (np.maximum(self.mixer.counts[a] + self.mixer.counts[a + 1] - (own or 0), 0) for a in at[-2:])
        return np.minimum(np.log2(whole + 1), 15).astype(np.int64) * 4 + np.minimum(np.log2(part + 1) / 3, 3).astype(np.int64)

    def learn(self, words: list[bytes], only_count: bool) -> None:
        context, byte, times, _, _ = self.situations(words)
        for k in range(0, len(byte), STEP):
            part = slice(k, k + STEP)
            for on, ctx, bit in self.code.steps(context[:, part], byte[part]):
                at = self.mixer.slots(ctx)
                if only_count:
                    self.mixer.note(at, bit, times[part][on])
                else:
                    self.mixer.learn(at, self.gate(at, 1.0), bit, count=False, own=np.float32(1), times=times[part][on])

    def word_bits(self, words: list[bytes], own: float | None) -> np.ndarray:
        """Bits to spell each word; ``own``: how often the word itself is among those learnt from."""
        context, byte, _, which, ends = self.situations(words)
        cost = np.zeros(len(byte))
        for k in range(0, len(byte), STEP):
            part = cost[k : k + STEP]
            for on, ctx, bit in self.code.steps(context[:, k : k + STEP], byte[k : k + STEP]):
                at = self.mixer.slots(ctx)
                part[on] += self.mixer.bits(at, self.gate(at, own), bit.astype(np.float32), own)
        total = np.concatenate([[0], np.cumsum(cost[which])])
        return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def _chunks(words: list[bytes], limit: int = 1 << 21) -> Iterator[list[bytes]]:
    """Runs of words of a bounded number of bytes."""
    at = size = 0
    for k, w in enumerate(words):
        size += len(w) + 1
        if size >= limit:
            yield words[at : k + 1]
            at, size = k + 1, 0
    if at < len(words):
        yield words[at:]


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256)
    for batch in batches:
        for words in _chunks(batch.column("word").to_pylist()):
            total += np.bincount(spelled(words)[0], minlength=256)
    yield pa.RecordBatch.from_pydict({"byte": pa.array(np.arange(256, dtype=np.int32)), "n": pa.array(total)})


def speller(vocabulary: DataFrame, words: int) -> Callable[[], Speller]:
    """Learnt from every training word once: first the counts of all, then weights and refinement, each
    word being left out of the counts when it is met."""
    sc = vocabulary.sparkSession.sparkContext
    trained = vocabulary.where("d > 0").select("word")
    frequency = np.zeros(256)
    for r in trained.mapInArrow(K.task(_byte_counts), "byte int, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        frequency[r.byte] = r.n
    code, log_slots = Code(frequency), Speller.slots_for(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Speller(code, Mixer(log_slots, Speller.GATES))
        for batch in batches:
            for part in _chunks(batch.column("word").to_pylist()):
                own.learn(part, only_count=True)
        yield from _shares(own.mixer)

    counts = np.zeros(2 * sum(1 << n for n in log_slots), np.uint8)
    for r in _blocks(trained, count):
        for at, zeros, ones in _counts(r):
            at = 2 * (at + (r["block"] << BLOCK))
            counts[at], counts[at + 1] = _narrow(zeros), _narrow(ones)
    tables = sc.broadcast(counts)
    del counts

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Speller(code, Mixer(log_slots, Speller.GATES, _wide(tables.value)))
        for batch in batches:
            for part in _chunks(batch.column("word").to_pylist()):
                own.learn(part, only_count=False)
        if own.mixer.mass:
            yield _learnt(own.mixer)

    settled = gathered(trained, weigh, lambda: Mixer((1, 1, 1, 1), Speller.GATES))
    weights, refine = settled.weights, settled.refine

    def made() -> Speller:
        mixer = Mixer(log_slots, Speller.GATES, _wide(tables.value))
        mixer.weights, mixer.refine = weights, refine
        return Speller(code, mixer)

    return made


# --- Words: was the next one met before in this text?

WORD_SLOTS, WORD_GATES = (11, 13, 16, 16), 16 * 4


class Tokens:
    """The words of a block and each document's end token, in order, with what is known before each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = K.Words(data, offsets)
        self.count = words.count + 1
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        n, docs = int(self.first[-1]), len(self.count)
        self.ends = self.first[1:] - 1
        inside = np.ones(n, bool)
        inside[self.ends] = False
        self.hash = np.full(n, _END_HASH, U)
        self.hash[inside] = words.hashes(data)
        self.start, self.stop = np.zeros((2, n), np.int64)  # of its bytes
        self.start[inside], self.stop[inside] = words.start, words.end
        self.doc = np.repeat(np.arange(docs), self.count)
        self.place = np.arange(n) - self.first[self.doc]
        key = K.mix(self.hash + self.doc.astype(U) * U(0x9E3779B97F4A7C15))
        self.order, new = ordered(key)
        self.group = np.flatnonzero(new)  # where each distinct word of a document begins in ``order``
        times = np.diff(np.append(self.group, n))
        self.before = np.empty(n, np.int64)  # earlier occurrences in the document
        self.before[self.order] = np.arange(n) - np.repeat(self.group, times)
        self.tf = times  # by distinct word
        self.firsts = self.order[self.group]  # and its first occurrence

    def decisions(self, mixer: Mixer) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Slots, gate and outcome of each token."""
        n, place = len(self.hash), self.place
        hit = (self.before > 0).astype(np.int64)
        last = np.zeros(n, np.int64)
        for k in range(1, 7):
            on = place[k:] >= k
            last[k:] += (hit[:-k] * on) << (k - 1)
        total = np.cumsum(hit) - hit
        far = np.minimum(np.log2(place + 1), 15).astype(np.int64)
        share = (8 * (total - total[self.first[:-1]][self.doc])) // (place + 1)
        previous = np.zeros(n, U)
        previous[1:] = self.hash[:-1]
        previous[self.first[:-1]] = U(0)
        at = mixer.slots([far * 8 + share, last * 8 + far // 2, previous, previous + (last & 3).astype(U)])
        return at, far * 4 + (last & 3), hit


# --- Which class the next word is of.

CLASS_BITS = 3
CLASSES = 1 << CLASS_BITS
CLASS_GATES = 2 * CLASSES
_STEP = U(0x8CB92BA72F3D8DD7)


def class_of(hashes: np.ndarray) -> np.ndarray:
    """A word's class, by its hash: so classes need no table."""
    return (K.mix(hashes * U(0x9E3779B97F4A7C15)) >> U(64 - CLASS_BITS)).astype(np.int64)


def class_slots(words: int, tokens: int) -> tuple[int, ...]:
    """Slots for the previous word, the previous two, and the text so far, as many as training has words and tokens, at most 2^20 and 2^21."""
    return tuple(min(max(10, (x * CLASSES).bit_length()), most) for x, most in ((words, 20), (tokens, 21))) + (11,)


def class_decisions(tokens: Tokens, mixer: Mixer) -> tuple[list[tuple[list[np.ndarray], np.ndarray, np.ndarray]], np.ndarray]:
    """Slots, gate and outcome of each bit of each token's class, and how many tokens of its class the text had before."""
    n, start, own = len(tokens.hash), tokens.first[:-1], np.arange(len(tokens.hash))
    kind, hit = class_of(tokens.hash), (tokens.before > 0).astype(np.int64)
    one, two = np.zeros((2, n), U)
    one[1:], two[2:] = tokens.hash[:-1], tokens.hash[:-2]
    one[start] = two[start] = U(0)
    two[tokens.place == 1] = U(0)
    two = K.mix(two * _STEP + one)
    upto = np.zeros((CLASSES + 1, n), np.int32)  # tokens before, of the classes below each
    for c in range(CLASSES):
        here = (kind == c).astype(np.int32)
        before = np.cumsum(here, dtype=np.int32) - here
        upto[c + 1] = upto[c] + before - before[start][tokens.doc]
    out, node = [], np.ones(n, np.int64)
    for b in range(CLASS_BITS):
        wide = CLASSES >> b
        low = (node - (1 << b)) * wide
        middle, most = upto[low + wide // 2, own], upto[low + wide, own]
        all_, ones = (most - upto[low, own]).astype(np.int64), (most - middle).astype(np.int64)
        lean = 8 * (2 * ones + 1) // (2 * all_ + 2)
        far = np.minimum(np.log2(all_ + 1), 7).astype(np.int64)
        gate = node * 2 + hit
        key = gate.astype(U) * _STEP
        bit = (kind >> (CLASS_BITS - 1 - b)) & 1
        out.append((mixer.slots([one + key, two + key, (lean * 8 + far) * CLASS_GATES + gate]), gate, bit))
        node = node * 2 + bit
    return out, (upto[kind + 1, own] - upto[kind, own]).astype(np.int64)


def phrases(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token of each phrase, its hash, and each document's first phrase (one more at the end).  End
    tokens are phrases of their own, with hash 0."""
    h, n = tokens.hash, len(tokens.hash)
    cut_after = np.zeros(n, bool)
    cut_after[1:] = K.mix(h[1:] * U(3) + h[:-1]) % U(PHRASE) == 0
    cut_after[tokens.first[:-1]] = False
    cut_after[tokens.ends] = True
    cut_after[tokens.ends[tokens.count > 1] - 1] = True
    begin = np.zeros(n, np.int64)
    begin[1:] = np.where(cut_after[:-1], np.arange(1, n), 0)
    begin = np.maximum.accumulate(begin)
    cut_after |= (np.arange(n) - begin) % LONGEST == LONGEST - 1
    starts = np.concatenate([[0], np.flatnonzero(cut_after[:-1]) + 1]) if n else np.zeros(0, np.int64)
    stops = np.append(starts[1:], n)
    roll = K._ROLL[3]
    keys = K.mix(roll.spans(roll.prefix(h), starts, stops) + (stops - starts).astype(U)) | U(1)
    keys[h[starts] == _END_HASH] = 0
    return starts, keys, np.searchsorted(starts, tokens.first)


def word_mixers(docs: DataFrame, slots: tuple[int, ...]) -> list[Mixer]:
    """Mixers of words and of their classes, learnt online from every training text, slice by slice."""
    makes = lambda: Mixer(WORD_SLOTS, WORD_GATES), lambda: Mixer(slots, CLASS_GATES)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes = (make() for make in makes)
        for batch in batches:
            for _, data, offsets in K.blocks(batch):
                tokens = Tokens(K.LOWER[data], offsets)
                decisions = tokens.decisions(words)
                steps, _ = class_decisions(tokens, classes)
                for k in range(0, len(tokens.hash), STEP):
                    part = slice(k, k + STEP)
                    for mixer, (at, gate, bit) in ((words, decisions), *((classes, x) for x in steps)):
                        mixer.learn([a[part] for a in at], gate[part], bit[part])
        for number, mixer in enumerate((words, classes)):
            if mixer.mass:
                yield from _shares(mixer, number)
                yield _learnt(mixer, number)

    return all_gathered(docs.where(~F.col("held_out")).select("text"), learn, *makes)


# --- Phrases: does the next one occur in another training text?

PHRASE_SLOTS, PHRASE_GATES = (10, 9, 9, 9), 16


def phrase_decisions(seen: np.ndarray, first: np.ndarray, mixer: Mixer) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slots, gate and outcome of each phrase; ``seen``: its occurrences in other training texts."""
    n = len(seen)
    count = np.diff(first)
    place = np.arange(n) - np.repeat(first[:-1], count)
    hit = (seen > 0).astype(np.int64)
    last = np.zeros(n, np.int64)
    for k in range(1, 9):
        on = place[k:] >= k
        last[k:] += (hit[:-k] * on) << (k - 1)
    total = np.cumsum(hit) - hit
    total -= np.repeat(total[first[:-1][count > 0]], count[count > 0])
    far = np.minimum(np.log2(place + 1), 7).astype(np.int64)
    common = np.zeros(n, np.int64)
    common[1:] = np.minimum(np.log2(np.maximum(seen[:-1], 0) + 1), 15).astype(np.int64)
    common[place == 0] = 0
    run = np.minimum(place, 8)
    for k in range(7, -1, -1):
        run[(last >> k) & 1 == 0] = k
    run = np.minimum(run, place)
    at = mixer.slots([last, common * 2 + (last & 1), run * 8 + far, (8 * total // (place + 1)) * 8 + far])
    return at, (last & 3) * 4 + np.minimum(far, 3), hit


# --- The corpus.


class Vocabulary:
    """Of each word of a task: tokens and texts that train, tokens in all, and the word itself."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.words: list[pa.Array] = []
        self.size = 0

    def add(self, tokens: Tokens, data: np.ndarray, held: np.ndarray) -> None:
        """Distinct words of a block; ``data`` holds its lower-cased bytes."""
        once, tf = tokens.firsts, tokens.tf
        train = ~held[tokens.doc[once]]
        order, new = ordered(tokens.hash[once])
        begin = np.flatnonzero(new)
        c, d, n = (np.add.reduceat(x[order], begin) for x in (tf * train, train.astype(np.int64), tf))
        at = once[order[begin]]
        # Bytes of the words, end to end; the end token has none of its own in the block.
        is_end = tokens.hash[at] == _END_HASH
        start, stop = tokens.start[at], tokens.stop[at]
        sizes = np.where(is_end, 1, stop - start)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        src = np.repeat(np.where(is_end, len(data), start) - ends[:-1], sizes) + np.arange(ends[-1])
        body = np.append(data, END[0]).astype(np.uint8)[src]
        self.words.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())]))
        self.parts.append((tokens.hash[at], c, d, n))
        self.size += len(at)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        hashes, c, d, n = (np.concatenate(x) for x in zip(*self.parts))
        words = pa.concat_arrays(self.words)
        order, new = ordered(hashes)
        begin = np.flatnonzero(new)
        sums = [np.add.reduceat(x[order], begin) for x in (c, d, n)]
        at = order[begin]
        for k in range(0, len(at), 50_000):
            part = slice(k, k + 50_000)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(at[part])), *(pa.array(x[part]) for x in sums)], ["word", "c", "d", "n"])
        self.__init__()


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = Vocabulary()
    for batch in batches:
        for row, data, offsets in K.blocks(batch):
            data = K.LOWER[data]
            held = batch.column("held_out").slice(row, len(offsets) - 1).to_numpy(zero_copy_only=False).astype(bool)
            found.add(Tokens(data, offsets), data, held)
            if found.size >= FLUSH:
                yield from found.rows()
    yield from found.rows()


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of all words of each class."""
    total = np.zeros(CLASSES, np.int64)
    for batch in batches:
        if batch.num_rows:
            np.add.at(total, class_of(hashed(batch.column("word").cast(pa.binary()))), batch.column("d").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(total)], ["class", "d"])


def hashed(words: list[bytes] | pa.Array) -> np.ndarray:
    """The hashes that these words have in texts."""
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1 + words.offset)[words.offset :].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    roll = K._ROLL[1]
    out = roll.spans(roll.prefix(K._BYTES[0][data]), at[:-1], at[1:])
    one = np.flatnonzero(np.diff(at) == 1)
    out[one[data[at[one]] == END[0]]] = _END_HASH
    return out


class Index:
    """Places of hashes in a list, found by probing a table four times its size or more."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.log = max(4, (4 * len(hashes)).bit_length())
        self.table = np.full(1 << self.log, -1, np.int32)
        left = np.arange(len(hashes), dtype=np.int32)
        slot = self.slots(hashes)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of several the last one stays
            placed = self.table[slot] == left
            left, slot = left[~placed], (slot[~placed] + 1) & (len(self.table) - 1)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * U(0x9E3779B97F4A7C15)) >> U(64 - self.log)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for those that are not listed."""
        out = np.full(len(hashes), -1, np.int64)
        left, slot = np.arange(len(hashes)), self.slots(hashes)
        while len(left):
            at = self.table[slot]
            found = (at >= 0) & (self.hashes[at] == hashes[left]) if len(self.hashes) else np.zeros(len(at), bool)
            out[left[found]] = at[found]
            on = (at >= 0) & ~found
            left, slot = left[on], (slot[on] + 1) & (len(self.table) - 1)
        return out


def lines(data: np.ndarray, start: np.ndarray, stop: np.ndarray, ends: np.ndarray) -> pa.Array:
    """For each document its words (``ends``: where its words begin in the list, one more at the end), a blank between."""
    sizes = stop - start + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    src = np.repeat(start - at[:-1], sizes) + np.arange(at[-1])
    body = np.append(data, 0).astype(np.uint8)[np.minimum(src, len(data))]
    body[at[1:] - 1] = 32
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])


VOCABULARY = "word binary, c long, d long, n long"
ROWS = "row_key long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, keys array<long>, bits array<float>, words binary, tf array<int>, at array<int>"
_ROW_NAMES = [x.split()[0] for x in ROWS.split(", ")]
WHOLE = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, seen array<int>, bits array<float>"


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and where each row's begin (one more at the end)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.concatenate([[0], np.cumsum(sizes)])


def score(docs: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """One row per document: token counts, the base score and the model's."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))
    docs = with_key(docs).withColumn("held_out", held)
    vocabulary = docs.select("held_out", "text").mapInArrow(K.task(_vocabulary), VOCABULARY).groupBy("word").agg(*(F.sum(c).alias(c) for c in ("c", "d", "n")))
    vocabulary = cut(vocabulary)
    sums = vocabulary.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("c", "d")), F.count_if(F.col("c") > 0), F.count_if(F.col("d") == 1)).first()
    total, pairs, distinct, lone = (int(x) for x in sums)
    novel = min(max(lone / pairs, 1e-6), 1 - 1e-6) if pairs else 1 - 1e-6
    make = speller(vocabulary, distinct)
    # What share of first occurrences each class has; a new word is of any class alike.
    by_class = vocabulary.select("word", "d").mapInArrow(K.task(_by_class), "class int, d long").groupBy("class").agg(F.sum("d").alias("d")).collect()  # a row a class
    mass = np.full(CLASSES, novel / CLASSES)
    for r in by_class:
        mass[r["class"]] += (1 - novel) * r.d / max(pairs, 1)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bits of words that are new to held-out texts (d = 0) or to the only text that has them (d = 1)."""
        own = make()
        for batch in batches:
            words, d = batch.column("word").to_pylist(), batch.column("d").to_numpy()
            bits = np.zeros(len(words))
            for n in (0, 1):
                at = np.flatnonzero(d == n)
                if len(at):
                    bits[at] = np.concatenate([own.word_bits(w, float(n) or None) for w in _chunks([words[k] for k in at.tolist()])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits)], [*batch.schema.names, "spelled"])

    new = F.col("spelled") - math.log2(novel)
    known = lambda d: -F.log2(d * ((1 - novel) / max(pairs, 1)))
    base_score = F.log10(F.lit(1.0) * (F.col("c") + 1) / F.lit(float(total + distinct + 1)))
    # What the word costs a held-out text, and a training text, which is not counted among the word's texts.
    prices = [F.when(F.col("d") > k, known(F.col("d") - k)).otherwise(new).alias(name) for k, name in ((0, "held_bits"), (1, "train_bits"))]

    def costed(words: DataFrame) -> DataFrame:
        return words.mapInArrow(K.task(spell), VOCABULARY + ", spelled double").select("word", "c", base_score.alias("base"), *prices)

    # Words over the least count that no more than ``dictionary`` words reach.
    step = F.floor(8 * F.log2("n"))
    most, at = 0, None
    for r in vocabulary.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():  # a few hundred rows
        most += r["count"]
        if most > dictionary:
            break
        at = r.s
    names = ("c", "base", "held_bits", "train_bits")
    listed = (F.col("word") == F.lit(END)) | (step >= at if at is not None else F.lit(False))
    frequent = costed(vocabulary.where(listed)).select("word", *names).toArrow().combine_chunks()
    hashes = hashed(frequent.column("word").chunk(0).cast(pa.binary()) if len(frequent) else [])
    c, base, *costs = (np.append(frequent.column(x).to_numpy(), 0) for x in names)
    shared = spark.sparkContext.broadcast((word_mixers(docs, class_slots(distinct, total)), hashes, c > 0, base, np.stack(costs)))
    del frequent, hashes, c, base, costs

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (mixer, classes), hashes, c, base, costs = shared.value
        index = Index(hashes)
        for batch in batches:
            for row, data, offsets in K.blocks(batch):
                docs_here = len(offsets) - 1
                held = batch.column("held_out").slice(row, docs_here).to_numpy(zero_copy_only=False).astype(bool)
                lower = K.LOWER[data]
                tokens = Tokens(lower, offsets)
                n_bytes = np.bincount(tokens.doc, tokens.stop - tokens.start, docs_here).astype(np.int64) + tokens.count
                at = index.find(tokens.hash)  # -1: the last place, which is zero
                slots, gate, hit = tokens.decisions(mixer)
                train = (~held).astype(np.float32)
                bits = mixer.bits(slots, gate, hit.astype(np.float32), train[tokens.doc])
                steps, alike = class_decisions(tokens, classes)
                for own_slots, own_gate, bit in steps:
                    bits += classes.bits(own_slots, own_gate, bit.astype(np.float32), train[tokens.doc])
                # The class being known, a word is one of its class: of the text's so far, or of the first occurrences'.
                again = np.flatnonzero(hit)
                bits[again] += np.log2(alike[again] / tokens.before[again])
                once = tokens.firsts
                bits[once] += np.log2(mass[class_of(tokens.hash[once])])
                bits[once] += costs[train[tokens.doc[once]].astype(np.int64), at[once]]
                starts, keys, first = phrases(tokens)
                by_phrase = np.add.reduceat(bits, starts) if len(starts) else np.zeros(0)
                known, sums = np.bincount(tokens.doc, c[at], docs_here).astype(np.int64), np.bincount(tokens.doc, base[at], docs_here)
                # Distinct words that are not in the dictionary, by document and place.
                rare = np.flatnonzero(at[once] < 0)
                rare = rare[np.argsort(once[rare])]
                place = once[rare]
                doc = tokens.doc[place]
                ends = np.searchsorted(doc, np.arange(docs_here + 1))
                blobs = lines(lower, tokens.start[place], tokens.stop[place], ends)
                phrase = np.searchsorted(starts, place, "right") - 1 - first[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_key").slice(row, docs_here), batch.column("doc_id").slice(row, docs_here), pa.array(held), pa.array(tokens.count), pa.array(n_bytes), pa.array(known), pa.array(sums),
                        _lists(keys.view(np.int64), first), _lists(by_phrase.astype(np.float32), first), blobs, _lists(tokens.tf[rare].astype(np.int32), ends), _lists(phrase.astype(np.int32), ends),
                    ],
                    _ROW_NAMES,
                )

    made = cut(docs.select("row_key", "doc_id", "held_out", "text").mapInArrow(K.task(rows), ROWS))
    # Rare words meet their costs by word.
    zipped = F.arrays_zip(F.split(F.rtrim(F.col("words").cast("string")), " ").alias("word"), F.col("tf"), F.col("at"))
    rare = made.where(F.size("tf") > 0).select("row_key", "held_out", F.inline(zipped)).withColumn("word", F.col("word").cast("binary"))
    tail = costed(vocabulary.where(~listed)).withColumnRenamed("word", "rare")
    met = rare.join(tail, F.col("word") == F.col("rare"))
    cost = F.when(F.col("held_out"), F.col("held_bits")).otherwise(F.col("train_bits"))
    # A set, as repeated rows bring the same words again.
    one = F.struct(F.xxhash64("word").alias("w"), F.col("at"), cost.cast("float").alias("bits"), (F.col("tf") * F.col("base")).alias("base"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("known"))
    met = met.groupBy(F.col("row_key").alias("rare_key")).agg(F.collect_set(one).alias("rare"))
    # Phrases: counted in training texts; those that some text shares with another training text come back to it.
    phrase = made.select("row_key", "held_out", F.explode("keys").alias("key")).where("key <> 0")
    counts = phrase.groupBy("key").agg(F.count_if(~F.col("held_out")).alias("n"), F.count_if(F.col("held_out")).alias("h"))
    mass = made.where(~F.col("held_out")).agg(F.coalesce(F.sum(F.size("keys") - 1), F.lit(0))).first()[0]  # the last is the end
    shared_phrases = small(cut(counts.where("n > 1 or (n = 1 and h > 0)").select(F.col("key").alias("other"), F.least("n", F.lit(1 << 30)).cast("int").alias("n"))), PHRASE_ROWS)
    back = phrase.select("row_key", "key").join(shared_phrases, F.col("key") == F.col("other"))
    back = back.groupBy(F.col("row_key").alias("back_key")).agg(F.collect_set(F.struct("key", "n")).alias("found"))
    whole = made.drop("words", "tf", "at").join(met, F.col("row_key") == F.col("rare_key"), "left").join(back, F.col("row_key") == F.col("back_key"), "left")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bits of each phrase with its rare words', and how often it occurs in other training texts."""
        for batch in batches:
            if not batch.num_rows:
                continue
            bits, first = _flat(batch.column("bits"), np.float64)
            keys, _ = _flat(batch.column("keys"), np.int64)
            base, known = (batch.column(x).to_numpy().copy() for x in ("base", "n_known"))
            rare = batch.column("rare")
            each, ends = rare.flatten(), np.concatenate([[0], np.cumsum(rare.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            if len(each):
                doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                column = lambda name: each.field(name).to_numpy(zero_copy_only=False)
                np.add.at(bits, first[doc] + column("at"), column("bits"))
                base += np.bincount(doc, column("base"), batch.num_rows)
                known += np.bincount(doc, column("known"), batch.num_rows).astype(np.int64)
            seen = np.zeros(len(keys), np.int64)
            found = batch.column("found")
            each, ends = found.flatten(), np.concatenate([[0], np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for d in np.flatnonzero(np.diff(ends)):  # documents that share a phrase
                part = each.slice(ends[d], ends[d + 1] - ends[d])
                of, n = (part.field(x).to_numpy(zero_copy_only=False) for x in ("key", "n"))
                order = np.argsort(of)
                of, n = of[order], n[order]
                own = keys[first[d] : first[d + 1]]
                at = np.minimum(np.searchsorted(of, own), len(of) - 1)
                times = np.where(of[at] == own, n[at], 0)
                if not held[d]:
                    _, inverse, many = np.unique(own, return_inverse=True, return_counts=True)
                    times = times - many[inverse.reshape(-1)]
                seen[first[d] : first[d + 1]] = np.maximum(times, 0)
            seen[keys == 0] = -1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("doc_id", "held_out", "n_tokens")), pa.array(known), batch.column("n_bytes"), pa.array(base), _lists(seen.astype(np.int32), first), _lists(bits.astype(np.float32), first)],
                [x.split()[0] for x in WHOLE.split(", ")],
            )

    whole = cut(whole.select("doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base", "keys", "bits", "rare", "found").mapInArrow(K.task(joined), WHOLE))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(PHRASE_SLOTS, PHRASE_GATES)
        for batch in batches:
            seen, first = _flat(batch.column("seen"), np.int64)
            at, gate, hit = phrase_decisions(seen, first, mixer)
            on = np.flatnonzero(seen >= 0)
            for k in range(0, len(on), STEP):
                part = on[k : k + STEP]
                mixer.learn([a[part] for a in at], gate[part], hit[part])
        if mixer.mass:
            yield from _shares(mixer)
            yield _learnt(mixer)

    phrase_mixer = gathered(whole.where(~F.col("held_out")).select("seen"), learn, lambda: Mixer(PHRASE_SLOTS, PHRASE_GATES))
    settled = spark.sparkContext.broadcast(phrase_mixer)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = settled.value
        for batch in batches:
            if not batch.num_rows:
                continue
            seen, first = _flat(batch.column("seen"), np.int64)
            bits, _ = _flat(batch.column("bits"), np.float64)
            at, gate, hit = phrase_decisions(seen, first, mixer)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            train = 1 - batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.float32)
            flag = mixer.bits(at, gate, hit.astype(np.float32), train[doc])
            named = np.log2(max(mass, 1) / np.maximum(seen, 1))
            spent = np.where(seen < 0, bits, flag + np.where(hit == 1, named, bits))
            spent = np.bincount(doc, spent, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base")), pa.array(spent)], ["doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base", "bits"])

    out = whole.mapInArrow(K.task(price), "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, bits double")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (-F.col("bits") * math.log10(2)).alias("score"), (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
