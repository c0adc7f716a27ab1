"""Context mixing: exact base, a plain version of the score, and what a language model must tell apart."""

import math
import random
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelmill.llm import kernel, op02_mixing as op


@pytest.mark.parametrize("dictionary", [0, 50, 1 << 18])
def test_base(docs, rows, dictionary):
    want = brute.unigram(rows)
    out = op.score(docs, dictionary=dictionary).collect()
    assert len(out) == len(rows)
    for r in out:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and math.isfinite(r.score)


def corpus():
    rng = random.Random(11)
    syllables = ["ba", "ro", "ti", "ne", "shu", "qu", "el"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(300)], k=n))
    texts = [prose(rng.randint(1, 160)) for _ in range(60)]
    texts += [texts[3], texts[5] + " " + texts[9], None, "", "ha " * 300, " ".join(reversed(texts[7].split())), "Ünseen wörds \n here"]
    return [(k, t) for k, t in enumerate(texts)]


def test_score_against_a_plain_version(spark, monkeypatch):
    """The trained mixers, asked decision by decision in plain loops over the words of each text."""
    mixers, pairs_of, spellers, gathered, speller, word_mixers = [], [], [], op.gathered, op.speller, op.word_mixers
    monkeypatch.setattr(op, "word_mixers", lambda *a: pairs_of.append(word_mixers(*a)) or pairs_of[-1])
    monkeypatch.setattr(op, "gathered", lambda *a: mixers.append(gathered(*a)) or mixers[-1])
    monkeypatch.setattr(op, "speller", lambda *a: spellers.append(speller(*a)) or spellers[-1])
    rows = corpus()
    got = {r.doc_id: r.score for r in op.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    (words_of, classes_of), phrases_of, spell = pairs_of[-1], mixers[-1], spellers[-1]()
    held = {d: x[0] for d, x in brute.unigram(rows).items()}
    texts = {d: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split() for d, t in rows}
    train = [d for d in texts if not held[d]]
    df = Counter(w for d in train for w in {*texts[d], op.END})
    pairs = sum(df.values())
    novel = sum(n == 1 for n in df.values()) / pairs
    kind = lambda w: int(op.class_of(op.hashed([w]))[0])
    share = [novel / op.CLASSES + (1 - novel) * sum(n for w, n in df.items() if kind(w) == c) / pairs for c in range(op.CLASSES)]
    hashes = dict(zip(vocabulary := sorted({w for t in texts.values() for w in t}), op.hashed(vocabulary).tolist()))
    mask = (1 << 64) - 1

    def cut(tokens):
        out, now = [], []
        for k, w in enumerate(tokens):
            now.append(w)
            last = k + 1 == len(tokens)
            mark = k > 0 and int(kernel.mix(np.array([(hashes[w] * 3 + hashes[tokens[k - 1]]) & mask], np.uint64))[0]) % op.PHRASE == 0
            if last or mark or len(now) == op.LONGEST:
                out.append(tuple(now))
                now = []
        return out

    counts = Counter(p for d in train for p in cut(texts[d]))

    def decide(mixer, contexts, gate, bit, own):
        at = mixer.slots([np.array([c & mask], np.uint64) for c in contexts])
        return float(mixer.bits(at, np.array([gate]), np.array([bit], np.float32), np.float32(own))[0])

    far = lambda place, most: min(int(math.log2(place + 1)), most)
    for d, tokens in texts.items():
        own = 0 if held[d] else 1
        costs, met, hits, kinds = [], Counter(), [], []
        for place, w in enumerate([*tokens, op.END]):
            hit = int(met[w] > 0)
            last = sum(h << k for k, h in enumerate(reversed(hits[-6:])))
            previous = hashes[tokens[place - 1]] if place else 0
            f = far(place, 15)
            cost = decide(words_of, [f * 8 + 8 * sum(hits) // (place + 1), last * 8 + f // 2, previous, previous + (last & 3)], f * 4 + (last & 3), hit, own)
            two = hashes[tokens[place - 2]] if place > 1 else 0
            two = int(kernel.mix(np.array([(two * int(op._STEP) + previous) & mask], np.uint64))[0])
            node, c = 1, kind(w)
            for b in range(op.CLASS_BITS):
                inside = [k for k in kinds if (k + op.CLASSES) >> (op.CLASS_BITS - b) == node]
                ones = sum((k >> (op.CLASS_BITS - 1 - b)) & 1 for k in inside)
                lean, gate, bit = 8 * (2 * ones + 1) // (2 * len(inside) + 2), node * 2 + hit, (c >> (op.CLASS_BITS - 1 - b)) & 1
                key = gate * int(op._STEP)
                cost += decide(classes_of, [previous + key, two + key, (lean * 8 + far(len(inside), 7)) * op.CLASS_GATES + gate], gate, bit, own)
                node = node * 2 + bit
            if hit:
                cost += math.log2(kinds.count(c) / met[w])
            else:
                cost += math.log2(share[c])
            if hit:
                pass
            elif df[w] > own:
                cost -= math.log2((1 - novel) * (df[w] - own) / pairs)
            else:
                cost += spell.word_bits([w], float(own) or None)[0] - math.log2(novel)
            costs.append(cost)
            met[w] += 1
            hits.append(hit)
            kinds.append(c)
        total, at, flags, common = costs[-1], 0, [], 0
        mine = cut(tokens)
        for place, p in enumerate(mine):
            seen = counts[p] - own * mine.count(p)
            hit = int(seen > 0)
            last = sum(h << k for k, h in enumerate(reversed(flags[-8:])))
            run = 0
            while run < min(8, place) and flags[-1 - run]:
                run += 1
            f = far(place, 7)
            total += decide(phrases_of, [last, common * 2 + (last & 1), run * 8 + f, 8 * sum(flags) // (place + 1) * 8 + f], (last & 3) * 4 + min(f, 3), hit, own)
            total += math.log2(sum(counts.values()) / seen) if hit else sum(costs[at : at + len(p)])
            at += len(p)
            common = min(int(math.log2(seen + 1)), 15) if hit else 0
            flags.append(hit)
        assert math.isclose(got[d], -total * math.log10(2), rel_tol=1e-6, abs_tol=1e-5), d


def chain(rng, words, n):
    """Text of a Markov chain: each word has four followers of its own."""
    out = [rng.choice(words)]
    for _ in range(n - 1):
        out.append(words[(words.index(out[-1]) * 7 + rng.choice([1, 1, 1, 2, 2, 5, 11])) % len(words)])
    return out


def test_the_order_of_known_words_counts(spark):
    """Held-out text of a chain scores better than the same words shuffled, and than the unigram."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcdefghijk", k=rng.randint(2, 6))) for _ in range(400)})
    rows = [(k, " ".join(chain(rng, words, rng.randint(60, 200)))) for k in range(700)]
    held = {d for d, x in brute.unigram(rows).items() if x[0]}
    shuffled = {}
    for d in sorted(held):
        own = dict(rows)[d].split()
        rng.shuffle(own)
        twin = next(k for k in range(10_000 + len(shuffled) * 40, 10**6) if k not in shuffled.values() and brute.unigram([(k, "")])[k][0])
        shuffled[d] = twin
        rows.append((twin, " ".join(own)))
    out = {r.doc_id: r for r in op.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    better = sum(out[d].score > out[t].score for d, t in shuffled.items())
    over = sum(out[d].score > out[d].base_score for d in held)
    assert len(held) > 80 and better >= 0.97 * len(held) and over >= 0.97 * len(held)


def test_what_a_language_model_tells_apart(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    twice, order = prose(200), "the cat sat on the mat and the dog sat on the log " * 2
    rows = [(k, prose(200)) for k in range(80)] + [(100, twice), (101, twice), (200, order + prose(50))]
    rows.append((201, " ".join(reversed(rows[-1][1].split()))))
    out = {r.doc_id: r for r in op.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert max(out[100].bits_per_byte, out[101].bits_per_byte) < 0.5 * min(r.bits_per_byte for d, r in out.items() if d < 100)
    assert not math.isclose(out[200].score, out[201].score, rel_tol=1e-4)


def test_spelling_is_a_distribution(spark):
    docs = spark.createDataFrame([(k, "the cat sat on the mat " * 3 + f"x{k}") for k in range(9)], "doc_id long, text string")
    from pyspark.sql import functions as F

    found = docs.select(F.lit(False).alias("held_out"), "text").mapInArrow(op._vocabulary, op.VOCABULARY).groupBy("word").agg(*(F.sum(c).alias(c) for c in "cdn")).cache()
    own = op.speller(found, found.count())()
    total = 0.0
    for byte in range(256):
        context = np.stack([kernel.mix(np.zeros(1, np.uint64) + np.uint64(op._SEED[k])) for k in range(1, op.REACH + 1)])
        p = 1.0
        for _, ctx, bit in own.code.steps(context, np.array([byte], np.uint8)):
            at = own.mixer.slots(ctx)
            p *= 2 ** -own.mixer.bits(at, own.gate(at, None), bit.astype(np.float32))[0]
        total += p
    assert math.isclose(total, 1.0, rel_tol=0.02)


@given(st.lists(st.integers(0, 40), max_size=300))
@settings(max_examples=60, deadline=None)
def test_order_and_index(values):
    key = np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order, new = op.ordered(key)
    assert order.tolist() == np.argsort(key, kind="stable").tolist() and new.sum() == len(set(values))
    listed = np.unique(key)[::2]
    want = {int(h): k for k, h in enumerate(listed)}
    assert op.Index(listed).find(key).tolist() == [want.get(int(h), -1) for h in key]
