"""Bounds that must hold whatever the rows: what a fit gets, and how long one text takes."""

import random
import time
import zlib

import brute
import numpy as np
import pytest

from parcelmill.llm import op03_toxicity, op09_secrets


def test_an_id_that_stands_often_counts_once(spark, docs, labels, monkeypatch):
    from pyspark.sql import functions as F

    got = []
    fit = op03_toxicity.fit
    monkeypatch.setattr(op03_toxicity, "fit", lambda p, u, prior: got.append((len(p), len(u), prior)) or fit(p, u, prior))
    toxic = labels.where("toxic = 1 and doc_id < 200").select("doc_id").collect()
    some = next(r.doc_id for r in toxic if zlib.crc32(str(r.doc_id).encode()) % 5)
    op03_toxicity.train(docs, labels)
    often = docs.unionByName(docs.where(docs["doc_id"] == some).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(600)))).drop("k"))
    op03_toxicity.train(often, labels.unionByName(labels.where(labels["doc_id"] == some)))
    assert got[0] == got[1]
    op03_toxicity.train(often, labels, max_positive=5, max_unlabelled=7)
    assert got[2][0] <= 5 and got[2][1] <= 7


def test_fit_against_loops_over_documents():
    """The same steps, one document, place and sign at a time."""
    rng = np.random.default_rng(1)
    docs = [[np.flatnonzero(rng.random(8) < share).tolist() for _ in range(n)] for share, n in ((0.8, 30), (0.15, 70))]
    sets = [op03_toxicity.Sets(np.concatenate([np.array(r, np.int32) for r in rows]), np.cumsum([0, *map(len, rows)])) for rows in docs]
    for prior in (0.15, 0.3):
        model = op03_toxicity.fit(*sets, prior, epochs=15)
        places, weights, bias = brute.nn_pu(*docs, prior, epochs=15)
        assert model.places.tolist() == places and len(places) > 2
        assert np.allclose(model.values, weights, atol=1e-5)


def text_of(rng, parts):
    words = ["plain", "words", "here", "\n", "\n\n", "login: user%d", "client_id=ab%d", "https://host%d.example.com/x", "Ab1" * 9 + "%d", "x" * 25, "password = hunter%d2hunter", "AKIA" + "Q" * 16, "deadbeef" * 4]
    out = []
    for _ in range(parts):
        word = rng.choice(words)
        out.append(word % rng.randrange(9) if "%d" in word else word)
        out += ["filler"] * rng.choice([0, 0, 3, 40])
    return " ".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_linked_parts_as_by_every_pair(seed):
    rng = random.Random(seed)
    text = text_of(rng, rng.choice([3, 10, 40]))
    base = op09_secrets.base_spans(text)
    weak = op09_secrets.weak_candidates(text, any(k == "access" for _, _, k in base))
    walls = [m.start() for m in op09_secrets.SCOPE_END.finditer(text)]
    want = brute.linked_secrets(text, base, weak, walls, op09_secrets.REACH, lambda x: any(c.isalpha() for c in text[x[0] : x[1]]) and any(c.isdigit() for c in text[x[0] : x[1]]))
    assert sorted(op09_secrets.linked(text, base)) == sorted(want)


def test_a_long_text_of_links_and_tokens_takes_seconds(spark):
    line = "see https://host.example.com/a/b and Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1 then login: someone9 "
    text = line * (5_000_000 // len(line))
    began = time.time()
    base = op09_secrets.base_spans(text)
    assert len(op09_secrets.linked(text, base)) > 100_000
    assert time.time() - began < 30
    began = time.time()
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert "Ab1" not in op09_secrets.redact(df).first().text
    assert time.time() - began < 60


def test_bands_miss_no_pair_at_the_threshold():
    """Sets that share exactly three quarters of their union meet in a band."""
    from parcelmill.llm import op08_setsketch as S

    rng = np.random.default_rng(5)
    for size, inter, n in ((7, 6, 1500), (70, 60, 1500), (700, 600, 200)):
        for _ in range(n):
            both = rng.integers(0, 1 << 63, 2 * size - inter, dtype=np.uint64)
            a, b = (S.registers(x).reshape(-1, S.ROWS) for x in (both[:size], both[size - inter :]))
            assert (a == b).all(axis=1).any()
