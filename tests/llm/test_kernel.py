"""The numpy kernels and the sketch against plain loops."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelmill.llm import kernel as K
from parcelmill.llm import op02_mixing as M
from parcelmill.llm import sketch

texts = st.lists(st.text(st.sampled_from("ab é\n\t"), max_size=30), min_size=1, max_size=8)


@given(texts)
@settings(deadline=None)
def test_words(rows):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(rows)})
    found = []
    for _, data, offsets in K.blocks(batch, limit=20):
        w = K.Words(data, offsets)
        raw = data.tobytes()
        for d in range(len(offsets) - 1):
            found.append([raw[w.start[i] : w.end[i]] for i in range(w.first[d], w.first[d + 1])])
    assert found == [t.encode().split() for t in rows]


@given(texts, st.integers(1, 4))
@settings(deadline=None)
def test_equal_windows_have_equal_hashes(rows, k):
    data = np.frombuffer(" ".join(rows).encode(), np.uint8)
    w = K.Words(data, np.array([0, len(data)]))
    h = K.group_hashes(w.hashes(data), k, 0)
    words = data.tobytes().split()
    windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    assert len(h) == len(windows)
    assert len(set(h.tolist())) == len(set(windows))


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding(values, w):
    x = np.array(values, np.uint64)
    assert K.sliding_min(x, w).tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]
    assert K.sliding_max(x, w).tolist() == [max(values[i : i + w]) for i in range(len(values) - w + 1)]


@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(1, 8))
def test_minimizers_hit_every_run(values, w):
    x = np.array(values, np.uint64)
    least, fits, chosen = K.minimizers(x, w, np.arange(len(x), 0, -1))
    assert fits.all() and len(least) == max(0, len(x) - w + 1)
    for i in range(len(least)):
        assert (chosen[i : i + w] & (x[i : i + w] == least[i])).any()


@given(st.lists(st.integers(0, 20), max_size=20), st.integers(1, 6), st.integers(1, 30))
def test_covered(starts, width, n):
    starts = np.array([s for s in starts if s < n], np.int64)
    want = [any(s <= i < s + width for s in starts) for i in range(n)]
    assert K.covered(starts, width, n).tolist() == want


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    times = np.where(np.arange(5000) < 50, 40, 1)
    docs = spark.createDataFrame([(str(k),) for k in range(8)], "text string").repartition(4)
    shares = np.array_split(rng.permutation(np.repeat(keys, times)), 8)

    def hashes(batch):
        for t in batch.column("text").to_pylist():
            yield shares[int(t)]

    for rows in (1, 2):
        made = sketch.build(docs, hashes, 16, rows)
        level = made.level(keys)
        assert (level >= np.frexp(times.astype(float))[1]).all()
        assert (level[50:] == 1).mean() > 0.8
        assert (made.level(rng.integers(0, 2**64, 2000, dtype=np.uint64)) == 0).mean() > 0.8


def test_counts_in_a_byte():
    x = np.array([0, 1, 31, 32, 33, 1000, 1e6, 1e9])
    back = M.DECODE[M._narrow(x)]
    assert (back[:4] == x[:4]).all() and (np.abs(back - x) <= 0.05 * x).all()


def test_tasks_let_go_of_other_caches():
    K.worker_caches.update(own=1, other=2)
    assert list(K.task(lambda it: iter(it), "own")([3])) == [3] and K.worker_caches == {"own": 1}
    assert list(K.task(lambda it: iter(it))([])) == [] and not K.worker_caches


def test_memo_is_bounded(monkeypatch):
    from parcelmill.llm import op06_packing

    monkeypatch.setattr(op06_packing, "MEMO_BYTES", 40_000)
    encoder = op06_packing.Encoder(op06_packing.public_vocabulary("word_bpe_49k.json"))
    text = " ".join(f"chunk{k}" for k in range(2000))
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.size < 41_000 and len(encoder) < 220
