"""Each operator against its plain version, and on awkward and empty tables."""

import hashlib
import math
from types import SimpleNamespace

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelmill.llm import op01_rules, op02_mixing, op03_toxicity, op04_substring, op05_suffix, op06_packing, op07_winnow, op08_setsketch, op09_secrets, op10_chat


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: (r[0] is not None, r))


def test_substring(docs, rows):
    assert got(op04_substring.remove(docs)) == sorted(brute.substring(rows))
    assert got(op04_substring.remove(docs, width=5)) == sorted(brute.substring(rows, 5))


def test_substring_with_a_full_sketch_loses_nothing(docs, rows):
    assert got(op04_substring.remove(docs, max_cells=1 << 16)) == sorted(brute.substring(rows))


def test_substring_counted_by_a_shuffle(docs, rows):
    assert got(op04_substring.remove(docs, max_cells=0)) == sorted(brute.substring(rows))
    assert got(op04_substring.remove(docs, width=5, max_cells=0)) == sorted(brute.substring(rows, 5))


def test_substring_repeated_rows(awkward, rows):
    out = op04_substring.remove(awkward)
    assert out.count() == len(rows) + 3
    twice = out.where("doc_id = 7").collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_removed == twice[0].n_words


def test_suffix(docs, rows):
    assert got(op05_suffix.remove(docs)) == sorted(brute.suffix(rows))
    assert got(op05_suffix.remove(docs, length=40)) == sorted(brute.suffix(rows, 40))


@pytest.mark.parametrize("more", [{"max_cells": 0}, {"hot": 2}, {"hot": 3, "max_cells": 0}])
def test_suffix_by_a_shuffle_and_by_hashed_strings(docs, rows, more):
    assert got(op05_suffix.remove(docs, **more)) == sorted(brute.suffix(rows))
    assert got(op05_suffix.remove(docs, length=40, **more)) == sorted(brute.suffix(rows, 40))


def test_suffix_of_few_lines_in_many_orders(spark):
    import random

    rng = random.Random(4)
    lines = [" ".join(f"l{rng.randrange(30)}x{k}" for _ in range(7)) + "\n" for k in range(6)]
    rows = [(d, "".join(rng.choices(lines, k=8)) + f"end {d}") for d in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = sorted(brute.suffix(rows))
    assert got(op05_suffix.remove(docs)) == want == got(op05_suffix.remove(docs, hot=4))


def test_suffix_repeated_rows(awkward, rows):
    out = op05_suffix.remove(awkward)
    assert out.count() == len(rows) + 3
    assert out.where("doc_id is null").count() == 2
    # The null id comes first, so the later twin goes.
    assert out.where("doc_id = 200").first().n_removed > 0


@given(st.binary(min_size=1, max_size=80).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_previous_factors(data, length):
    length = min(length, len(data))
    order, common = op05_suffix.suffix_order(np.frombuffer(data, np.uint8), length)
    n = len(data) - length + 1
    assert [data[i : i + length] for i in order] == sorted(data[i : i + length] for i in range(n))
    lpf = op05_suffix.previous_factors(order, common)
    for i in range(n):
        seen = any(data[j : j + length] == data[i : i + length] for j in range(i))
        assert (lpf[i] >= length) == seen


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    import zlib

    out = op06_packing.pack(docs, path, 512).collect()
    want = {(i, k // 512): (k, len(x[k : k + 512]), zlib.crc32(x[k : k + 512].tobytes())) for i, x in ids.items() for k in range(0, len(x), 512)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 512
    assert len(ends) <= math.ceil(sum(r.length for r in out) / 512) + 2


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=30))
@settings(max_examples=80, deadline=None)
def test_matching_places_each_piece_once(counts):
    lengths = np.array(sorted(counts, reverse=True))
    runs = op06_packing.match(lengths, np.array([counts[n] for n in lengths]), 64)
    places, ranks = {}, {}
    for length, rank, n, seq, offset, copies in runs.tolist():
        ranks.setdefault(length, []).append((rank, rank + n * copies))
        for k in range(n):
            for c in range(copies):
                places.setdefault(seq + k, []).append((offset + c * length, length))
    for length, spans in ranks.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == counts[length] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for spans in places.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0 and sum(spans[-1]) <= 64
    gaps = []  # plain best-fit decreasing
    for n in sorted((k for k, m in counts.items() for _ in range(m)), reverse=True):
        best = min((g for g in gaps if g >= n), default=None)
        if best is not None:
            gaps.remove(best)
        gaps.append((best or 64) - n)
    assert len(places) <= 1.15 * len(gaps) + 2


def test_winnowing(docs, items, rows):
    pairs = [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]
    want = sorted(brute.contaminated(rows, pairs))
    assert got(op07_winnow.find(docs, items)) == want
    assert got(op07_winnow.find(docs, items, broadcast_rows=0)) == want
    none = op07_winnow.find(docs, items.where("item_id < 0"))
    assert none.where("contaminated or n_items > 0").isEmpty() and none.count() == len(rows)


def test_winnowing_of_repeated_words(spark):
    """Grams that come again within a window: repeated words, stutters and one-word items."""
    import random

    rng = random.Random(8)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    pairs = [(1, " ".join(["ha"] * 10)), (2, "yes"), (3, passage), (4, "no no no"), (5, "a b a b a b a b a b a b")]
    pairs += [(k, " ".join(rng.choices("ab", k=12))) for k in range(6, 12)]
    stutter = " ".join((passage.split()[:5]) * 3)
    rows = [(1, " ".join(["ha"] * 50)), (2, "yes yes yes yes yes"), (3, f"{stutter} {passage} {stutter}"), (4, "no " * 20), (5, "a b " * 30), (6, None), (7, "ha " * 9)]
    rows += [(k, " ".join(rng.choices("ab", k=300))) for k in range(8, 20)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(pairs, "item_id long, text string")
    want = sorted(brute.contaminated(rows, pairs))
    assert [r[2] for r in want[:2]] == [50, 5]
    assert got(op07_winnow.find(docs, items)) == want
    assert got(op07_winnow.find(docs, items, broadcast_rows=0)) == want


def test_near_duplicates(docs, rows):
    assert got(op08_setsketch.near_duplicates(docs)) == sorted(brute.near(rows))


def test_near_duplicates_in_a_noisy_group(spark):
    """Many variants of one text, some linked only through others."""
    import random

    rng = random.Random(3)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(12 if i % 3 else 10**6)}"
        rows.append((i, " ".join(w)))
    out = op08_setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out) == sorted(brute.near(rows))


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 800).astype(np.uint64) for _ in range(2))
    both = np.concatenate([a[:600], b[:200]])
    ra, rb = op08_setsketch.registers(a), op08_setsketch.registers(both)
    union = op08_setsketch.registers(np.union1d(a, both))
    assert (np.maximum(ra, rb) == union).all()
    (found,) = op08_setsketch.joint_estimates(ra[None], rb[None], np.array([800.0]), np.array([800.0]))
    assert abs(found - 0.6) < 0.15


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    """Rows of one doc_id with several texts, and rows without an id, are linked by their own texts."""
    a, b = ([f"{p}{k}" for k in range(60)] for p in "qr")
    near = lambda w, k: " ".join(w[:k] + ["changed"] + w[k + 1 :])
    rows = [(1, "aaa " + " ".join(a)), (1, " ".join(b)), (5, near(b, 30)), (7, near(a, 3)), (None, " ".join(f"s{k}" for k in range(60))), (None, near([f"s{k}" for k in range(60)], 9)), (None, near(b, 57)), (9, None), (None, "")]
    out = op08_setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in out.collect()), key=str)
    assert found == sorted([(1, 1, True), (1, 1, True), (5, 1, False), (7, 1, False), (None, None, True), (None, None, True), (None, 1, False), (9, 9, True), (None, None, True)], key=str)


SECRET_PARTS = st.sampled_from(["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "api__key", '"', "'", " ", "  ", "\n", ":", "=", "abcdef", "abc", "x+/=_.-", "AKIA", "AKIA" + "Q" * 16, "A1B2", "0123456789abcdef", "f" * 24, "f" * 23, "é", "ſ", "K", "-"])


@given(st.lists(SECRET_PARTS, max_size=14).map("".join))
@settings(max_examples=1500, deadline=None)
def test_base_spans(text):
    assert sorted(op09_secrets.base_spans(text)) == sorted(brute.secrets(text))


def test_secrets(docs, rows):
    for r in op09_secrets.scan(docs).collect():
        text = dict(rows)[r.doc_id] or ""
        base = brute.secrets(text)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, _, k in base) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(op09_secrets.joined(base).encode()).hexdigest()
        assert set(op09_secrets.joined(base).split(",")) <= set(r.spans.split(",")) | {""}
    known = next(t for _, t in rows if t and "login: admin7" in t)
    kinds = {k for _, _, k in op09_secrets.base_spans(known) + op09_secrets.linked(known, op09_secrets.base_spans(known))}
    assert kinds == {"assign", "access", "secret", "ident", "endpoint"}
    beside = "see https://vault.example.com/x and " + "Ab1" * 13 + "Z"
    assert [k for _, _, k in op09_secrets.linked(beside, op09_secrets.base_spans(beside))] == ["secret", "endpoint"]
    for alone in ("Ab1" * 13 + "Z", "see https://vault.example.com/x and " + "Abcd" * 10, "see https://vault.example.com/" + "Ab1" * 13, f"https://vault.example.com/x{' ' * 300}" + "Ab1" * 13):
        assert op09_secrets.linked(alone, op09_secrets.base_spans(alone)) == []
    assert op09_secrets.base_spans("secret=token:abcdefg") == []
    assert op09_secrets.base_spans("ſecret=abcdefg") == []


def test_secret_scopes_end_at_blank_lines():
    near = "login: admin7 \n password=abcdefgh"
    far = "login: admin7 \n\n password=abcdefgh"
    assert [k for _, _, k in op09_secrets.linked(near, op09_secrets.base_spans(near))] == ["ident"]
    assert op09_secrets.linked(far, op09_secrets.base_spans(far)) == []


@pytest.mark.parametrize("key", ["Ab1" * 10 + "Zz", "Ab1Z" * 16, "Ab1Z" * 10 + "Ab==", "Ab_1-Z" * 7, "Ab1Z" * 5, "Ab1Z" * 10])
def test_weak_secrets_of_other_lengths_and_letters(key):
    text = f"client_id: app77 https://api.example.com/v1 {key} end"
    spans = op09_secrets.linked(text, op09_secrets.base_spans(text))
    assert [text[s:e] for s, e, k in spans if k == "secret"] == [key]
    assert {k for _, _, k in spans} == {"secret", "ident", "endpoint"}


def test_a_part_is_not_its_own_complement():
    for text in (f"login: {'long-user-name-' * 6}", f"key AKIA{'Q' * 16}", "user: bob\n" + "-" * 40, "login: bob " + "Ab1" * 6):
        assert op09_secrets.linked(text, op09_secrets.base_spans(text)) == []
    name = "x" * 90
    text = f"login: {name} " + "Ab1Z" * 8
    assert [text[s:e] for s, e, k in op09_secrets.linked(text, op09_secrets.base_spans(text)) if k == "ident"] == [f"login: {name}"]


def test_redaction(docs):
    out = {r.doc_id: r for r in op09_secrets.redact(docs).collect()}
    assert out[0].text is None and out[18].text.count("[REDACTED]") >= 3 and "hunter2" not in out[18].text
    assert out[18].n_chars == len(out[18].text)


def test_rules(docs, labels, rows):
    out = op01_rules.judge(docs, labels)
    texts = dict(rows)
    for r in out.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rules_base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert out.where("kept").count() > 50
    nothing = op01_rules.judge(docs, labels.where("doc_id < 0"))
    assert nothing.where("kept = base_failed").isEmpty()


def test_rules_learn_thresholds(spark):
    from pyspark.sql import functions as F

    d = spark.range(3000).select("id", *(F.lit(100).alias(c) for c in ("n_words", "word_chars", "n_distinct", "n_lines")), *(F.lit(0).alias(c) for c in ("n_repeat_words", "n_dup_lines", "n_digits", "n_marks")), (F.col("id") % 50).alias("n_symbols"), (F.col("id") % 7).alias("n_upper"))
    d = d.withColumn("bad", ((F.col("n_symbols") > 30) & (F.col("n_upper") > 3)).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(3)))
    rules = op01_rules.learn(d.cache())
    wrong = d.where(op01_rules.verdict(rules) == (F.col("bad") == 1)).count()
    assert rules and wrong < 30


def test_toxicity(docs, labels, rows):
    out = op03_toxicity.classify(docs, labels).collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    flagged = {r.doc_id for r in out if r.predicted}
    toxic = {i for i, t in texts.items() if t and "vile" in t}
    assert len(flagged & toxic) >= 0.8 * len(toxic) and len(flagged - toxic) <= 2
    plain = op03_toxicity.classify(docs, labels.where("doc_id < 0"))
    assert plain.where("predicted = 1").isEmpty()


def test_rotation(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (2, 0, None, None), (3, 0, "system", "alone"), (None, None, "", "x")]
    out = op10_chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sum(r.conv_id == 1 for r in out) == 8 and not any(r.conv_id == 3 for r in out)
    own = [r for r in out if r.conv_id == 1 and r.perspective == "bob"]
    assert sorted((r.turn, r.role, r.train) for r in own) == [(0, "system", False), (1, "user", False), (2, "assistant", True), (2, "assistant", True)]
    for r in out:
        assert (r.mask_start is not None) == r.train
        if r.train:
            assert r.segment[r.mask_start : r.mask_end] in ("hi < |end|>", "yo", "", "x")
    assert next(r for r in own if r.turn == 1).segment == "<|user|>\nann: hi < |end|><|end|>\n"


def test_rotation_on_awkward_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert op10_chat.rotate(spark.createDataFrame([], schema)).count() == 0
    turns = [(1, 1, "<|system|>", "hello"), (1, 2, "bob", "x" * 200_000), (1, 2, "bob", "again"), (None, 1, "ann", None), (None, 1, "ann", None)]
    names = ["of", "perspective", "speaker", "content", "head", "train", "segment", "mask_start"]
    from pyspark.sql import functions as F

    out = op10_chat.rotate(spark.createDataFrame(turns, schema).withColumns({n: F.lit("x") for n in names}))
    rows = out.orderBy("conv_id", "perspective", "turn", "speaker", "segment").collect()
    assert len(rows) == 8 and rows[0].segment == rows[1].segment == "<|assistant|>\n<|end|>\n" and rows[0].mask_start == rows[0].mask_end
    assert [r.segment for r in rows if r.perspective == "bob" and r.role == "user"] == ["<|user|>\n< |system|>: hello<|end|>\n"]
    assert all(r.segment.count("<|") == 2 for r in rows)


OPERATORS = {
    "rules": lambda d, labels, items: op01_rules.judge(d, labels),
    "mixing": lambda d, labels, items: op02_mixing.score(d),
    "toxicity": lambda d, labels, items: op03_toxicity.classify(d, labels),
    "substring": lambda d, labels, items: op04_substring.remove(d),
    "suffix": lambda d, labels, items: op05_suffix.remove(d),
    "packing": lambda d, labels, items: op06_packing.pack(d, op06_packing.public_vocabulary("word_bpe_49k.json")),
    "winnowing": lambda d, labels, items: op07_winnow.find(d, items),
    "near": lambda d, labels, items: op08_setsketch.near_duplicates(d),
    "secrets": lambda d, labels, items: op09_secrets.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty, labels, items):
    assert OPERATORS[name](empty, labels, items).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_table(name, awkward, rows, labels, items):
    out = OPERATORS[name](awkward, labels, items)
    assert out.select("doc_id").count() >= len(rows) + 3
    assert out.where("doc_id is null").count() == 2


LETTERS = st.sampled_from([*"abzAZ.,;'-_<|># \n\t\x00é0", "İ", "ß", "ﬁ", "ſ", "̇", "Σ", "中", "🙂", "‍", " ", "ǅ", "क", "ि"])


@given(st.lists(LETTERS, max_size=14).map("".join))
@settings(max_examples=1500, deadline=None)
def test_chunks_have_the_tokenisers_ids(text):
    encoder = op06_packing.encoder_of(op06_packing.public_vocabulary("word_bpe_49k.json"))
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["İ.", "İ,", "aİ.", "ß.", "Σ,", "a.", "a..,", ".", "..."])
def test_trailing_signs(text):
    encoder = op06_packing.encoder_of(op06_packing.public_vocabulary("word_bpe_49k.json"))
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.characters(min_codepoint=0x20, max_codepoint=0x52F) | st.sampled_from("'<|,. 0aé"), max_size=20).map("".join))
@settings(max_examples=1500, deadline=None)
def test_runs_have_the_tokenisers_ids(text):
    encoder = op06_packing.encoder_of(op06_packing.public_vocabulary("word_bpe_49k.json"))
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_new_words_need_the_model_only():
    """Most of the time goes into words not met before: those of letters, digits and signs take no turn through the whole tokeniser."""
    encoder = op06_packing.Encoder(op06_packing.public_vocabulary("word_bpe_49k.json"))
    whole, seen = encoder.tokenizer, []
    encoder.tokenizer = SimpleNamespace(encode=lambda chunk, **more: seen.append(chunk) or whole.encode(chunk, **more))
    text = "Chunks, ÉTIONELLE.%%% straße's (2024-01-31) it's İ. ΣΑΣ Ёлка\ne\u0301t ... <|endoftext|> a|b"
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert seen == ["straße's", "it's", "İ.", "e\u0301t", "<|endoftext|>"]


ROW_LOCAL = {
    "rules": ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "winnowing": ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"),
    "secrets": ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"),
    "toxicity": ("doc_id", "held_out"),
}


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_awkward_rows_have_their_own_values(name, docs, awkward, rows, labels, items):
    """Repeats, null ids and clashing columns change nothing for the other rows, and repeats are alike."""
    columns = ROW_LOCAL[name]
    plain = got(OPERATORS[name](docs, labels, items), *columns)
    out = got(OPERATORS[name](awkward, labels, items), *columns)
    assert sorted({r for r in out if r[0] is not None}) == sorted(set(plain))
    assert sum(r[0] == 7 for r in out) == 2 and len([r for r in out if r[0] is None]) == 2


def test_near_duplicates_of_an_awkward_table(awkward, rows):
    out = {(r.doc_id, r.component_id) for r in op08_setsketch.near_duplicates(awkward).collect()}
    want = {(d, c) for d, _, c, _ in brute.near([*rows, (7, dict(rows)[7])])}
    assert {x for x in out if x[0] is not None} == want
    assert {c for d, c in out if d is None} == {None, 200}  # a copy of 200's text, and one without text
