import brute

from parcelmill.llm import op03_toxicity, op09_secrets


def test_stages(spark, docs, labels, items, rows, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, str(tmp_path))
    scored = op03_toxicity.classify(docs, labels)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored.where("predicted = 0").collect()}
    unique = stage["near_duplicates"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in unique.collect()} == {d for d, _, _, kept in brute.near(rows) if kept}
    free = stage["decontamination"](spark, docs, str(tmp_path))
    pairs = [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]
    assert {r.doc_id for r in free.collect()} == {x[0] for x in brute.contaminated(rows, pairs) if not x[-1]}
    hidden = stage["secrets"](spark, docs, str(tmp_path))
    assert hidden.count() == len(rows) and all(not op09_secrets.base_spans(r.text or "") for r in hidden.collect())
    for name in ("toxicity", "near_duplicates", "decontamination", "secrets"):
        assert stage[name](spark, docs, str(tmp_path)).columns == docs.columns


NAMES = ["id", "score", "key", "row_key", "chosen_id", "chosen_key", "kept", "contaminated", "n_words", "component_id", "first_key", "n_shingles", "run", "length", "place"]


def tables(folder, labels, items):
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_on_an_empty_table(spark, empty, labels, items, tmp_path):
    import corpus_pipeline

    folder = tables(tmp_path, labels, items)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_stages_on_an_awkward_table(spark, labels, items, tmp_path):
    """Clashing names, null and repeated ids, rows of one id with a clean and a bad text."""
    from pyspark.sql import functions as F

    import corpus_pipeline

    folder = tables(tmp_path, labels, items)
    bad = "the quick brown fox jumps over the lazy dog again and again until it rests at last"
    own = lambda p: " ".join(f"{p}{k}" for k in range(40))
    rows = [(None, bad), (None, own("a")), (None, None), (1, bad), (1, own("b")), (2, own("c")), (2, own("c")), (3, own("c") + " more"), (4, ""), (4, ""), (5, own("d") * 400)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit("x") for n in NAMES})
    stage = dict(corpus_pipeline.STAGES)

    def left(name):
        out = stage[name](spark, docs, folder)
        assert out.columns == docs.columns and out.where("score <> 'x' or id <> 'x'").isEmpty()
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    clean = sorted([r for r in rows if r[1] != bad], key=str)
    assert left("toxicity") == sorted(rows, key=str) == left("secrets")
    assert left("decontamination") == clean
    # The two rows of the benchmark passage are copies, of which the one with an id stays; of 2, 2 and 3 one stays.
    assert left("near_duplicates") == sorted([(None, own("a")), (None, None), (1, bad), (1, own("b")), (2, own("c")), (4, ""), (4, ""), (5, own("d") * 400)], key=str)
    assert stage["packing"](spark, docs, folder).select("doc_id").distinct().count() == 6


def test_run(spark, docs, labels, items, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert out and max(ends.values()) <= 4096
