import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["é" + str(k) for k in range(40)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, base = prose(60), prose(120)
    near = base.split()
    near[50] = "changed"
    item = "The Quick brown fox jumps over the lazy dog again and again until it rests at last"
    texts = [None, "", " \t\n", "one", "Two words", prose(30), base, base, base.upper(), " ".join(near), prose(80) + " " + shared + " " + prose(50), shared + "\n" + prose(90)]
    texts += ["a " * 3000, "x" * 30_000, "same line\n" * 40, prose(20) + " " + item.lower() + " " + prose(20), item, "dog again and again until"]
    texts += [f"login: admin7\npassword = \"hunter2hunter2\" AKIA{'Q' * 16}\nhttps://vault.example.com/x " + "Ab1" * 13 + "Z", "no secrets: token=abc AKIA12 deadbeef", prose(4000), "ÀÉ ß ſecret: abcdefgh \x00   z"]
    texts += [f"{prose(12)} vile{k % 3} {prose(10)} vile{(k + 1) % 3}" for k in range(24)] + [prose(25) for _ in range(60)]
    return texts


@pytest.fixture(scope="session")
def rows():
    out = [(k, t) for k, t in enumerate(_texts())]
    return out + [(200, "left over text with a twin " * 6)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def items(spark):
    text = "the quick brown fox jumps over the lazy dog again and again until it rests at last"
    return spark.createDataFrame([(1, text), (2, text), (3, "Dog again AND again"), (4, None), (5, ""), (None, text), (6, "never seen words here at all in any of those documents")], "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark, rows):
    toxic = {i for i, t in rows if t and "vile" in t}
    data = [(i, int(len((t or "").split()) > 10 and "same line" not in t), int(i in toxic)) for i, t in rows]
    return spark.createDataFrame(data + [(None, None, None), (9999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def awkward(spark, docs):
    """Repeated rows, a null id, extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    more = spark.createDataFrame([(7, docs.where("doc_id = 7").first().text, "en", "s", 1), (None, "left over text with a twin " * 6, None, None, None), (None, None, None, None, None)], SCHEMA)
    both = docs.unionByName(more)
    names = ["row_key", "key", "id", "place", "single", "free", "rep", "word", "score", "n_words", "kept", "spans", "band", "length", "part", "quality", "toxic", "bad", "window", "hash"]
    return both.withColumns({n: F.lit("x") for n in names})
