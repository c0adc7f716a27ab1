"""Benchmark decontamination by winnowing, in DataFrame operations only.

An item's window is ``width`` consecutive words (an item of fewer, but some, words is one window
of its own length).  A document's word is hit if it lies in any occurrence of a window.

* *Fingerprints.*  Of every ``width - gram + 1`` consecutive hashes of ``gram`` words the least is kept,
  on both sides.  Two texts that share ``width`` words share that window's least hash, so
  each shared span of ``width`` words leaves a common fingerprint.  Windows of short items are looked
  for by grams of their own length, all of which are kept.
* *Join.*  The distinct fingerprints of the benchmark are joined to those of the documents by a semi
  join, which can't multiply rows.  They are broadcast only if their count is at most
  ``broadcast_rows``; otherwise both sides are shuffled by fingerprint and salt: a document's salt comes
  from its key and the benchmark's few rows stand under every salt, so a hot fingerprint is spread over ``SALTS`` tasks.
* *Extension.*  All windows of each hit's run are spelled out and joined, as text, with the
  benchmark's distinct windows.
* A window leads to the sorted set of its items; equal sets are one row, so a passage shared by
  many items costs a document one row and not one for each item and window.

Edge cases: null texts have no words; repeated rows of one doc_id with the same text get equal
rows; rows that share a doc_id with other text are told apart by the text; items that repeat
count by their distinct item_id, null ids not at all; an empty benchmark hits nothing; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, with_key

WIDTH = 10
GRAM = 5
BROADCAST_ROWS = 100_000
SALTS = 32
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased words (A-Z only); the plain lower() is right, and faster, for ASCII."""
    small = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(small, GAPS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def upto(n: Column) -> Column:
    """1 .. n, none if n is under 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def gram_hashes(h: Column, n: int) -> Column:
    """Hash of the n words from each place, from the words' hashes."""
    return F.transform(upto(F.size(h) - (n - 1)), lambda i: F.xxhash64(*(F.get(h, i + (k - 1)) for k in range(n))))


def fingerprints(h: Column, gram: int, spread: int) -> Column:
    """(hash, first and last place of the windows it is least in) by runs of windows with one least hash, from the words' hashes.
    A run is longer than ``spread`` where its gram comes again within ``spread`` words."""

    def least(g: Column) -> Column:
        if spread == 1:
            return g
        return F.transform(upto(F.size(g) - (spread - 1)), lambda i: F.least(*(F.get(g, i + (k - 1)) for k in range(spread))))

    def runs(m: Column) -> Column:
        new = F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (F.get(m, i - 1) != x), i + 1)), lambda p: p.isNotNull())
        return let(new, lambda r: F.transform(r, lambda p, i: F.struct(F.get(m, p - 1).alias("hash"), p.alias("place"), F.coalesce(F.get(r, i + 1) - 1, F.size(m)).alias("last"))))

    return let(gram_hashes(h, gram), lambda g: let(least(g), runs))


def spelled(w: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(w, start, n), " ")


def among(rows: DataFrame, known: DataFrame, columns: list[str], few: bool) -> DataFrame:
    """Rows whose ``columns`` are in ``known``: by broadcast, or by columns and salt."""
    if few:
        return rows.join(F.broadcast(known), columns, "left_semi")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("row_key", F.lit(SALTS)).cast("int")).join(salted, [*columns, "salt"], "left_semi").drop("salt")


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """Distinct windows with the sorted set of their items' ids (as text)."""
    w = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(width), F.size("w"))
    each = w.select("item", n.alias("n"), F.explode(let(F.struct("w", n.alias("n")), lambda s: F.transform(upto(F.size(s["w"]) - s["n"] + 1), lambda i: F.array_join(F.slice(s["w"], i, s["n"]), " ")))).alias("window"))
    return each.groupBy("window", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))


def find(docs: DataFrame, items: DataFrame, width: int = WIDTH, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: words, hit words, the items found and their digest."""
    return judged(docs, items, width, gram, broadcast_rows).drop("row_key")


def judged(docs: DataFrame, items: DataFrame, width: int = WIDTH, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``find`` with the ``row_key`` that tells rows of one doc_id apart."""
    windows = cut(windows_of(items, width))
    sizes = [r.n for r in windows.select("n").distinct().orderBy("n").collect()]  # at most ``width`` numbers

    def marks(h: Column, n: int) -> Column:
        """An item size's fingerprints: of the full size by winnowing, of a smaller one all grams of that size."""
        found = fingerprints(h, *((gram, width - gram + 1) if n == width else (n, 1)))
        return F.transform(found, lambda x: F.struct(F.lit(n).alias("n"), x["hash"].alias("hash"), x["place"].alias("place"), x["last"].alias("last")))

    docs = with_key(docs)
    own = [windows.where(F.col("n") == n).select(F.inline(marks(word_hashes(F.split("window", " ")), n))) for n in sizes]
    zero = windows.sparkSession.range(1).select(F.lit(0).alias("n"), F.lit(0).cast("long").alias("hash"))  # that of the mark of the document itself
    known = reduce(DataFrame.unionByName, (x.select("n", "hash") for x in own), zero).distinct()
    few = known.limit(broadcast_rows + 1).count() <= broadcast_rows
    # One reading of the documents: the words are split once, and give the document's own mark, with their number, and those of all sizes.
    mark = lambda h: F.concat(F.array(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("hash"), F.size(h).alias("place"), F.lit(0).alias("last"))), *(marks(h, n) for n in sizes))
    found = docs.select("row_key", "doc_id", F.inline(let(word_hashes(words(F.col("text"))), mark)))
    found = cut(among(found, known, ["n", "hash"], few).select("row_key", "doc_id", "n", "place", "last"))
    base = found.where("n = 0").select("doc_id", "row_key", F.col("place").cast("long").alias("n_words"))
    at = cut(found.where("n > 0").groupBy(F.col("row_key").alias("key"), F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("n", "place", "last")).alias("runs")))
    # Words of the documents with a hit only; their places are bounded by their length.
    near = at.limit(broadcast_rows + 1).count() <= broadcast_rows
    same = (F.col("row_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))
    hit_docs = docs.join(F.broadcast(at) if near else at, same).select("row_key", "doc_id", "runs", words(F.col("text")).alias("w"))
    # All windows of a run share its least hash; a size's runs do not overlap.
    starts = F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["place"], r["last"]), lambda i: F.struct(r["n"].alias("n"), i.alias("start")))))
    texts = let(F.struct("w", starts.alias("s")), lambda x: F.transform(F.filter(x["s"], lambda i: i["start"] + (i["n"] - 1) <= F.size(x["w"])), lambda i: F.struct(i["n"].alias("n"), i["start"].alias("start"), spelled(x["w"], i["start"], i["n"]).alias("window"))))
    spread_out = hit_docs.select("row_key", "doc_id", F.inline(texts))
    target = windows.select("n", "window")
    hits = among(spread_out, target, ["n", "window"], few and target.limit(broadcast_rows + 1).count() <= broadcast_rows)
    return _summed(base, cut(hits.distinct()), windows, broadcast_rows)


def _summed(base: DataFrame, hits: DataFrame, windows: DataFrame, broadcast_rows: int) -> DataFrame:
    """Length of the union of a document's hit spans, and its distinct items."""
    spans = hits.groupBy("row_key", "doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e")))).alias("spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
    union = F.aggregate("spans", zero, lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["sum"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).cast("long").alias("sum")), lambda a: a["sum"])
    items = windows.select("window", "items")
    small = items.limit(broadcast_rows + 1).count() <= broadcast_rows
    sets = hits.select("row_key", "doc_id", "window").distinct().join(F.broadcast(items) if small else items, "window").select("row_key", "doc_id", "items").distinct()
    names = sets.groupBy("row_key", "doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    a = spans.select(F.col("row_key").alias("k1"), F.col("doc_id").alias("d1"), union.alias("n_hit"))
    b = names.select(F.col("row_key").alias("k2"), F.col("doc_id").alias("d2"), "items")
    joined = base.join(a, (F.col("row_key") == F.col("k1")) & F.col("doc_id").eqNullSafe(F.col("d1")), "left").join(b, (F.col("row_key") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("d2")), "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("row_key", "doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op7_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bn AS (
  SELECT item, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)
), sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (
  SELECT d.doc_id, d.n, d.i, win.item FROM dwin d JOIN win ON d.n = win.n AND d.s = win.s
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1
)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words_hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""
