"""A Merkle manifest of the documents: one tree for each source, one tree over the sources' roots.

A document's *leaf* is the hash of its columns, and each run of ``FANOUT`` consecutive nodes of a tree becomes
their hash, until one node is left.  So every node's place follows from its leaf's exact rank in its source.

* *Ranks without a global sort.*  ``ranked`` refines a histogram of key digits: a bucket of more than ``BUCKET`` rows is
  split by the next ``DIGITS`` digits after those that all its keys share, whatever their values, until no bucket is larger.  A bucket's
  offset is its parent's plus the counts of its earlier siblings (at most 16^DIGITS), and only within a bucket
  rows are numbered in order.  No source, however hot, meets in one task, and the sources are ranked the same way by their names' bytes.
* *Trie.*  The digits of a rank in base ``FANOUT`` are the way from the root to the leaf: a node's key is its
  leaves' common prefix, and dropping the last digit gives its parent.  The longest prefixes are reduced first.
* *Proofs.*  Going down again, each run hands the siblings of all levels above to its nodes once, so a leaf's
  proof is made from its own run and its parent's.

``folded_root`` is worked out from a leaf, or its tampered version, and its siblings alone; it is the root only if the text is as it was.

Edge cases: a null column is ``-``; documents without a source form the first tree; a null doc_id comes first in its
source; rows of one doc_id are ordered by their leaves; repeated rows are leaves of their own, next to each other, and which of them
comes first makes no difference to any hash but to the siblings, which are equal too but for their number on each side; a lone leaf is its
source's root; a single source's root is the root; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, small, table

FANOUT = 16
DIGITS = 3
BUCKET = 512
#: Buckets (some 100 bytes each) that are broadcast at most; more meet their rows by a shuffle.
BUCKETS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**replaced: Column) -> Column:
    return hashed(*(encoded(replaced.get(c, F.col(c))) for c in FIELDS))


def digits_of(number: Column) -> Column:
    """Hexadecimal digits in the order of the numbers: null, negative, then the others."""
    number = number.cast("long")
    return F.coalesce(F.concat(F.when(number < 0, "1").otherwise("2"), F.lpad(F.hex(number), 16, "0")), F.lit("0"))


def ranked(rows: DataFrame, bucket: int = BUCKET, digits: int = DIGITS) -> DataFrame:
    """``rows`` (``tree``, ``key``, a string of hexadecimal digits, unique in its tree, and others) with ``rank`` from 0 in the order of the keys
    and ``n``, the rows of the tree.  ``rows`` are read several times, so cut them first."""
    names = rows.columns
    stats = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    level = cut(stats(rows, "tree").select("tree", F.lit("").alias("bucket"), F.lit(0).cast("long").alias("offset"), F.col("rows").alias("n"), "rows", "low", "high"), narrow=True)
    open_rows, done = rows.withColumn("bucket", F.lit("")), []
    out = []
    while True:
        heavy = F.col("rows") > bucket
        done.append(level.where(~heavy).select("tree", "bucket", "offset", "n"))
        more = level.where(heavy)
        # Digits that a bucket's keys share say nothing: the next ones are counted from the first that differs.
        differ = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(F.length("low"), F.length("high"))), lambda i: F.substring(F.col("low"), i, F.lit(1)) != F.substring(F.col("high"), i, F.lit(1))), True)
        more = cut(more.select(F.col("tree").alias("t"), F.col("bucket").alias("parent"), (differ + digits - 1).cast("int").alias("wide"), F.col("offset").alias("base"), "n"), narrow=True)
        out.append(open_rows.join(small(done[-1], BUCKETS), ["tree", "bucket"]))
        if more.isEmpty():
            break
        split = open_rows.join(small(more, BUCKETS), (F.col("tree") == F.col("t")) & (F.col("bucket") == F.col("parent")))
        split = split.withColumn("bucket", F.substring(F.col("key"), F.lit(1), F.col("wide")))
        found = stats(split, "tree", "parent", "bucket", "base", "n")
        before = F.sum("rows").over(Window.partitionBy("tree", "parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        level = cut(found.select("tree", "bucket", (F.col("base") + F.coalesce(before, F.lit(0))).alias("offset"), "n", "rows", "low", "high"))
        open_rows = split.select(*names, "bucket")
    within = F.row_number().over(Window.partitionBy("tree", "bucket").orderBy("key"))
    return reduce(DataFrame.unionByName, out).select(*names, (F.col("offset") + within - 1).alias("rank"), "n")


def runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """The runs of a level: their nodes in order, and the place of each run in the level above."""
    kids = [c for c in nodes.columns if c not in ("tree", "n")]
    up = F.floor(F.col("rank") / fanout).cast("long")
    return nodes.groupBy("tree", up.alias("up"), "n").agg(F.sort_array(F.collect_list(F.struct("rank", *(c for c in kids if c != "rank")))).alias("kids"))


def siblings(hashes: Column, i: Column) -> Column:
    """What stands left and right of place ``i`` of a run."""
    join = lambda x: F.array_join(x, "")
    return F.struct(join(F.slice(hashes, F.lit(1), i)).alias("before"), join(F.slice(hashes, i + 2, F.size(hashes))).alias("after"))


def grown(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, longest prefixes first, and the last node (``tree``, ``hash``) of each tree.  ``nodes``: tree, rank, n (nodes of
    the tree), hash, and others that the first level's runs keep."""
    levels, tops = [], []
    while True:
        tops.append(nodes.where("n = 1").select("tree", "hash"))
        level = cut(runs(nodes.where("n > 1"), fanout), narrow=bool(levels))
        if level.isEmpty():
            return levels, cut(reduce(DataFrame.unionByName, tops), narrow=True)
        levels.append(level)
        nodes = level.select("tree", F.col("up").alias("rank"), F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.sha2(F.array_join("kids.hash", "").cast("binary"), 256).alias("hash"))


def handed_down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """For each run of the first level (``tree``, ``up``) the siblings of all its levels above, ``way``, and what ``tops`` (tree, way
    and others) has.  Trees of one node have no run."""
    more = [c for c in tops.columns if c not in ("tree", "way")]
    way = None
    for level in reversed(levels):
        # A tree starts from its top at the level of its last run, n <= fanout.
        last = F.col("n") <= FANOUT
        start = level.where(last).select("tree", "up", "kids").join(tops, "tree")
        here = start if way is None else start.unionByName(level.where(~last).select("tree", "up", "kids").join(way, ["tree", "up"]))
        if level is levels[0]:
            return here
        each = here.select("tree", F.posexplode("kids.rank").alias("i", "rank"), F.col("kids.hash").alias("hashes"), "way", *more)
        way = each.select("tree", F.col("rank").alias("up"), F.concat(F.array(siblings(F.col("hashes"), F.col("i"))), F.col("way")).alias("way"), *more)
    raise ValueError("no level")


WAY = "array<struct<before:string,after:string>>"


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, its source's root, the root, the hash of its proof, and what its (tampered) text folds to."""
    spark = docs.sparkSession
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(text=F.translate("text", UPPER, LOWER)))
    # The sources' names as digits, so that order is that of their bytes; none comes first.
    tree = F.coalesce(F.concat(F.lit("1"), F.hex(F.col("source").cast("binary"))), F.lit("0"))
    leaves = docs.select("doc_id", tree.alias("tree"), leaf().alias("hash"), tampered.alias("changed"))
    leaves = cut(leaves.withColumn("row", F.monotonically_increasing_id()))  # the row's number stays what it was once written
    key = F.concat(digits_of(F.col("doc_id")), "hash", digits_of(F.col("row")))
    nodes = ranked(leaves.select("tree", key.alias("key"), "doc_id", "hash", "changed")).drop("key")
    nodes = cut(nodes)
    levels, tops = grown(nodes, FANOUT)
    over = cut(ranked(cut(tops.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "hash"), narrow=True)), narrow=True)
    above, root = grown(over.select("tree", "rank", "n", "hash", F.col("key").alias("of")), FANOUT)
    none = F.array().cast(WAY)
    root = F.broadcast(root.select("tree", none.alias("way"), F.col("hash").alias("root")))  # one row
    ways = over.where("n = 1").join(root, "tree").select(F.col("key").alias("tree"), "way", F.col("hash").alias("subroot"), "root")
    if above:
        each = handed_down(above, root).select(F.posexplode("kids").alias("i", "kid"), F.col("kids.hash").alias("hashes"), "way", "root")
        ways = ways.unionByName(each.select(F.col("kid.of").alias("tree"), F.concat(F.array(siblings(F.col("hashes"), F.col("i"))), F.col("way")).alias("way"), F.col("kid.hash").alias("subroot"), "root"))
    ways = small(cut(ways, narrow=True), BUCKETS // 100)
    lone = nodes.where("n = 1").select("tree", F.array(F.struct("rank", "doc_id", "hash", "changed")).alias("kids")).join(ways, "tree")
    found = lone.select("kids", "way", "subroot", "root", F.lit(True).alias("alone"))
    if levels:
        found = found.unionByName(handed_down(levels, ways).select("kids", "way", "subroot", "root", F.lit(False).alias("alone")))
    hashes = F.col("kids.hash")

    def judged(kid: Column, i: Column) -> Column:
        way = F.when(F.col("alone"), F.col("way")).otherwise(F.concat(F.array(siblings(hashes, i)), F.col("way")))
        proof = F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)
        folded = F.aggregate(way, F.coalesce(kid["changed"], kid["hash"]), lambda now, s: hashed(s["before"], now, s["after"]))
        return F.struct(kid["doc_id"].alias("doc_id"), kid["hash"].alias("leaf"), proof.alias("proof_sha256"), folded.alias("folded_root"))

    each = found.select("subroot", "root", F.inline(F.transform("kids", judged)))
    return each.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _sql(depth: int = 6) -> str:
    """The same in SQL, level by level, for up to ``FANOUT`` ^ ``depth`` documents of a source and as many sources."""
    enc = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    body = lambda text: "sha256(" + " || ".join(enc(text if c == "text" else c) for c in FIELDS) + ")"
    crc = """(xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
             lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295::BIGINT))"""

    def levels(name: str, tree: str, first: str) -> list[str]:
        out = [f"{name}0 AS ({first})"]
        for d in range(depth):
            run = f"PARTITION BY {tree}, k // {FANOUT} ORDER BY k ROWS BETWEEN"
            out.append(f"{name}s{d} AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{d})")
            out.append(f"{name}{d + 1} AS (SELECT {tree}, k // {FANOUT} AS k, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END AS h, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n FROM {name}{d} GROUP BY {tree}, k // {FANOUT})")
        return out

    def folds(name: str, level: str, tree: str, rank: str, first: str) -> list[str]:
        out = [f"{name}0 AS ({first})"]
        for d in range(depth):
            out.append(f"{name}{d + 1} AS (SELECT f.* REPLACE (proof || b || a AS proof, CASE WHEN s.n > 1 THEN sha256(b || folded || a) ELSE folded END AS folded) FROM {name}{d} f JOIN {level}s{d} s ON f.{tree} IS NOT DISTINCT FROM s.{tree} AND f.{rank} // {FANOUT**d} = s.k)")
        return out

    parts = [
        f"leaves AS (SELECT doc_id, source, {body('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {body(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents)",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        *levels("d", "source", "SELECT source, r AS k, leaf AS h, n FROM numbered"),
        f"subroots AS (SELECT 0 AS t, source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS r, h, count(*) OVER () AS n FROM d{depth})",
        *levels("s", "t", "SELECT t, r AS k, h, n FROM subroots"),
        *folds("f", "d", "source", "r", "SELECT doc_id, source, r, leaf, '' AS proof, coalesce(changed, leaf) AS folded FROM numbered"),
        *folds("g", "s", "t", "q", f"SELECT f.*, s.t, s.r AS q, s.h AS subroot FROM f{depth} f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source"),
    ]
    end = f"SELECT g.doc_id, g.leaf, g.subroot, s.h AS root, sha256(g.proof) AS proof_sha256, g.folded AS folded_root, g.folded = s.h AS verified FROM g{depth} g JOIN s{depth} s ON g.t = s.t"
    return "WITH " + ",\n".join(parts) + "\n" + end


SQL = _sql()
