"""Near-duplicate detection with SetSketch registers.

A document's set holds its distinct shingles of five words; two documents are linked if the Jaccard
similarity of their full sets is 75 % or more.

1. Equal sets are one *class*, called by its smallest doc_id; copies are never paired.
2. *Registers.*  Register i of a set is the truncated value floor(1 - log_b(x_i)), where x_i is the least of
   exponential variables that its elements hash to.  Registers of a union are the larger of each
   pair, so sketches merge; equal sets have equal registers, and similar sets share many.
3. *Bands.*  ``BANDS`` bands of ``ROWS`` registers; a pair at 75 % shares none with probability
   (1 - .75^4)^32, about 5 in a million, more similar pairs far less.
4. *Joint estimate.*  For each candidate pair the counts of larger, smaller and equal registers give
   the likelihood of the similarity, given both sizes; pairs whose maximum is far below the threshold (by
   ``SLACK``, ten standard deviations of a pair at the threshold) go no further.  This needs 256 bytes a class; texts are moved
   for the others only.
5. *Verification.*  They are compared on their full sets, read from their texts.

Within a bucket of a band nothing is paired with all: first each class meets only the smallest class (the
head) of its buckets, a star, and links make components.  What a bucket then still holds outside
its head's component is compared by its *delta* to the head, the shingles not shared with it, which also settles each link to a
head exactly.  Two sets
differ by at least both deltas less what the deltas can share, and tokens that no other delta of the head has can't
be shared.  This exact bound leaves the pairs that may still be linked, which are verified on their texts.
No partner is capped.

Edge cases: null and empty texts, and texts without words, have an empty set, are linked with nothing
and stay; texts of fewer than five words are one shingle; repeated rows are one class; where rows of one
doc_id have several texts, each belongs to its own text's class and is compared by that text; rows with a null
doc_id are linked like others, and a component of nothing else has a null component_id and is kept; an empty table gives an
empty result; other columns are ignored.
Shingles are compared by 64-bit hash, classes by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import BROADCAST_BYTES, cut, small, table, with_key

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 2
SLACK = 0.4
_rng = np.random.default_rng(20240731)
_MUL = _rng.integers(1, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each document of a block, sorted, and where each set begins."""
    data = K.LOWER[data]
    words = K.Words(data, offsets)
    hashes = words.hashes(data)
    grams = K.group_hashes(hashes, SHINGLE, 0)
    at = np.flatnonzero(words.last[: len(grams)] - np.arange(len(grams)) >= SHINGLE)
    doc = np.searchsorted(words.first, at, "right") - 1
    value = grams[at]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        roll = K._ROLL[3]
        whole = roll.spans(roll.prefix(hashes), words.first[short], words.first[short + 1])
        whole = K.mix(whole + words.count[short].astype(K.U))
        doc, value = np.concatenate([doc, short]), np.concatenate([value, whole])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(offsets)))


def registers(value: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes."""
    low, high = value.astype(np.uint32), (value >> K.U(32)).astype(np.uint32)
    most = np.zeros(REGISTERS, np.uint32)
    for k in range(0, len(value), 2048):
        x = low[k : k + 2048, None] * _MUL + _ADD
        x ^= high[k : k + 2048, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0x297A2D39)
        x ^= x >> np.uint32(16)
        np.maximum(most, x.max(axis=0), out=most)
    # The least exponential variable belongs to the largest uniform one.
    least = -np.log((most.astype(np.float64) + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def joint_estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarities of rows of registers, given both sizes and the register comparison."""
    out = np.empty(len(a))
    log_b = np.log(BASE)
    # p_b(x) = -log_b(1 - x (b - 1) / b)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log_b
    for k in range(0, len(a), 1024):
        part = slice(k, k + 1024)
        up, down = ((f(a[part], b[part])).sum(axis=1)[:, None] for f in (np.greater, np.less))
        same = a.shape[1] - up - down
        u = (n_a[part] / (n_a[part] + n_b[part]))[:, None]
        v = 1 - u
        grid = np.minimum(u / v, v / u) * np.linspace(0, 1, 201)[1:-1]
        more, less = p(u - v * grid), p(v - u * grid)
        like = up * np.log(np.maximum(more, 1e-12)) + down * np.log(np.maximum(less, 1e-12)) + same * np.log(np.maximum(1 - more - less, 1e-12))
        out[part] = np.take_along_axis(grid, like.argmax(axis=1)[:, None], axis=1)[:, 0]
    return out


def similar(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum()) if len(large) else 0


FORMS = "doc_id long, row_key long, n_shingles long, s1 long, s2 long, registers binary"
BROADCAST_ROWS = 500_000
SALTS = 32


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in K.blocks(batch):
            value, at = shingle_sets(data, offsets)
            pair = []
            for seed in (0, 1):
                total = np.concatenate([np.zeros(1, K.U), np.cumsum(K.mix(value * K.U(2 * seed + 3) + K.U(seed)), dtype=K.U)])
                pair.append(K.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(K.U)).view(np.int64))
            n = len(offsets) - 1
            sketches = [registers(value[at[d] : at[d + 1]]).tobytes() for d in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n).cast(pa.int64()), batch.column("row_key").slice(row, n), pa.array(np.diff(at).astype(np.int64)), *(pa.array(p) for p in pair), pa.array(sketches, pa.binary())], ["doc_id", "row_key", "n_shingles", "s1", "s2", "registers"])


def bands() -> F.Column:
    """One key for each band of a set's registers (two bytes each)."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring(F.col("registers"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)), i))


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which pairs are not far apart by the joint estimate of their registers."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.stack([np.frombuffer(x.as_py(), np.uint16) for x in batch.column(c)]) for c in ("rx", "ry"))
            n, m = (batch.column(c).to_numpy().astype(np.float64) for c in ("nx", "ny"))
            near = joint_estimates(a, b, n, m) >= PERCENT / 100 - SLACK
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(near)], ["x", "y", "near"])


VERIFIED = "x long, y long, inter long, total long"


def _sets(batch: pa.RecordBatch, *columns: tuple[str, str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Row by row the shingle sets of (node, text) columns; a batch's repeated nodes are worked out once."""
    cached: dict[int, np.ndarray] = {}

    def form(node: int, text: pa.Scalar) -> np.ndarray:
        if node not in cached:
            if len(cached) >= 256:
                cached.clear()
            raw = np.frombuffer(text.as_py().encode(), np.uint8)
            cached[node] = shingle_sets(raw, np.array([0, len(raw)]))[0]
        return cached[node]

    nodes = [batch.column(c).to_pylist() for c, _ in columns]
    texts = [batch.column(c) for _, c in columns]
    for row in range(batch.num_rows):
        yield tuple(form(n[row], t[row]) for n, t in zip(nodes, texts))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intersection and union of the full sets."""
    for batch in batches:
        sizes = [(k := similar(a, b), len(a) + len(b) - k) for a, b in _sets(batch, ("x", "tx"), ("y", "ty"))]
        if sizes:
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), *(pa.array(c, pa.int64()) for c in zip(*sizes))], ["x", "y", "inter", "total"])


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (x, y) with the sizes of intersection and union of their full sets."""
    a = texts.select(F.col("node").alias("x"), F.col("text").alias("tx"))
    b = texts.select(F.col("node").alias("y"), F.col("text").alias("ty"))
    return cut(pairs.join(a, "x").join(b, "y").mapInArrow(K.task(_verify), VERIFIED), narrow=True)


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """``compared``, but null where the registers rule a link out, so that only the others' texts are moved."""
    a = sketches.select(F.col("node").alias("x"), F.col("registers").alias("rx"), F.col("n_shingles").alias("nx"))
    b = sketches.select(F.col("node").alias("y"), F.col("registers").alias("ry"), F.col("n_shingles").alias("ny"))
    judged = cut(pairs.join(a, "x").join(b, "y").mapInArrow(K.task(_estimate), "x long, y long, near boolean"), narrow=True)
    none = F.lit(None).cast("long")
    return compared(judged.where("near").select("x", "y"), texts).unionByName(judged.where("not near").select("x", "y", none.alias("inter"), none.alias("total")))


def linked(pairs: DataFrame) -> DataFrame:
    return pairs.where(100 * F.col("inter") >= PERCENT * F.col("total")).select("x", "y")


DELTAS = "head long, node long, size long, head_size long, tokens array<long>"


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a set and its head's set do not share."""
    for batch in batches:
        sizes, found = [], []
        for own, head in _sets(batch, ("node", "tx"), ("head", "th")):
            sizes.append((len(own), len(head)))
            found.append(np.setxor1d(own, head, assume_unique=True).view(np.int64))
        if sizes:
            at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column("head"), batch.column("node"), *(pa.array(c, pa.int64()) for c in zip(*sizes)), lists], ["head", "node", "size", "head_size", "tokens"])


def open_members(met: DataFrame, group: DataFrame) -> DataFrame:
    """(head, node, g, g_head) of the heads that have a member outside their component."""
    of = lambda c: group.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    members = met.join(of("node"), "node", "left").join(of("head"), "head", "left").select("head", "node", F.coalesce("c_node", "node").alias("g"), F.coalesce("c_head", "head").alias("g_head"))
    open_heads = small(cut(members.where("g <> g_head").select("head").distinct(), narrow=True), BROADCAST_ROWS)
    return cut(members.join(open_heads, "head", "left_semi"), narrow=True)


def deltas_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    """What the set of each (head, node) and its head's set do not share, and both sizes."""
    pairs = members.select("head", "node")
    pairs = pairs.join(texts.select("node", F.col("text").alias("tx")), "node").join(texts.select(F.col("node").alias("head"), F.col("text").alias("th")), "head")
    return cut(pairs.mapInArrow(K.task(_deltas), DELTAS))


def within_reach(members: DataFrame, deltas: DataFrame) -> DataFrame:
    """Pairs (x, y) that meet in a bucket and may still be linked, x being outside its head's component.

    With m = |x - head| + |head - x| (the delta) and r its tokens that some other delta of the head
    shares, |x - y| + |y - x| >= m_x + m_y - 2 min(r_x, r_y), and a link needs that to be at most
    (|x| + |y|) (1 - t) / (1 + t).  So b_x + a_y and a_x + b_y must both not be positive, where
    b = m - size * share and a = b - 2 r: each side is first cut by the other's least b.
    """
    deltas = deltas.join(small(cut(members.select("head").distinct(), narrow=True), BROADCAST_ROWS), "head", "left_semi")
    lone = deltas.select("head", "node", F.explode("tokens").alias("token")).groupBy("head", "token").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    lone = lone.where("n = 1").groupBy("head", "node").agg(F.count(F.lit(1)).alias("own"))
    share = (100 - PERCENT) / (100 + PERCENT)
    m = F.size("tokens")
    info = deltas.select("head", "node", m.alias("m"), (m - F.col("size") * share).alias("b")).join(lone, ["head", "node"], "left")
    info = info.select("head", "node", "b", (F.col("b") - 2 * (F.col("m") - F.coalesce("own", F.lit(0)))).alias("a"))
    info = cut(info.join(members, ["head", "node"]), narrow=True)
    x, close = info.where("g <> g_head"), F.lit(1e-6)

    def reached(rows: DataFrame, others: DataFrame) -> DataFrame:
        """Rows that some other one of their head may reach; a number for each head is enough for that."""
        least = small(cut(others.groupBy("head").agg(F.min("b").alias("least")), narrow=True), BROADCAST_ROWS)
        return rows.join(least, "head").where(F.col("a") + F.col("least") <= close).drop("least")

    y = reached(info, x)
    x = reached(x, y)
    # A head may have very many members: they are dealt by head and salt, and the few that are outside meet every salt.
    x = x.select("head", F.col("node").alias("x"), F.col("a").alias("ax"), F.col("b").alias("bx"), F.col("g").alias("gx"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    y = y.select(F.col("head").alias("on_head"), F.col("node").alias("y"), F.col("a").alias("ay"), F.col("b").alias("by"), F.col("g").alias("gy"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("on_salt"))
    met = x.join(y, (F.col("head") == F.col("on_head")) & (F.col("salt") == F.col("on_salt")) & (F.col("gx") != F.col("gy")) & (F.col("bx") + F.col("ay") <= close) & (F.col("ax") + F.col("by") <= close))
    return met.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` but the components' own: the smallest node reachable.  Alternates large-star and
    small-star steps, which leave each node pointing at its component's least in O(log^2 n) rounds."""
    edges = cut(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), narrow=True)
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("a"), "m", "u")
        edges = cut(small.select(F.col("a").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), narrow=True)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def classified(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, set size, component (the smallest doc_id of it) and
    ``first_key``, the row_key of the component's first row (null for empty sets)."""
    docs = with_key(docs)
    forms = cut(docs.mapInArrow(K.task(_forms), FORMS))
    full = forms.where("n_shingles > 0")
    # Of each class the row of smallest doc_id, then row_key.  Equal sets have equal registers.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    own = full.groupBy("s1", "s2").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    # A class is called by its smallest doc_id; by its first row's key where that is null or has several texts.
    mixed = full.groupBy(F.col("doc_id").alias("shared")).agg(*(f(c).alias(f"{n}_{c}") for c in ("s1", "s2") for n, f in (("a", F.min), ("b", F.max))))
    mixed = small(cut(mixed.where("shared is not null and (a_s1 <> b_s1 or a_s2 <> b_s2)").select("shared"), narrow=True), BROADCAST_ROWS)
    own = own.join(mixed, F.col("first.doc_id") == F.col("shared"), "left")
    node = F.when(F.col("shared").isNull(), F.col("first.doc_id"))
    own = cut(own.select("s1", "s2", "first", F.coalesce(node, F.col("first.row_key")).alias("node"), "n_shingles", "registers"))
    keyed = own.select("node", F.explode(bands()).alias("band"))
    heads = keyed.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "head")
    met = cut(keyed.join(heads, "band").select("node", "head").distinct())
    pairs = met.where("node <> head").select(F.col("node").alias("x"), F.col("head").alias("y"))
    busy = small(cut(met.select("node").distinct(), narrow=True), BROADCAST_ROWS)  # 8 bytes each
    sketches = cut(own.join(busy, "node", "left_semi").select("node", F.col("first.row_key").alias("key"), F.col("first.doc_id").alias("id"), "n_shingles", "registers"))
    named = small(sketches.select("node", "key", "id"), BROADCAST_ROWS)
    texts = docs.join(named, (F.col("row_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    texts = cut(texts.select("node", "text").dropDuplicates(["node"]))  # repeated rows have one text
    if (texts.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        texts = F.broadcast(texts)
    sketches = small(sketches.select("node", "n_shingles", "registers"), BROADCAST_BYTES // (2 * REGISTERS + 16))
    # A star first: each class and the smallest head among its buckets.
    star = verified(pairs.groupBy("x").agg(F.min("y").alias("y")), sketches, texts)
    group = components(linked(star))
    # Then every class and each head of its buckets that is in another component, by their exact deltas.
    members = open_members(met, group)
    deltas = deltas_of(members, texts)
    both, m = F.col("size") + F.col("head_size"), F.size("tokens")
    to_head = deltas.where("node <> head").select(F.col("node").alias("x"), F.col("head").alias("y"), ((both - m) / 2).cast("long").alias("inter"), ((both + m) / 2).cast("long").alias("total"))
    known = star.unionByName(to_head)
    group = components(linked(known))
    # Last the pairs within a bucket that the bound leaves.
    left = within_reach(open_members(met, group), deltas)  # of heads that were open before
    last = compared(left.join(known.select("x", "y"), ["x", "y"], "left_anti"), texts)
    group = components(linked(known.unionByName(last)))
    # A component is called by the smallest doc_id of its classes; most classes are alone.
    group = group.select(F.col("node").alias("member"), "component")
    group = group.unionByName(group.select(F.col("component").alias("member"), "component")).distinct()
    joined = own.select("node", "first").join(group, F.col("node") == F.col("member"))
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    to_least = small(cut(group.join(least, "component").select("member", "least"), narrow=True), BROADCAST_ROWS)
    named = own.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), "node", "first").join(to_least, F.col("node") == F.col("member"), "left")
    named = named.select("t1", "t2", F.coalesce("least", "first").alias("found"))
    out = forms.join(named, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("found").isNull(), F.col("doc_id")).otherwise(F.col("found.doc_id"))
    return out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), F.col("found.row_key").alias("first_key"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: set size, component and whether it is the component's first."""
    out = classified(docs).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
