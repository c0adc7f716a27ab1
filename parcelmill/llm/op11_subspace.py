"""Near-duplicate vectors by a subspace pigeonhole join.

Two vectors of one label are linked if their cosine is ``COSINE`` or more, so if their unit vectors are within the squared distance
T = 2 - 2 COSINE.

1. *Classes.*  Vectors of one label whose unit vectors are equal are one class with a multiplicity; copies are never paired.
2. *Rotation.*  Unit vectors are multiplied by random signs and by a Hadamard matrix, which keeps distances and spreads every
   difference evenly over the coordinates.  They are split into blocks, and block b has the share T d_b / d of the budget: if all
   blocks of a pair were further apart than that, so would be the pair.
3. *Range join.*  In each block the space is cut into cells along its coordinates, at quantiles of all vectors, the finer the more classes a label
   has.  A class goes to the cell where it lies, its home, and as a visitor to each other cell within the block's radius.  So a home cell holds all
   that can be within the budget of its classes.  A cell of more than ``CELL`` classes is dealt as tiles of ``CELL`` by ``CELL``.
4. *Verification.*  Pairs within a block's budget are compared in the tile by the cosine of the given vectors in double precision.  A pair
   counts for its home class only in the first block in which it is within the budget, so the union over the blocks has every pair once and no
   pairs are moved: a tile returns the number of links of each home class, and of its links a spanning forest, which is as good
   as all of them for components.

Edge cases: a null label links with nothing; neither does a vector that is null, empty, zero, or holds a null or non-finite component, nor
vectors of different lengths; such rows are their own component.  Rows that share a vec_id are judged each by its own vector, and a repeated row is linked
with its copies.  A component is called by the smallest vec_id in it, null if there is none; rows with a null vec_id are kept only in such a
component.  An empty table gives an empty result; other columns are ignored, whatever their names.  Unit vectors are compared by 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, small, table
from .op08_setsketch import components

COSINE = 0.98
#: Classes on each side of a tile.
CELL = 8192
#: Coordinates of a block, and blocks at most.
LOW, BLOCKS = 8, 16
#: Cuts of a coordinate, at most 2^DEPTH cells.
DEPTH = 4
BINS = 512
#: Rows for a label, a cell or a class that are broadcast at most (some 50 bytes each).
ROWS = 100_000
ROUNDING = 1e-9
PAIRS = 1 << 16


def rows_of(batch: pa.RecordBatch, column: str = "embedding") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) for each length of the column's vectors; null and empty ones and those that hold a null are left out."""
    col = batch.column(column)
    values, offsets = col.values, col.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    good = np.asarray(col.is_valid()) & (sizes > 0)
    if values.null_count:
        nulls = np.concatenate([[0], np.cumsum(~np.asarray(values.is_valid()))])
        good &= nulls[offsets[1:]] == nulls[offsets[:-1]]
        values = values.fill_null(0)
    flat = np.asarray(values, np.float64)
    for size in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == size))
        yield rows, flat[offsets[rows][:, None] + np.arange(size)]


def units(x: np.ndarray) -> np.ndarray:
    """Rows by their length; NaN for those that are zero or not finite."""
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # squares can neither overflow nor vanish
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotated(x: np.ndarray) -> np.ndarray:
    """Random signs, then a Hadamard matrix: distances stay, and no coordinate stands out."""
    n, d = x.shape
    size = 1 << (d - 1).bit_length()
    out = np.zeros((n, size))
    out[:, :d] = x * (np.random.default_rng(11).integers(0, 2, d) * 2 - 1)
    h = 1
    while h < size:
        pairs = out.reshape(n, -1, 2, h)
        a, b = pairs[:, :, 0, :].copy(), pairs[:, :, 1, :].copy()
        pairs[:, :, 0, :], pairs[:, :, 1, :] = a + b, a - b
        h *= 2
    return out / np.sqrt(size)


def blocks_of(size: int) -> list[slice]:
    """The blocks of so many rotated coordinates."""
    n = min(BLOCKS, max(1, size // LOW))
    return [slice(b * size // n, (b + 1) * size // n) for b in range(n)]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128 bits of label and unit vector, null where a row links with nothing."""
    for batch in batches:
        key: list[bytes | None] = [None] * batch.num_rows
        labels = batch.column("label").to_pylist()
        for rows, x in rows_of(batch):
            unit = units(x) + 0.0  # no negative zero
            for row, vector, good in zip(rows.tolist(), unit, np.isfinite(unit).all(axis=1) & np.isfinite(x).all(axis=1)):
                if good and labels[row] is not None:
                    key[row] = hashlib.blake2b(repr(labels[row]).encode() + b"\0" + vector.tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.binary())], [*batch.schema.names, "key"])


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each bin of each rotated coordinate occurs."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in rows_of(batch):
            r = rotated(units(x))
            bins = np.clip(((r + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1) + np.arange(r.shape[1]) * BINS
            found[r.shape[1]] = found.get(r.shape[1], 0) + np.bincount(bins.ravel(), minlength=BINS * r.shape[1])
    for size, counts in found.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size)), pa.array(at // BINS), pa.array(at % BINS), pa.array(counts[at])], ["size", "coordinate", "bin", "n"])


def cuts_of(found: DataFrame) -> dict[int, np.ndarray]:
    """For each vector size 2^DEPTH - 1 cuts of each coordinate at its quantiles: sizes by coordinates by ``BINS`` rows at most.  They only
    decide which cells are equally full."""
    out = {}
    rows = found.toPandas()
    for size, part in rows.groupby("size"):
        counts = np.zeros((size, BINS))
        counts[part["coordinate"], part["bin"]] = part["n"]
        share = np.cumsum(counts, axis=1) / counts.sum(axis=1, keepdims=True)
        wanted = np.arange(1, 1 << DEPTH) / (1 << DEPTH)
        out[int(size)] = np.stack([np.searchsorted(s, wanted) + 1 for s in share]) * (2 / BINS) - 1
    return out


def cells(x: np.ndarray, cuts: np.ndarray, splits: int, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) for each cell within the budget of a row, its home being the cell where it lies."""
    n, d = x.shape
    row, cell, left, home = np.arange(n), np.zeros(n, np.int64), np.full(n, budget), np.ones(n, bool)
    for i in range(d):
        depth = min(DEPTH, splits // d + (i < splits % d))
        if not depth:
            break
        at = cuts[i][(1 << (DEPTH - depth)) - 1 :: 1 << (DEPTH - depth)]
        low, high = np.concatenate([[-np.inf], at]), np.concatenate([at, [np.inf]])
        v = x[row, i][:, None]
        inside = (v >= low) & (v < high)
        apart = np.where(inside, 0, np.minimum(np.abs(v - low), np.abs(v - high)))
        near = apart**2 <= left[:, None]
        k, j = np.nonzero(near)
        row, cell, left, home = row[k], cell[k] << depth | j, left[k] - apart[k, j] ** 2, home[k] & inside[k, j]
    return row, cell, home


PLACE = ["label", "size", "block", "cell"]


def _dealt(cuts: dict[int, np.ndarray], cosine: float, cell: int, carried: list[str]) -> Callable:
    """One row for each cell of each class, with the columns ``carried``."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("classes").to_numpy()
            for rows, x in rows_of(batch):
                r = rotated(units(x))
                size = r.shape[1]
                splits = np.ceil(np.log2(np.maximum(1, n[rows] / cell))).astype(int)
                for b, part in enumerate(blocks_of(size)):
                    budget = (2 - 2 * cosine) * (part.stop - part.start) / size + ROUNDING
                    for s in np.unique(splits):
                        own = np.flatnonzero(splits == s)
                        row, at, home = cells(r[own, part], cuts[size][part], int(s), budget + ROUNDING)
                        for k in range(0, len(row), 4096):  # batches stay small
                            here = slice(k, k + 4096)
                            took = pa.array(rows[own[row[here]]])
                            where = [pa.array(np.full(len(took), x.shape[1])), pa.array(np.full(len(took), b)), pa.array(at[here]), pa.array(home[here])]
                            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(took) for c in carried), *where], [*carried, *PLACE[1:], "home"])

    return K.task(f)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, smallest place reachable by the links a - b) of those that reach a smaller one."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            at = np.flatnonzero(root != np.arange(n))
            return at, root[at]
        root = low


def _judged(cosine: float) -> Callable:
    """The links of a tile's home classes: their number, and a spanning forest."""

    def f(_key: tuple, tile: pa.Table) -> pa.Table:
        batch = tile.combine_chunks().to_batches()[0]
        b = batch.column("block")[0].as_py()
        # A class may come as home and as other.
        node, first, at = np.unique(batch.column("node").to_numpy(), return_index=True, return_inverse=True)
        as_home, as_other = (np.unique(at[np.asarray(batch.column(c)).astype(bool)]) for c in ("left", "right"))
        ((_, x),) = rows_of(batch.take(pa.array(first)).select(["embedding"]))
        n = batch.column("n").to_numpy()[first]
        unit = units(x)
        r = rotated(unit)
        parts = blocks_of(r.shape[1])
        budget = np.array([(2 - 2 * cosine) * (p.stop - p.start) / r.shape[1] + ROUNDING for p in parts])
        starts = np.array([p.start for p in parts])
        own = r[:, parts[b]]
        length = (own * own).sum(axis=1)
        links = np.zeros(len(node), np.int64)
        found = []
        step = max(1, (1 << 22) // max(1, len(as_other)))
        for k in range(0, len(as_home), step):
            some = as_home[k : k + step]
            near = length[some][:, None] + length[as_other] - 2 * own[some] @ own[as_other].T <= budget[b] + ROUNDING
            i, j = np.nonzero(near)
            i, j = some[i], as_other[j]
            keep = i != j
            i, j = i[keep], j[keep]
            for k2 in range(0, len(i), PAIRS):
                p, q = i[k2 : k2 + PAIRS], j[k2 : k2 + PAIRS]
                # Sums over the same order of the same products, whichever comes first: both homes judge alike.
                within = np.add.reduceat((r[p] - r[q]) ** 2, starts, axis=1) <= budget
                mine = within.argmax(axis=1) == b
                mine &= within[:, b]
                p, q = p[mine], q[mine]
                linked = (unit[p] * unit[q]).sum(axis=1) >= cosine
                p, q = p[linked], q[linked]
                links += np.bincount(p, n[q], len(node)).astype(np.int64)
                found.append(np.stack(forest(len(node), p, q)))
        lower, upper = forest(len(node), *np.concatenate(found, axis=1)) if found else (np.zeros(0, int),) * 2
        some = np.flatnonzero(links)
        none = np.full(len(some), -1)
        return pa.table({"node": node[np.concatenate([some, lower])], "other": np.concatenate([none, node[upper]]), "links": np.concatenate([links[some], np.zeros(len(lower), np.int64)])})

    return f


def linked(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): links, component and whether it is the component's first."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label").withColumn("row", F.monotonically_increasing_id())
    kind = vectors.select("label").schema[0].dataType.simpleString()
    of = vectors.select("embedding").schema[0].dataType.simpleString()
    rows = cut(rows.mapInArrow(K.task(_keyed), f"vec_id long, embedding {of}, label {kind}, row long, key binary"))
    # A class is called by its first row's number, which stays what it was once written.
    classes = cut(rows.where("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), narrow=True)
    some = small(classes.select("node", "n"), ROWS)
    first = rows.join(some, F.col("row") == F.col("node")).select("node", "n", "embedding", "label")
    per = cut(first.groupBy(F.col("label").alias("of")).agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), narrow=True)
    first = first.join(small(per, ROWS), F.col("label") == F.col("of")).select("node", "n", "embedding", "label", "classes")
    counts = first.select("embedding").mapInArrow(K.task(_histogram), "size long, coordinate long, bin long, n long").groupBy("size", "coordinate", "bin").agg(F.sum("n").alias("n"))
    cuts = cuts_of(counts)
    where = "size long, block long, cell long, home boolean"
    dealt = first.mapInArrow(_dealt(cuts, cosine, cell, ["label", "node", "n", "embedding"]), f"label {kind}, node long, n long, embedding {of}, {where}")
    # The number of homes and of all in each cell, without the vectors; then the tiles.
    held = first.mapInArrow(_dealt(cuts, cosine, cell, ["label"]), f"label {kind}, {where}").groupBy(*PLACE).agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("all"))
    tiles = lambda c: F.ceil(F.col(c) / cell).cast("int")
    held = cut(held.where("homes > 0 and all > 1").select(*PLACE, tiles("homes").alias("lefts"), tiles("all").alias("rights")), narrow=True)
    met = dealt.join(small(held, ROWS), PLACE)
    mine = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    # As home a class meets all others of its cell, tile by tile; as one of the others all homes.
    span = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    left = F.when(F.col("home"), F.transform(span("rights"), lambda j: F.struct(mine("lefts").alias("i"), j.alias("j"), F.lit(True).alias("left"), (mine("rights") == j).alias("right"))))
    right = F.transform(span("lefts"), lambda i: F.struct(i.alias("i"), mine("rights").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    right = F.filter(right, lambda t: ~(F.col("home") & (t["i"] == mine("lefts"))))  # its own tile has it already
    met = met.select("node", "n", "embedding", *PLACE, F.inline(F.concat(F.coalesce(left, F.array().cast("array<struct<i:int,j:int,left:boolean,right:boolean>>")), right)))
    judged = cut(met.groupBy(*PLACE, "i", "j").applyInArrow(_judged(cosine), "node long, other long, links long"), narrow=True)
    links = judged.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    group = components(judged.where("links = 0").select(F.col("node").alias("x"), F.col("other").alias("y")))
    of_class = classes.join(group, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_class.join(least, "component").select(F.col("key").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("found"))
    out = rows.select("vec_id", "key").join(small(cut(named, narrow=True), ROWS), F.col("key") == F.col("of"), "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
