"""The vector join against the comparison of all pairs."""

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelmill.llm import op11_subspace as S


def planted(size, n, seed, spread=(0.05, 0.1, 0.14, 0.2)):
    """Vectors at random, and groups around some of them that are about as far from each other as the threshold."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=size) for _ in range(n)]
    for k in range(12):
        base = out[k] / np.linalg.norm(out[k])
        for _ in range(6):
            step = rng.normal(size=size)
            out.append((base + step / np.linalg.norm(step) * rng.choice(spread)) * rng.choice([1, 3.5, 1e-3]))
    return [[float(np.float32(x)) for x in v] for v in out]


def rows_of(size=64, n=150, seed=1):
    vs = planted(size, n, seed)
    rng = np.random.default_rng(seed)
    return [(k, v, int(rng.integers(0, 3)) if k < n // 2 else 1) for k, v in enumerate(vs)]


def made(spark, rows, of="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{of}>, label int").repartition(4)


def same(df, rows, **more):
    got = sorted((tuple(r) for r in S.linked(df, **more).collect()), key=repr)
    assert got == sorted(brute.vectors(rows, more.get("cosine", S.COSINE)), key=repr)
    return got


@pytest.mark.parametrize("size, cell", [(64, 2048), (64, 10), (64, 1), (100, 16), (7, 8), (1, 4), (300, 32)])
def test_links(spark, size, cell):
    rows = rows_of(size)
    assert size == 1 or sum(r[1] for r in same(made(spark, rows), rows, cell=cell))


def test_other_thresholds(spark):
    rows = rows_of()
    for cosine in (0.5, 0.9, 0.999):
        same(made(spark, rows), rows, cosine=cosine, cell=20)


def test_a_hot_group_and_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    rows = [(k, [float(np.float32(x)) for x in base + rng.normal(size=64) * 0.06], 4) for k in range(120)]
    rows += [(200 + k, rows[k % 3][1], 4) for k in range(90)]  # copies of three
    rows += [(k, v, 4) for k, v, _ in rows_of(seed=3)[:60]]  # ids come again
    for cell in (2048, 25):
        assert max(r[1] for r in same(made(spark, rows), rows, cell=cell)) > 100


def test_awkward_rows(spark):
    rows = rows_of(n=40)
    nan, inf = float("nan"), float("inf")
    good = rows[0][1]
    rows += [(None, good, rows[0][2]), (None, None, 1), (900, None, 1), (901, [], 1), (902, [0.0] * 64, 1), (903, [nan] + good[1:], 1), (904, [inf] + good[1:], 1), (905, [None] + good[1:], 1), (906, good[:32], rows[0][2]), (907, good, None), (908, good, None), (909, good, rows[0][2]), (909, good, rows[0][2]), (910, [-0.0 if x == 0 else x for x in good], rows[0][2]), (911, [0.0] * 63 + [2.0], 1), (912, [-0.0] * 63 + [1.0], 1)]
    for of in ("float", "double"):
        same(made(spark, rows, of), rows)
        same(made(spark, rows, of).withColumns({c: F.lit("x") for c in ("node", "n", "key", "row", "cell", "home", "block", "size", "i", "j", "left", "of")}), rows, cell=8)
    big = [(1, [1e300, 1e300], 1), (2, [1e-300, 1e-300], 1), (3, [1e300, -1e300], 1)]
    assert [r[1] for r in same(made(spark, big, "double"), big)] == [1, 1, 0]


def test_nothing_to_link(spark):
    assert S.linked(made(spark, [])).count() == 0
    rows = [(1, None, 1), (2, [1.0], None), (3, [1.0, 2.0], 3)]
    same(made(spark, rows), rows)


@given(st.integers(1, 130), st.integers(0, 1000))
@settings(max_examples=30, deadline=None)
def test_rotation_keeps_distances(size, seed):
    x = np.random.default_rng(seed).normal(size=(6, size))
    r = S.rotated(x)
    assert np.allclose(r @ r.T, x @ x.T)
    parts = S.blocks_of(r.shape[1])
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(r.shape[1])) and len(parts) <= S.BLOCKS


@given(st.integers(0, 14), st.floats(0.001, 0.5), st.integers(0, 99))
@settings(max_examples=40, deadline=None)
def test_each_home_cell_holds_all_that_are_near(splits, budget, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 4)) * 0.3
    cuts = np.sort(rng.normal(size=(4, (1 << S.DEPTH) - 1)) * 0.3, axis=1)
    row, cell, home = S.cells(x, cuts, splits, budget)
    assert sorted(row[home]) == list(range(60)) and len(set(zip(row, cell))) == len(row)
    within = set(zip(row.tolist(), cell.tolist()))
    at = dict(zip(row[home].tolist(), cell[home].tolist()))
    for a in range(60):
        for b in range(60):
            if ((x[a] - x[b]) ** 2).sum() <= budget:
                assert (b, at[a]) in within


@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_a_forest_reaches_what_the_links_reach(links):
    a, b = (np.array([x[k] for x in links], int) for k in (0, 1))
    at, root = S.forest(20, a, b)
    least = list(range(20))
    for _ in range(20):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    want = {i: c for i, c in enumerate(least) if i != c}
    assert dict(zip(at.tolist(), root.tolist())) == want
