"""Connected parts, dilation, edges, colours and hashes against plain versions, pixel by pixel."""

import colorsys
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelmill.functions import pixels as P
from parcelmill.functions import shapes as S


def masks(most=14):
    return st.tuples(st.integers(1, most), st.integers(1, most), st.integers(0, 10**6), st.floats(0.05, 0.9)).map(lambda t: np.random.default_rng(t[2]).random(t[:2]) < t[3])


def flooded(mask, diagonal=True):
    """Label of each marked pixel: the first pixel of its part, in reading order."""
    h, w = mask.shape
    label = {}
    for start in zip(*np.nonzero(mask)):
        if start in label:
            continue
        todo = [start]
        label[start] = start
        while todo:
            y, x = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if diagonal or not (dy and dx):
                        at = (y + dy, x + dx)
                        if 0 <= at[0] < h and 0 <= at[1] < w and mask[at] and at not in label:
                            label[at] = start
                            todo.append(at)
    return label


@given(masks(), st.booleans())
@settings(max_examples=150, deadline=None)
def test_parts(mask, diagonal):
    (row, first, end), root = S.parts(mask, diagonal)
    got = {(y, x): (row[r], first[r]) for y, a, b, r in zip(row, first, end, root) for x in range(a, b)}
    assert got == flooded(mask, diagonal)


@given(masks())
@settings(max_examples=150, deadline=None)
def test_outer_boxes(mask):
    h, w = mask.shape
    outside = {k for k, v in flooded(~np.pad(mask, 1), False).items() if v == (0, 0)}
    boxes = {}
    for (y, x), part in flooded(mask).items():
        boxes.setdefault(part, []).append((y, x))
    want = []
    for pixels in boxes.values():
        if any((y + 1 + dy, x + 1 + dx) in outside for y, x in pixels for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))):
            ys, xs = zip(*pixels)
            want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    assert sorted(S.outer_boxes(mask)) == sorted(want)


def test_a_part_in_anothers_hole_has_no_box():
    ring = np.zeros((9, 9), bool)
    ring[1:8, 1:8] = True
    ring[2:7, 2:7] = False
    ring[4, 4] = True
    assert S.outer_boxes(ring) == [(1, 1, 7, 7)]


@given(masks(), st.integers(1, 6), st.integers(1, 6), st.integers(1, 3))
@settings(max_examples=100, deadline=None)
def test_dilated(mask, width, height, times):
    want = mask
    for _ in range(times):
        last, want = want, np.zeros_like(mask)
        for y, x in np.ndindex(mask.shape):
            for dy in range(height):
                for dx in range(width):
                    at = (y + dy - height // 2, x + dx - width // 2)
                    if 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1] and last[at]:
                        want[y, x] = True
    assert (S.dilated(mask, width, height, times) == want).all()


def plain_edges(grey, low, high):
    h, w = grey.shape
    at = lambda y, x: int(grey[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    size, slope = {}, {}
    for y, x in np.ndindex(h, w):
        gx = sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
        gy = sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
        size[y, x], slope[y, x] = abs(gx) + abs(gy), (gx, gy)
    thin = set()
    for (y, x), m in size.items():
        gx, gy = slope[y, x]
        tangent = abs(gy) / abs(gx) if gx else math.inf
        if tangent < math.tan(math.pi / 8):
            before, after, equal = (y, x - 1), (y, x + 1), True
        elif tangent > math.tan(3 * math.pi / 8):
            before, after, equal = (y - 1, x), (y + 1, x), True
        else:
            s = -1 if (gx < 0) != (gy < 0) else 1
            before, after, equal = (y - 1, x - s), (y + 1, x + s), False
        if m > low and m > size.get(before, 0) and (m >= size.get(after, 0) if equal else m > size.get(after, 0)):
            thin.add((y, x))
    found, todo = set(), [p for p in thin if size[p] > high]
    while todo:
        p = todo.pop()
        if p not in found:
            found.add(p)
            todo += [q for q in ((p[0] + dy, p[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) if q in thin]
    return found


@given(st.integers(1, 16), st.integers(1, 16), st.integers(0, 10**6), st.sampled_from([256, 60, 4]))
@settings(max_examples=120, deadline=None)
def test_edges(h, w, seed, levels):
    grey = np.random.default_rng(seed).integers(0, levels, (h, w)) * (255 // (levels - 1))
    for low, high in ((80, 180), (20, 300), (0, 0)):
        assert set(zip(*np.nonzero(S.edges(grey, low, high)))) == plain_edges(grey, low, high)


def test_edges_of_drawn_shapes():
    grey = np.full((80, 100), 40)
    grey[20:60, 30:70] = 200
    found = S.edges(grey)
    assert 0.9 * 160 <= found.sum() <= 1.1 * 160  # the outline, one pixel wide
    assert not found[30:50, 40:60].any() and not found[:15].any()
    weak = np.full((40, 40), 100)
    weak[:, 20:] = 125  # 100 along an edge: over the lower bound, never over the higher
    assert not S.edges(weak).any()
    weak[10:20, 20:] = 180  # a strong stretch: the weak edge is connected with it
    assert S.edges(weak).any(axis=1).all()


@given(st.integers(0, 255), st.integers(0, 255), st.integers(0, 255))
@settings(max_examples=300, deadline=None)
def test_hue_saturation_value(b, g, r):
    h, s, v = (int(x[0, 0]) for x in P.hsv(np.array([[[b, g, r]]], np.uint8)))
    wh, ws, wv = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
    assert v == max(b, g, r) and abs(s - ws * 255) <= 1 and min(abs(h - wh * 180), 180 - abs(h - wh * 180)) <= 1 and 0 <= h < 181


def test_borders_of_the_overlay_colour():
    """Hues around 30 and 84 degrees (15 and 42), saturation and value around 80."""
    of = lambda h, s, v: np.array([[[round(255 * c) for c in reversed(colorsys.hsv_to_rgb(h / 360, s / 255, v / 255))]]], np.uint8)
    inside = [(34, 200, 200), (80, 200, 200), (50, 90, 200), (50, 200, 90)]
    outside = [(24, 200, 200), (92, 200, 200), (50, 70, 200), (50, 200, 70)]
    assert all(P.yellow(of(*x)).all() for x in inside) and not any(P.yellow(of(*x)).any() for x in outside)


def test_overlay_box():
    mask = np.zeros((900, 1200), bool)
    assert S.overlay_box(mask) is None
    mask[100:120, 200:260] = mask[104:124, 275:330] = True  # two words, joined by the rectangle
    pad = 14  # 1200 * 0.012
    # 10 x 5, twice: 10 to the left and 8 to the right, 4 up and 4 down.
    assert [c[1:] for c in S.overlay_parts(mask)] == [(192, 96, 148, 32)]
    assert S.overlay_box(mask) == (192 - pad, 96 - pad, 148 + 2 * pad, 32 + 2 * pad)
    mask[5:7, 5:7] = True  # too few marks for a group
    assert S.overlay_box(mask) == (192 - pad, 96 - pad, 148 + 2 * pad, 32 + 2 * pad)
    few = np.zeros((2000, 2000), bool)
    few[10:18, 10:18] = True  # 64 marks, but a group needs 80
    assert S.overlay_parts(few) == [] and S.overlay_box(few) == (0, 0, 56, 56)  # the width is counted from the clipped corner
    many = np.zeros((900, 1200), bool)
    for k in range(14):  # the two smallest of 14 groups don't count
        size = 6 if k < 2 else 12
        many[60 * k + 10 : 60 * k + 10 + size, 300 * (k % 4) + 20 : 300 * (k % 4) + 20 + size] = True
    assert len(S.overlay_parts(many)) == 14 and S.overlay_box(many)[1] > 60


def plain_resized(channel, width, height):
    """Lanczos in whole numbers, pixel by pixel: columns, then rows."""

    def along(rows, to):
        size = len(rows[0])
        if size == to:
            return rows
        scale = size / to
        wide = max(scale, 1.0)
        out = [[0] * to for _ in rows]
        for k in range(to):
            center = (k + 0.5) * scale
            low, high = max(int(center - 3 * wide + 0.5), 0), min(int(center + 3 * wide + 0.5), size)
            weights = []
            for x in range(low, high):
                t = (x - center + 0.5) / wide
                sinc = lambda v: 1.0 if v == 0 else math.sin(v * math.pi) / (v * math.pi)
                weights.append(sinc(t) * sinc(t / 3) if -3 <= t < 3 else 0.0)
            total = sum(weights)
            fixed = [int(v / total * (1 << 22) + (0.5 if v / total >= 0 else -0.5)) for v in weights]
            for r, row in enumerate(rows):
                value = (sum(f * int(row[low + i]) for i, f in enumerate(fixed)) + (1 << 21)) >> 22
                out[r][k] = min(255, max(0, value))
        return out

    wide = along(channel.tolist(), width)
    return np.array(along([list(c) for c in zip(*wide)], height)).T


@pytest.mark.parametrize("size", [(8, 9), (17, 23), (60, 41), (100, 5), (4, 4)])
def test_resized(size):
    channel = np.random.default_rng(4).integers(0, 256, size).astype(np.uint8)
    got = P.resized(channel, 9, 8).astype(int)
    assert (got == plain_resized(channel, 9, 8)).all()
    bits = 0
    for y in range(8):
        for x in range(8):
            bits = bits << 1 | int(got[y, x + 1] > got[y, x])
    assert P.difference_hash(np.dstack([channel] * 3)) == (bits - (1 << 64) if bits >> 63 else bits)


def test_sides_are_cut_not_rounded():
    assert P.fitted(8191, 4097, 4096) == (4096, int(4097 * 4096 / 8191)) and P.fitted(5000, 3, 4096) == (4096, 2)


def test_groups_and_boxes_of_pictures(spark):
    from pyspark.sql import functions as F

    from parcelmill.operators import imaging

    rng = np.random.default_rng(6)
    base = [np.kron(rng.integers(0, 256, (8, 9)), np.ones((8, 8))).astype(np.uint8) for _ in range(4)]
    pictures = [base[0], base[1], np.clip(base[0].astype(int) + 3, 0, 255).astype(np.uint8), base[2], base[1], base[3]]
    rows = [(k, f"{k:064x}"[::-1], 72, 64, bytearray(np.dstack([p] * 3).tobytes())) for k, p in enumerate(pictures)]
    images = spark.createDataFrame([*rows, (9, "f" * 64, None, None, None)], "pos long, sha256 string, width int, height int, pixels binary")
    groups = {r.pos: r.group_id for r in imaging.visual_groups(images).collect()}
    digest = [r[1][:12] for r in rows]
    assert groups == {0: digest[0], 1: digest[1], 2: digest[0], 3: digest[3], 4: digest[1], 5: digest[5]}
    marked = np.full((200, 300, 3), 20, np.uint8)
    marked[50:60, 100:150] = (0, 220, 250)
    two = spark.createDataFrame([("a", 300, 200, bytearray(marked.tobytes())), ("b", 300, 200, bytearray(bytes(180_000)))], "origin string, width int, height int, pixels binary")
    boxes = {r.origin: r.overlay for r in imaging.overlay_box(two).collect()}
    assert boxes["b"] is None and tuple(boxes["a"]) == S.overlay_box(P.opened(P.yellow(marked)))
    assert imaging.overlay_box(two).where(F.col("overlay.w") >= 50).count() == 1
