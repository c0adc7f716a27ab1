"""Connected parts of masks, edges, and the box around an overlay's writing."""

from __future__ import annotations

import numpy as np

# What counts as an overlay.
MIN_MARKED = 30
PADDING = 0.012
BEST_PARTS = 12
LOW_EDGE, HIGH_EDGE = 80, 180


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column after the last) of each run of marked pixels, in order."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, first, end


def parts(mask: np.ndarray, diagonal: bool = True) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The runs of a mask, and for each the smallest run that it is connected with (over corners too, if ``diagonal``).

    Runs of neighbouring rows that touch are linked, and every run takes the least root of its neighbours until nothing changes, its root's root at each step."""
    row, first, end = found = runs(mask)
    n, wide, d = len(row), mask.shape[1] + 4, int(diagonal)
    starts, ends = row * wide + first, row * wide + end
    # Runs of the next row that end after this one's start and start before its end.
    low = np.searchsorted(ends, (row + 1) * wide + first - d, "right")
    high = np.searchsorted(starts, (row + 1) * wide + end + d, "left")
    size = np.maximum(0, high - low)
    a = np.repeat(np.arange(n), size)
    b = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, root[a], root[b])
        np.minimum.at(least, root[b], root[a])
        least = least[least]
        if (least == root).all():
            return found, root
        root = least


def dilated(mask: np.ndarray, width: int, height: int, times: int = 1) -> np.ndarray:
    """A pixel is marked if one is in the rectangle around it (its middle at half its size, rounded down), again and again."""
    for axis, size in ((1, width), (0, height)):
        total = np.cumsum(np.insert(mask.astype(np.int32), 0, 0, axis=axis), axis=axis)
        n = mask.shape[axis]
        low = np.clip(np.arange(n) - times * (size // 2), 0, n)
        high = np.clip(np.arange(n) + times * (size - 1 - size // 2) + 1, 0, n)
        mask = np.take(total, high, axis=axis) > np.take(total, low, axis=axis)
    return mask


def outer_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, width, height) of the connected parts that no other part surrounds."""
    (row, first, end), root = parts(mask)
    if not len(row):
        return []
    # The background that reaches the frame; a part that lies in another's hole touches none of it.
    (grow, gfirst, gend), groot = parts(~np.pad(mask, 1), diagonal=False)
    outside = np.zeros((mask.shape[0] + 2, mask.shape[1] + 3), np.int32)
    some = groot == groot[0]  # the frame's own corner
    np.add.at(outside, (grow[some], gfirst[some]), 1)
    np.add.at(outside, (grow[some], gend[some]), -1)
    outside = np.cumsum(outside, axis=1)[:, :-1] > 0
    near = outside[:-2, 1:-1] | outside[2:, 1:-1] | outside[1:-1, :-2] | outside[1:-1, 2:]
    count = np.cumsum(np.pad(near, ((0, 0), (1, 0))).astype(np.int32), axis=1)
    open_ = np.unique(root[count[row, end] > count[row, first]])
    out = []
    order = np.argsort(root, kind="stable")
    cuts = np.searchsorted(root[order], open_), np.searchsorted(root[order], open_, "right")
    for a, b in zip(*cuts):
        own = order[a:b]
        x, y = int(first[own].min()), int(row[own].min())
        out.append((x, y, int(end[own].max()) - x, int(row[own].max()) + 1 - y))
    return out


def overlay_parts(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(marked pixels, x, y, width, height) of the groups of an overlay's marked pixels that are large enough, the fullest first.  Marks are joined
    to words and lines by a rectangle that follows the picture's size."""
    height, width = mask.shape
    if int(mask.sum()) < MIN_MARKED:
        return []
    boxes = outer_boxes(dilated(mask, max(5, width // 120), max(3, height // 180), 2))
    counted = [(int(mask[y : y + h, x : x + w].sum()), x, y, w, h) for x, y, w, h in boxes]
    least = max(20, int(width * height * 0.00002))
    return sorted((c for c in counted if c[0] >= least), key=lambda c: -c[0])


def overlay_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x, y, width, height) around the fullest groups, padded; around all marks where no group is large enough; None with too few."""
    height, width = mask.shape
    if int(mask.sum()) < MIN_MARKED:
        return None
    found = [c[1:] for c in overlay_parts(mask)[:BEST_PARTS]]
    if not found:
        ys, xs = np.nonzero(mask)
        found = [(int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1)]
    x, y = min(b[0] for b in found), min(b[1] for b in found)
    w, h = max(b[0] + b[2] for b in found) - x, max(b[1] + b[3] for b in found) - y
    pad = max(6, int(max(width, height) * PADDING))
    x, y = max(0, x - pad), max(0, y - pad)
    return x, y, min(width, x + w + 2 * pad) - x, min(height, y + h + 2 * pad) - y


def slopes(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel gradients along the rows and the columns; the frame's pixels go on beyond it."""
    p = np.pad(grey.astype(np.int64), 1, mode="edge")
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def edges(grey: np.ndarray, low: int = LOW_EDGE, high: int = HIGH_EDGE) -> np.ndarray:
    """Thin edges: pixels whose gradient is over ``low`` and the largest along its direction, if they are connected with one over ``high``."""
    gx, gy = slopes(grey)
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    at = lambda dy, dx: p[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    # Directions by the tangents of 22.5 and 67.5 degrees, in 15-bit fixed point.
    x, y = np.abs(gx), np.abs(gy) << 15
    flat, steep = x * 13573, x * 13573 + (x << 16)
    turned = (gx < 0) != (gy < 0)
    along = (size > at(0, -1)) & (size >= at(0, 1))
    upright = (size > at(-1, 0)) & (size >= at(1, 0))
    falling, rising = (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1))
    thin = (size > low) & np.where(y < flat, along, np.where(y > steep, upright, np.where(turned, rising, falling)))
    (row, first, end), root = parts(thin)
    strong = np.cumsum(np.pad(thin & (size > high), ((0, 0), (1, 0))).astype(np.int32), axis=1)
    sure = np.isin(root, root[strong[row, end] > strong[row, first]])
    out = np.zeros((grey.shape[0], grey.shape[1] + 1), np.int32)
    np.add.at(out, (row[sure], first[sure]), 1)
    np.add.at(out, (row[sure], end[sure]), -1)
    return np.cumsum(out, axis=1)[:, :-1] > 0
