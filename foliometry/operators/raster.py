"""Masks of one section: components, holes, growth and the completion of a cut region.

Plain numpy on one section at a time; the DataFrame operators run these functions on many sections
in parallel, one group for each. What needs pixel neighbourhoods in a fixed order is here,
everything else is span algebra. Regions are handled as runs of pixels wherever that will do, so
a large image costs one canvas of labels and little more.
"""

from __future__ import annotations

import numpy as np

#: Neighbours in the order in which growth visits them.
AROUND = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))
#: Cut widths tried, as shares of the mean cut length, least half width, kept share, sliver share, hole size.
WIDTHS, LEAST_HALF_WIDTH, KEPT_SHARE, SLIVER_SHARE, HOLE_PIXELS = (0.02, 0.06, 0.15), 1.0, 0.75, 0.015, 32

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def paint(canvas: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, value) -> np.ndarray:
    """Sets the pixels of runs, clipped to the canvas; ``value`` is one for all or one for each."""
    h, w = canvas.shape
    values = np.broadcast_to(value, np.shape(y)).tolist()
    for r, a, b, v in zip(np.asarray(y).tolist(), np.maximum(x0, 0).tolist(), np.minimum(x1, w).tolist(), values, strict=True):
        if 0 <= r < h and a < b:
            canvas[r, a:b] = v
    return canvas


def mask_of(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Pixels of spans, clipped to the canvas."""
    return paint(np.zeros(shape, bool), y, x0, x1, True)


def joined_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> Runs:
    """Runs of one line that overlap or touch as one, in the order of lines and columns."""
    order = np.lexsort((x1, x0, y))
    y, x0, x1 = (np.asarray(c, np.int64)[order] for c in (y, x0, x1))
    line = np.cumsum(np.append(0, y[1:] != y[:-1])) * (int(x1.max()) - int(x0.min()) + 2)  # lines apart, so one running maximum serves them all
    reach = np.maximum.accumulate(x1 + line)
    first = np.flatnonzero(np.append(True, x0[1:] + line[1:] > reach[:-1]))
    return y[first], x0[first], (reach - line)[np.append(first[1:], len(y)) - 1]


def ring_corners(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ring, idx, x, y) of the outlines of runs, as ``connected.outline_vertices`` has them and with the same steps.

    Corners come in pairs along lines and columns; pointers that double their reach find each circle's first corner and how far it is.
    """
    y, x0, x1 = joined_runs(y, x0, x1)
    place, n = np.unique(np.concatenate([((y + d) << 32) + x + (1 << 31) for d in (0, 1) for x in (x0, x1)]), return_counts=True)
    place = place[n % 2 == 1]
    y, x = place >> 32, (place & 0xFFFFFFFF) - (1 << 31)
    here = np.arange(len(y))
    beside, below, column = here ^ 1, np.empty_like(here), np.lexsort((y, x))
    below[column] = column[here ^ 1]
    root, far, to, reach, moved = here, np.zeros_like(here), below[beside], 1, True
    while moved:
        less = root[to] < root
        far, root = np.where(less, far[to] + reach, far), np.where(less, root[to], root)
        to, reach, moved = to[to], 2 * reach, bool(less.any())
    own = np.flatnonzero(root < root[beside])
    own = own[np.lexsort((-far[own], far[own] != 0, root[own]))]
    begin = np.append(True, root[own][1:] != root[own][:-1])[: len(own)]
    ring, k = np.cumsum(begin) - 1, np.arange(len(own))
    k = k - k[begin][ring]
    both = np.stack([own, beside[own]], 1).ravel()
    return np.repeat(ring, 2), np.stack([2 * k, 2 * k + 1], 1).ravel(), x[both], np.repeat(y[own], 2)


def spans_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1, value) of the runs of equal values that are not negative; true counts as 0."""
    h, w = values.shape
    flat = np.full((h, w + 1), False if values.dtype == bool else -1, values.dtype)  # a column of background ends each line
    flat[:, :w] = values
    flat = flat.ravel()
    at = np.append(0, np.flatnonzero(flat[1:] != flat[:-1]) + 1)
    end = np.append(at[1:], len(flat))
    value = flat[at]
    use = value if values.dtype == bool else value >= 0
    at, end, value = at[use], end[use], np.zeros(int(use.sum()), np.int32) if values.dtype == bool else value[use]
    y = at // (w + 1)
    return y, at - y * (w + 1), end - y * (w + 1), value


def label_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Component of each run; components are numbered by their first pixel, row by row."""
    order = np.lexsort((x0, y))
    ys, a, b = y[order], x0[order], x1[order]
    up = list(range(len(order)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    reach = 0 if diagonal else 1
    start = {int(v): int(i) for v, i in zip(*np.unique(ys, return_index=True), strict=True)}
    end = {v: i + int(n) for (v, i), n in zip(start.items(), np.unique(ys, return_counts=True)[1], strict=True)}
    ys, a, b = ys.tolist(), a.tolist(), b.tolist()
    for i in range(1, len(up)):
        if ys[i] == ys[i - 1] and a[i] <= b[i - 1]:  # runs of one line that meet
            p, q = find(i - 1), find(i)
            up[max(p, q)] = min(p, q)
    for row, i in start.items():
        if row - 1 not in start:
            continue
        j, above = start[row - 1], end[row - 1]
        while i < end[row] and j < above:
            if a[i] + reach <= b[j] and a[j] + reach <= b[i]:
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(up))], dtype=np.int64)
    _, number = np.unique(roots, return_inverse=True)
    out = np.empty(len(order), np.int64)
    out[order] = number
    return out


def component_runs(mask: np.ndarray, diagonal: bool = True) -> tuple[Runs, np.ndarray]:
    """The runs of a mask, and the component of each."""
    y, x0, x1, _ = spans_of(mask)
    return (y, x0, x1), label_runs(y, x0, x1, diagonal)


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels of a mask, -1 outside."""
    found, number = component_runs(mask, diagonal)
    return paint(np.full(mask.shape, -1, np.int32), *found, number)


def enclosed(mask: np.ndarray) -> int:
    """Background pixels that no 4-connected path joins with the canvas border."""
    (_, x0, x1), number = component_runs(~np.pad(mask, 1), diagonal=False)
    return int((x1 - x0)[number != 0].sum())  # the padding joins all background at the border to the first pixel's component


def has_hole(mask: np.ndarray) -> bool:
    return enclosed(mask) > HOLE_PIXELS


def grow(labels: np.ndarray, region: np.ndarray, blocked: np.ndarray | None = None) -> None:
    """Labels spread into the region breadth first, seeds row by row, neighbours in a fixed order.

    All pixels of one distance are taken together; of those that reach a pixel, the first in the
    order of a queue gives its label.
    """
    h, w = labels.shape
    open_ = np.zeros((h + 2, w + 2), bool)
    open_[1:-1, 1:-1] = region & (labels < 0)
    if blocked is not None:
        open_[1:-1, 1:-1] &= ~blocked
    near = np.zeros((h, w), bool)
    for dx, dy in AROUND:
        near |= open_[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx]
    y, x = np.nonzero(near & (labels >= 0))
    flat, width = open_.ravel(), w + 2
    steps = np.array([dy * width + dx for dx, dy in AROUND])
    front, value = (y + 1) * width + x + 1, labels[y, x]
    while len(front):
        reached = (front[:, None] + steps).ravel()
        hit = np.flatnonzero(flat[reached])
        _, first = np.unique(reached[hit], return_index=True)
        hit = hit[np.sort(first)]
        front, value = reached[hit], value[hit // len(AROUND)]
        flat[front] = False
        labels[front // width - 1, front % width - 1] = value


def complete(raw: np.ndarray, region: np.ndarray, least: int) -> np.ndarray:
    """``complete_runs`` of a canvas of component labels."""
    y, x0, x1, number = spans_of(raw)
    return complete_runs((y, x0, x1), number, region, least)


def complete_runs(runs: Runs, number: np.ndarray, region: np.ndarray, least: int) -> np.ndarray:
    """Every region pixel that can be reached gets the label of a kept component.

    Components (``number`` for each of ``runs``) below ``least`` pixels are slivers. Kept ones grow around
    them first; then each sliver, in order, goes whole to the label it touches most (lowest of
    equals); then growth fills the rest.
    """
    y, x0, x1 = runs
    sizes = np.bincount(number, x1 - x0).astype(np.int64) if len(number) else np.zeros(0, np.int64)
    keep = sizes >= least
    name = np.where(keep, np.cumsum(keep) - 1, -1)
    labels = paint(np.full(region.shape, -1, np.int32), y, x0, x1, name[number] if len(number) else 0)
    order = np.argsort(number, kind="stable")
    bounds = np.searchsorted(number[order], np.arange(len(sizes) + 1))
    slivers = [order[bounds[c] : bounds[c + 1]] for c in np.flatnonzero(~keep)]
    small = np.concatenate(slivers) if slivers else np.zeros(0, np.int64)
    grow(labels, region, mask_of(y[small], x0[small], x1[small], region.shape))
    h, w = labels.shape
    for own in slivers:
        n = x1[own] - x0[own]
        py = np.repeat(y[own], n)
        px = np.arange(n.sum()) + np.repeat(x0[own] - (np.cumsum(n) - n), n)
        votes = np.zeros(int(keep.sum()) + 1, np.int64)
        for dx, dy in AROUND:
            i, j = py + dy, px + dx
            ok = (i >= 0) & (i < h) & (j >= 0) & (j < w)
            found = labels[i[ok], j[ok]]
            votes += np.bincount(found[found >= 0], minlength=len(votes))
        if votes.max() > 0:
            labels[py, px] = int(votes.argmax())
    grow(labels, region)
    return labels


def cut_polygon(mask: np.ndarray, px: np.ndarray, py: np.ndarray) -> None:
    """Clears the pixels whose centres are inside a polygon (even-odd), working in its bounds only."""
    h, w = mask.shape
    top, bottom = max(int(np.ceil(py.min() - 0.5)), 0), min(int(np.ceil(py.max() - 0.5)), h)
    left, right = max(int(np.ceil(px.min() - 0.5)), 0), min(int(np.ceil(px.max() - 0.5)), w)
    if top >= bottom or left >= right:
        return
    flips = np.zeros((bottom - top, right - left + 1), np.int16)
    for ax, ay, bx, by in zip(px, py, np.roll(px, -1), np.roll(py, -1), strict=True):
        low, high = int(np.ceil(min(ay, by) - 0.5)), int(np.ceil(max(ay, by) - 0.5))
        rows = np.arange(max(low, top), min(high, bottom))
        if ay == by or not len(rows):
            continue
        cross = ax + (rows + 0.5 - ay) * (bx - ax) / (by - ay)
        flips[rows - top, np.clip(np.ceil(cross - 0.5) - left, 0, right - left).astype(int)] += 1
    mask[top:bottom, left:right] &= np.cumsum(flips[:, :-1], axis=1, dtype=np.int16) % 2 == 0


def polygon_mask(px: np.ndarray, py: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Pixels whose centres are inside a polygon (even-odd)."""
    out = np.ones(shape, bool)
    cut_polygon(out, np.asarray(px, float), np.asarray(py, float))
    return ~out


def strip(points: np.ndarray, half: float) -> np.ndarray:
    """Polygon around a polyline, through single precision."""

    def unit(v: np.ndarray) -> np.ndarray:
        n = np.sqrt((v**2).sum())
        return np.array([1.0, 0.0]) if n < 1e-9 else v / n

    normals = []
    for i in range(len(points)):
        if len(points) == 1:
            d = np.array([1.0, 0.0])
        elif i == 0:
            d = unit(points[1] - points[0])
        elif i == len(points) - 1:
            d = unit(points[-1] - points[-2])
        else:
            first = unit(points[i] - points[i - 1])
            both = first + unit(points[i + 1] - points[i])
            d = first if np.sqrt((both**2).sum()) < 1e-9 else unit(both)
        normals.append((-d[1], d[0]))
    normal = np.array(normals)
    out = np.concatenate([points + normal * half, (points - normal * half)[::-1]])
    return out.astype(np.float32).astype(float)


def split(grey: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, dict]:
    """Labels of the sections that the cuts make of a region, and how it went.

    ``cuts`` are in canvas coordinates. The thinnest strips that give the expected number of
    sections are used; failing that, the attempt nearest to it.
    """
    area = int(grey.sum())
    least = int(area * SLIVER_SHARE)
    ring = has_hole(grey)
    expected = len(cuts) + (not ring)
    mean = sum(np.sqrt((np.diff(c, axis=0) ** 2).sum(1)).sum() for c in cuts) / len(cuts)
    best, chosen = None, None
    for share in WIDTHS:
        half = max(LEAST_HALF_WIDTH, mean * share)
        divided = grey.copy()
        for c in cuts:
            p = strip(c, half)
            cut_polygon(divided, p[:, 0], p[:, 1])
        found, number = component_runs(divided)
        sizes = np.bincount(number, found[2] - found[1]).astype(np.int64) if len(number) else np.zeros(0, np.int64)
        kept, kept_area = int((sizes >= least).sum()), int(sizes[sizes >= least].sum())
        rank = (abs(kept - expected), -kept_area)
        clean = kept == expected and kept_area >= area * KEPT_SHARE
        if clean or best is None or rank < best:
            best, chosen = rank, (found, number, {"half_width": float(half), "kept": kept, "clean": clean})
        if clean:
            break
    found, number, how = chosen
    labels = complete_runs(found, number, grey, least)
    assigned = int((labels >= 0).sum())
    return labels, how | {"ring": bool(ring), "expected": int(expected), "area": area, "assigned": assigned}


def outline(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings of pixel corners around a mask; filling them by the even-odd rule gives it back.

    Only the sides between a pixel and background are walked, with the mask to the right.
    """
    m = np.pad(mask, 1)
    inner = m[1:-1, 1:-1]
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    sides = ((m[:-2, 1:-1], (0, 0), (1, 0)), (m[1:-1, 2:], (1, 0), (1, 1)), (m[2:, 1:-1], (1, 1), (0, 1)), (m[1:-1, :-2], (0, 1), (0, 0)))
    for beside, (ax, ay), (bx, by) in sides:
        y, x = np.nonzero(inner & ~beside)
        for p, q in zip(zip((x + ax).tolist(), (y + ay).tolist(), strict=True), zip((x + bx).tolist(), (y + by).tolist(), strict=True), strict=True):
            after.setdefault(p, []).append(q)
    rings = []
    for start in sorted(after):
        while after[start]:
            ring, at = [start], after[start].pop()
            while at != start:
                ring.append(at)
                at = after[at].pop()
            corners = [p for i, p in enumerate(ring) if (p[0] - ring[i - 1][0]) * (ring[(i + 1) % len(ring)][1] - p[1]) != (p[1] - ring[i - 1][1]) * (ring[(i + 1) % len(ring)][0] - p[0])]
            rings.append(corners)
    return rings
