"""Numpy kernels behind Arrow functions, for what Column expressions cannot say.

Polygons are lists of rings (n x 2 arrays, closed), the first one outer; multipolygons are lists of polygons.
Boolean operations are by slabs: x is split at all vertices and crossings, and within a slab every polygon is a set of
trapezoids under the even-odd rule. Areas are exact; a result's geometry is its trapezoids.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

Rings = list[np.ndarray]


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) / 2)


def polygon_area(rings: Rings) -> float:
    return abs(ring_area(rings[0])) - sum(abs(ring_area(r)) for r in rings[1:]) if rings else 0.0


def clip_box(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Part of a ring inside a box, half plane by half plane; closed, empty if nothing is left."""
    pts = ring[:-1] if len(ring) and np.array_equal(ring[0], ring[-1]) else ring
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(pts):
            break
        inside = sign * (pts[:, axis] - bound) >= 0
        out = []
        for i, p in enumerate(pts):
            q, was = pts[i - 1], inside[i - 1]
            if was != inside[i]:
                t = (bound - q[axis]) / (p[axis] - q[axis])
                cross = q + t * (p - q)
                cross[axis] = bound
                out.append(cross)
            if inside[i]:
                out.append(p)
        pts = np.array(out).reshape(-1, 2)
    return np.vstack([pts, pts[:1]]) if len(pts) >= 3 else np.zeros((0, 2))


def _segments(polygons: list[Rings]) -> np.ndarray:
    """Non-vertical edges as rows x0, y0, x1, y1 with x0 < x1."""
    rows = [np.hstack([r[:-1], r[1:]]) for rings in polygons for r in rings if len(r) > 2]
    if not rows:
        return np.zeros((0, 4))
    s = np.vstack(rows).astype(float)
    s = s[s[:, 0] != s[:, 2]]
    swap = s[:, 0] > s[:, 2]
    s[swap] = s[swap][:, [2, 3, 0, 1]]
    return s


def _cuts(s: np.ndarray) -> np.ndarray:
    """All x where an edge starts, ends or crosses another."""
    xs = [s[:, 0], s[:, 2]]
    for i in range(len(s)):
        a, b = s[i], s[i + 1 :]
        b = b[(b[:, 0] < a[2]) & (b[:, 2] > a[0])]
        if len(b):
            ka, kb = (a[3] - a[1]) / (a[2] - a[0]), (b[:, 3] - b[:, 1]) / (b[:, 2] - b[:, 0])
            with np.errstate(divide="ignore", invalid="ignore"):
                x = (b[:, 1] - kb * b[:, 0] - a[1] + ka * a[0]) / (ka - kb)
            xs.append(x[np.isfinite(x) & (x > np.maximum(a[0], b[:, 0])) & (x < np.minimum(a[2], b[:, 2]))])
    return np.unique(np.concatenate(xs))


def overlay(a: list[list[Rings]], b: list[list[Rings]], keep) -> list[np.ndarray]:
    """Trapezoids (closed rings) where `keep(in_a, in_b)`; a and b are lists of multipolygons that are unioned."""
    parts = [(0, _segments(m)) for m in a] + [(1, _segments(m)) for m in b]
    parts = [(side, s) for side, s in parts if len(s)]
    if not parts:
        return []
    every = np.vstack([s for _, s in parts])
    owner = np.repeat(np.arange(len(parts)), [len(s) for _, s in parts])
    side = np.array([p[0] for p in parts])
    out: list[np.ndarray] = []
    xs = _cuts(every)
    for lo, hi in zip(xs, xs[1:]):
        on = (every[:, 0] <= lo) & (every[:, 2] >= hi)
        e, own = every[on], owner[on]
        k = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
        ya, yb = e[:, 1] + k * (lo - e[:, 0]), e[:, 1] + k * (hi - e[:, 0])
        order = np.lexsort((yb, ya, ya + yb))
        inside, depth, start = np.zeros(len(parts), bool), [0, 0], None
        for i in order:
            p = own[i]
            inside[p] ^= True
            depth[side[p]] += 1 if inside[p] else -1
            now = bool(keep(depth[0] > 0, depth[1] > 0))
            if now and start is None:
                start = i
            elif not now and start is not None:
                ring = np.array([[lo, ya[start]], [hi, yb[start]], [hi, yb[i]], [lo, ya[i]], [lo, ya[start]]])
                if abs(ring_area(ring)) > 0:
                    out.append(ring)
                start = None
    return out


def area_of(traps: list[np.ndarray]) -> float:
    return float(sum(abs(ring_area(t)) for t in traps))


def _convex_overlap(subject: list[list[float]], window: list[list[float]]) -> float:
    """Shared area of two convex rings (open): the one cut by each side of the other in turn."""
    sign = 1.0 if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(window, window[1:] + window[:1])) > 0 else -1.0
    pts = subject
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1]):
        side = [sign * ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) for x, y in pts]
        out = []
        for k, (x, y) in enumerate(pts):
            s, t = side[k - 1], side[k]
            if (s > 0) != (t > 0) and s != t:
                (px, py), f = pts[k - 1], s / (s - t)
                out.append((px + f * (x - px), py + f * (y - py)))
            if t > 0:
                out.append((x, y))
        pts = out
        if len(pts) < 3:
            return 0.0
    ox, oy = pts[0]
    return abs(sum((p[0] - ox) * (q[1] - oy) - (q[0] - ox) * (p[1] - oy) for p, q in zip(pts, pts[1:]))) / 2


def boxes(a: list[Rings]) -> np.ndarray | None:
    """The even-odd pieces as boxes (rows x0, y0, x1, y1) where all edges are horizontal or vertical; else None."""
    if any((np.diff(r, axis=0) != 0).all(1).any() for rings in a for r in rings):
        return None
    if len(a) == len(a[0]) == 1 and len(a[0][0]) == 5:
        (x0, y0), (x1, y1) = a[0][0].min(0), a[0][0].max(0)
        if x0 < x1 and y0 < y1 and abs(ring_area(a[0][0])) == (x1 - x0) * (y1 - y0):
            return np.array([[x0, y0, x1, y1]])
    return np.array([[t[0, 0], t[0, 1], t[2, 0], t[2, 1]] for t in repaired(a)]).reshape(-1, 4)


def box_difference(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """What boxes a cover and boxes b do not, as closed rings, by the grid of all their edges; those of a are disjoint."""
    if not len(a):
        return []
    low, high = a[:, :2].min(0), a[:, 2:].max(0)
    b = np.hstack([np.maximum(b[:, :2], low), np.minimum(b[:, 2:], high)])  # nothing else matters
    b = b[(b[:, :2] < b[:, 2:]).all(1)]
    every = np.concatenate((a, b))
    xs, ys = np.unique(every[:, [0, 2]]), np.unique(every[:, [1, 3]])
    left = np.zeros((len(xs) - 1, len(ys) - 1), bool)
    for rows, value in ((a, True), (b, False)):
        places = np.stack([np.searchsorted(xs if c % 2 == 0 else ys, rows[:, c]) for c in range(4)], 1)
        for i, j, k, m in places.tolist():
            left[i:k, j:m] = value
    turns = np.diff(np.pad(left, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    out = []
    for i in np.flatnonzero(left.any(1)).tolist():
        for y0, y1 in zip(ys[turns[i] == 1], ys[turns[i] == -1]):
            out.append(np.array([[xs[i], y0], [xs[i + 1], y0], [xs[i + 1], y1], [xs[i], y1], [xs[i], y0]]))
    return out


def intersection_area(a: list[Rings], b: list[Rings], known: dict[tuple[bytes, ...], np.ndarray | None] | None = None) -> float:
    """`known` keeps the boxes of shapes between calls."""
    if len(a) == len(b) == 1 and len(a[0]) == len(b[0]) == 1:
        p, q = a[0][0][:-1].tolist(), b[0][0][:-1].tolist()
        if len(p) > 2 and len(q) > 2 and _is_convex(p) and _is_convex(q):
            return _convex_overlap(p, q)
    if known is not None:
        cut = []
        for m in (a, b):
            key = tuple(r.tobytes() for rings in m for r in rings)
            if key not in known:
                known[key] = boxes(m)
            cut.append(known[key])
        if cut[0] is not None and cut[1] is not None:
            p, q = cut[0][:, None], cut[1][None]
            sides = np.minimum(p[..., 2:], q[..., 2:]) - np.maximum(p[..., :2], q[..., :2])
            return float(np.maximum(sides, 0).prod(-1).sum())
    return area_of(overlay([a], [b], lambda p, q: p and q))


def union(many: list[list[Rings]]) -> list[np.ndarray]:
    return overlay(many, [], lambda p, q: p)


def difference(a: list[Rings], many: list[list[Rings]]) -> list[np.ndarray]:
    cut = [boxes(m) for m in (a, *many) if m]
    if a and all(c is not None for c in cut):
        return box_difference(cut[0], np.concatenate(cut[1:]) if cut[1:] else np.zeros((0, 4)))
    return overlay([a], many, lambda p, q: p and not q)


def repaired(a: list[Rings]) -> list[np.ndarray]:
    """Even-odd pieces of a possibly self-crossing multipolygon."""
    return overlay([a], [], lambda p, q: p)


def contains(rings: Rings, x: float, y: float) -> bool:
    """Even-odd; the edge itself counts as inside."""
    inside = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


def intersects(a: Rings, b: Rings) -> bool:
    """Closed: touching counts."""
    ea, eb = (np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings]) for rings in (a, b))

    def side(p, q, r):
        return np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))

    p, q, r, s = ea[:, None, :2], ea[:, None, 2:], eb[None, :, :2], eb[None, :, 2:]
    boxes = (np.maximum(np.minimum(p, q), np.minimum(r, s)) <= np.minimum(np.maximum(p, q), np.maximum(r, s))).all(-1)
    if (boxes & (side(p, q, r) * side(p, q, s) <= 0) & (side(r, s, p) * side(r, s, q) <= 0)).any():
        return True
    return contains(a, *b[0][0]) or contains(b, *a[0][0])


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring; a ring is never brought below a triangle."""
    pts = ring[:-1]
    if len(pts) <= 3:
        return ring
    far = int(np.argmax(((pts - pts[0]) ** 2).sum(1)))
    keep = np.zeros(len(pts) + 1, bool)
    loop = np.vstack([pts, pts[:1]])
    keep[[0, far, len(pts)]] = True
    stack = [(0, far), (far, len(pts))]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        d, v = loop[j] - loop[i], loop[i + 1 : j] - loop[i]
        n = np.hypot(*d)
        dist = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / n if n else np.hypot(v[:, 0], v[:, 1])
        k = int(np.argmax(dist))
        if dist[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    out = loop[keep]
    return out if len(out) >= 4 else ring


def _is_convex(pts: list[list[float]]) -> bool:
    """Whether all corners turn the same way and once around."""
    n, turns, flips, last = len(pts), 0, 0, 0
    for i in range(n):
        (ax, ay), (bx, by), (cx, cy) = pts[i - 2], pts[i - 1], pts[i]
        turn = (bx - ax) * (cy - by) - (by - ay) * (cx - bx)
        if turn == 0:
            return False
        turns += 1 if turn > 0 else -1
        right = 1 if cx > bx or (cx == bx and cy > by) else -1
        flips += right == -last
        last = right
    return abs(turns) == n and flips <= 2


@lru_cache(64)
def _apart(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of edges of a ring that are not neighbours."""
    i, j = np.triu_indices(n, 2)
    keep = ~((i == 0) & (j == n - 1))
    return i[keep], j[keep]


def crosses(ring: np.ndarray) -> bool:
    """Whether two edges of a closed ring that are not neighbours meet, or neighbours lie on each other."""
    a, b = ring[:-1], ring[1:]
    n = len(a)
    if n < 4 or _is_convex(a.tolist()):
        return False
    i, j = _apart(n)

    def side(p, q, r):
        return np.sign((q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]))

    p, q, r, t = a[i], b[i], a[j], b[j]
    boxes = (np.maximum(np.minimum(p, q), np.minimum(r, t)) <= np.minimum(np.maximum(p, q), np.maximum(r, t))).all(1)
    if (boxes & (side(p, q, r) * side(p, q, t) <= 0) & (side(r, t, p) * side(r, t, q) <= 0)).any():
        return True
    d, e = b - a, np.roll(b - a, -1, 0)  # a spike turns back on itself
    return bool(((d[:, 0] * e[:, 1] == d[:, 1] * e[:, 0]) & ((d * e).sum(1) < 0)).any())


def simplify_safely(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """`simplify` with half the tolerance as long as a sound ring would come to cross itself; at last the ring itself."""
    if crosses(ring):
        return simplify(ring, tolerance)
    for _ in range(6):
        out = simplify(ring, tolerance)
        if not crosses(out):
            return out
        tolerance /= 2
    return ring


def sound(rings: Rings) -> list[Rings]:
    """The polygon, or its even-odd pieces if a ring of it crosses itself."""
    return [[t] for t in repaired([rings])] if any(crosses(r) for r in rings) else [rings]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, open."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(order):
        out: list[np.ndarray] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def principal_angle(points: np.ndarray) -> float:
    """Degrees of the longer side of the least rotated rectangle around the points."""
    h = hull(points)
    d = np.concatenate((h[1:], h[:1])) - h
    t = np.arctan2(d[:, 1], d[:, 0])
    c, s = np.cos(t), np.sin(t)
    along, across = h[:, :1] * c + h[:, 1:] * s, h[:, 1:] * c - h[:, :1] * s  # a column for each side
    wide, high = along.max(0) - along.min(0), across.max(0) - across.min(0)
    best, least = 0, np.inf
    for i, size in enumerate((wide * high).tolist()):  # the first of equal ones
        if size < least - 1e-12:
            best, least = i, size
    return float(np.degrees(t[best])) + (0.0 if wide[best] >= high[best] else 90.0)


def centroid(ring: np.ndarray) -> np.ndarray:
    a, b = ring[:-1], ring[1:]
    w = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]
    return ((a + b) * w[:, None]).sum(0) / (3 * w.sum())


def turned(ring: np.ndarray, degrees: float, origin: np.ndarray) -> np.ndarray:
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    return (ring - origin) @ np.array([[c, s], [-s, c]]) + origin


def snap(ring: np.ndarray) -> np.ndarray:
    """Edges made horizontal or vertical in turn (the numpy twin of the Column expression)."""
    pts = ring[:-1]
    out = [pts[0]]
    for p in [*pts[1:], pts[0]]:
        last = out[-1]
        out.append(np.array([p[0], last[1]] if abs(p[0] - last[0]) > abs(p[1] - last[1]) else [last[0], p[1]]))
    if np.abs(out[-1] - out[0]).max() > 1e-9:
        out.append(out[0])
    out[-1] = out[0]
    return np.array(out)


def ortho_snap(rings: Rings, tolerance: float = 0.5, min_area: float = 5.0) -> list[Rings]:
    """Simplified, turned to its main direction, snapped and turned back; the simplified polygon if snapping leaves too
    little, nothing if the polygon itself is too small. Results are sound: what crosses itself is cut to pieces."""
    plain = sound([simplify_safely(r, tolerance) for r in rings])
    if sum(polygon_area(p) for p in plain) < min_area:
        return []
    if len(plain) != 1:  # pieces of a ring that crossed itself have no main direction of their own
        return plain
    angle, middle = principal_angle(plain[0][0][:-1]), centroid(plain[0][0])
    snapped = sound([snap(turned(r, -angle, middle)) for r in plain[0]])
    if sum(polygon_area(p) for p in snapped) < min_area:
        return plain
    return [[turned(r, angle, middle) for r in p] for p in snapped]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def _moved(mask: np.ndarray, radius: int, outside: bool, any_: bool) -> np.ndarray:
    """Over the disk around each pixel of one mask or, along the first axis, of many."""
    h, w = mask.shape[-2:]
    pad = np.pad(mask, [(0, 0)] * (mask.ndim - 2) + [(radius, radius)] * 2, constant_values=outside)
    looks = [pad[..., radius + i : radius + i + h, radius + j : radius + j + w] for i, j in disk(radius)]
    return np.logical_or.reduce(looks) if any_ else np.logical_and.reduce(looks)


def eroded(mask: np.ndarray, radius: int) -> np.ndarray:
    return _moved(mask, radius, True, False)


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    return _moved(mask, radius, False, True)


def opened(mask: np.ndarray, radius: int) -> np.ndarray:
    return dilated(eroded(mask, radius), radius)


def closed(mask: np.ndarray, radius: int) -> np.ndarray:
    return eroded(dilated(mask, radius), radius)


def components(mask: np.ndarray) -> np.ndarray:
    """4-connected pieces of equal values above 0, numbered from 1 in scan order; 0 elsewhere."""
    h, w = mask.shape
    label = np.where(mask > 0, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        old = label.copy()
        for a, b in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            same = (mask[a] == mask[b]) & (mask[a] > 0)
            for x, y in ((a, b), (b, a)):
                part = label[x]
                part[same] = np.minimum(part[same], label[y][same])
        if np.array_equal(old, label):
            break
        flat = np.concatenate(([0], label.ravel()))
        label = np.where(label > 0, flat[label], 0)
    return np.searchsorted(np.unique(label[label > 0]), label) + (label > 0) if (label > 0).any() else label


def trace(label: np.ndarray) -> list[tuple[int, int, Rings]]:
    """(value, piece, rings) of the 4-connected pieces of each value above 0; rings run along pixel corners (x, y)."""
    out, pieces = [], components(label)
    number: dict[int, int] = {}
    for p in range(1, int(pieces.max()) + 1 if pieces.size else 1):
        mask = np.pad(pieces == p, 1)
        value = int(label[pieces == p][0])
        edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r, c in zip(*np.nonzero(mask)):
            y, x = r - 1, c - 1
            for on, a, b in ((mask[r - 1, c], (x, y), (x + 1, y)), (mask[r, c + 1], (x + 1, y), (x + 1, y + 1)), (mask[r + 1, c], (x + 1, y + 1), (x, y + 1)), (mask[r, c - 1], (x, y + 1), (x, y))):
                if not on:
                    edges.setdefault(a, []).append(b)
        rings: Rings = []
        while edges:
            at = min(edges)
            ring, came = [at], None
            while True:
                nexts = edges[at]
                # at a corner that two pixels share, turn so that the ring stays with its own pixel
                k = 0 if len(nexts) == 1 or came is None else min(range(len(nexts)), key=lambda i: -((nexts[i][1] - at[1]) * came[0] - (nexts[i][0] - at[0]) * came[1]))
                to = nexts.pop(k)
                if not nexts:
                    del edges[at]
                step = (to[0] - at[0], to[1] - at[1])
                if came == step:
                    ring[-1] = to
                else:
                    ring.append(to)
                at, came = to, step
                if at == ring[0]:
                    break
            rings.append(np.array(ring, float))
        rings.sort(key=lambda r: -abs(ring_area(r)))
        out.append((value, number.setdefault(value, 0), rings))
        number[value] += 1
    return out


def rasterize(polygons: list[Rings], height: int, width: int) -> np.ndarray:
    """Pixels whose centre lies inside a polygon."""
    out = np.zeros((height, width), bool)
    for rings in polygons:
        inside = np.zeros((height, width), bool)
        x = np.arange(width) + 0.5
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, r[1:]):
                for row in range(max(0, int(np.ceil(min(ay, by) - 0.5))), min(height, int(np.ceil(max(ay, by) - 0.5)))):
                    inside[row] ^= x > ax + (row + 0.5 - ay) * (bx - ax) / (by - ay)
        out |= inside
    return out


def co_occurrence(q: np.ndarray, levels: int = 32) -> dict[str, float]:
    a, b = q[:, :-1].ravel().astype(int), q[:, 1:].ravel().astype(int)
    m = np.bincount(a * levels + b, minlength=levels * levels).reshape(levels, levels).astype(float)
    m += m.T
    m /= m.sum() or 1
    i, j = np.indices(m.shape)
    mean = (m * i).sum()
    var = (m * (i - mean) ** 2).sum()
    return {
        "glcm_contrast": float((m * (i - j) ** 2).sum()), "glcm_homogeneity": float((m / (1 + (i - j) ** 2)).sum()), "glcm_asm": float((m * m).sum()),
        "glcm_correlation": float((m * (i - mean) * (j - mean)).sum() / var) if var > 1e-15 else 1.0, "glcm_dissimilarity": float((m * np.abs(i - j)).sum()),
    }


def binary_patterns(light: np.ndarray) -> np.ndarray:
    """Rotation-invariant uniform patterns of the 8 neighbours at distance 1 (bilinear; outside is 0): the number of
    ones, or 9 if they change more than twice around."""
    h, w = light.shape
    pad = np.pad(light, 2)
    bits = []
    for k in range(8):
        dy, dx = round(-np.sin(2 * np.pi * k / 8), 5), round(np.cos(2 * np.pi * k / 8), 5)
        y, x = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = dy - y, dx - x
        look = lambda i, j: pad[2 + i : 2 + i + h, 2 + j : 2 + j + w]
        v = (1 - fy) * (1 - fx) * look(y, x) + (1 - fy) * fx * look(y, x + 1) + fy * (1 - fx) * look(y + 1, x) + fy * fx * look(y + 1, x + 1)
        bits.append(v >= light - 1e-9)
    bits = np.array(bits)
    changes = (bits != np.roll(bits, 1, 0)).sum(0)
    return np.where(changes <= 2, bits.sum(0), 9)


def perimeter(mask: np.ndarray) -> float:
    """Length of the border's centre line: border pixels weigh 1 or sqrt 2 by their border neighbours. the
    weights by neighbourhood of the usual 4-connected perimeter estimate."""
    inner = eroded4(mask)
    border = np.pad(mask & ~inner, 1).astype(int)
    straight = border[:-2, 1:-1] + border[2:, 1:-1] + border[1:-1, :-2] + border[1:-1, 2:]
    slanted = border[:-2, :-2] + border[:-2, 2:] + border[2:, :-2] + border[2:, 2:]
    kind = border[1:-1, 1:-1] * (2 * straight + 10 * slanted + 1)
    weight = np.zeros(51)
    weight[[5, 7, 15, 17, 25, 27]] = 1
    weight[[21, 33]] = np.sqrt(2)
    weight[[13, 23]] = (1 + np.sqrt(2)) / 2
    return float(weight[np.minimum(kind, 50)].sum())


def eroded4(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1)
    return p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]


def solidity(mask: np.ndarray) -> float:
    """Pixels over the area of the hull of the pixels' squares."""
    y, x = np.nonzero(mask)
    corners = np.concatenate([np.stack((x + i, y + j), 1) for i in (0, 1) for j in (0, 1)])
    h = hull(corners)
    return float(mask.sum() / abs(ring_area(np.vstack([h, h[:1]]).astype(float))))


def segment_texture(light: np.ndarray, mask: np.ndarray) -> dict[str, float]:
    y, x = np.nonzero(mask)
    box = np.s_[y.min() : y.max() + 1, x.min() : x.max() + 1]
    light, mask = light[box], mask[box]
    out = {"perimeter_px": perimeter(mask), "solidity": solidity(mask)}
    names = ("glcm_contrast", "glcm_homogeneity", "glcm_asm", "glcm_correlation", "glcm_dissimilarity")
    if mask.sum() < 4:
        return out | dict.fromkeys(names, 0.0) | {f"lbp_h{i}": 0.0 for i in range(10)}
    whole = np.floor(light).astype(np.uint8)
    filled = np.where(mask, whole, np.uint8(whole[mask].mean()))
    out |= co_occurrence(filled // 8)
    share = np.bincount(binary_patterns(light)[mask], minlength=10) / mask.sum()
    return out | {f"lbp_h{i}": float(v) for i, v in enumerate(share)}


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIELAB (D65) of sRGB in 0..1."""
    lin = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    xyz = lin @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]]) / np.array([0.95047, 1.0, 1.08883])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack((116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])), -1)


def blurred(img: np.ndarray, sigma: float) -> np.ndarray:
    n = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        width = [(n, n) if a == axis else (0, 0) for a in range(img.ndim)]
        pad = np.pad(img, width, mode="symmetric" if img.shape[axis] >= n else "edge")
        img = sum(w * np.take(pad, np.arange(i, i + img.shape[axis]), axis) for i, w in enumerate(k))
    return img


def superpixels(rgb: np.ndarray, valid: np.ndarray, n_segments: int = 200, compactness: float = 15.0, sigma: float = 1.0, rounds: int = 10) -> np.ndarray:
    """Labels from 1 (0: not valid): k-means from a regular grid in (L, a, b, weighted place), then 4-connected
    pieces; pieces under a quarter of the mean size join their left or upper neighbour. Deterministic."""
    h, w = valid.shape
    colour = lab(blurred(rgb / 255, sigma) if sigma else rgb / 255)
    step = max(1.0, np.sqrt(h * w / max(1, n_segments)))
    ys, xs = np.meshgrid(np.arange(step / 2, h, step), np.arange(step / 2, w, step), indexing="ij")
    y, x = np.indices((h, w))
    feats = np.concatenate([colour, np.stack((y, x), -1) * (compactness / step)], -1)
    centres = feats[np.minimum(ys.astype(int), h - 1).ravel(), np.minimum(xs.astype(int), w - 1).ravel()]
    best = np.zeros((h, w), int)
    for _ in range(rounds):
        cost = np.full((h, w), np.inf)
        for k, c in enumerate(centres):
            cy, cx = c[3] * step / compactness, c[4] * step / compactness
            box = np.s_[max(0, int(cy - 2 * step)) : int(cy + 2 * step) + 1, max(0, int(cx - 2 * step)) : int(cx + 2 * step) + 1]
            d = ((feats[box] - c) ** 2).sum(-1)
            less = d < cost[box]
            cost[box][less] = d[less]
            best[box][less] = k
        n = np.bincount(best[valid], minlength=len(centres))
        for i in range(5):
            total = np.bincount(best[valid], feats[..., i][valid], minlength=len(centres))
            centres[:, i] = np.where(n > 0, total / np.maximum(n, 1), centres[:, i])
    piece = components(np.where(valid, best + 1, 0))
    size = np.bincount(piece.ravel())
    small = size < max(1, h * w / max(1, len(centres)) / 4)
    for p in np.flatnonzero(small[1:]) + 1:
        at = piece == p
        if not at.any():
            continue
        r, c = np.argwhere(at)[0]
        near = [piece[i, j] for i, j in ((r, c - 1), (r - 1, c)) if i >= 0 and j >= 0 and piece[i, j] > 0]
        if near:
            piece[at] = near[0]
    used = np.unique(piece[piece > 0])
    return np.where(piece > 0, np.searchsorted(used, piece) + 1, 0)
