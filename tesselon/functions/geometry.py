"""Planar geometry on lists of points: clipping, simplification, densifying, point in polygon, import of shapes."""

from __future__ import annotations

import math

import numpy as np

from tesselon.functions.coords import EARTH_RADIUS, WORLD

Ring = list[tuple[float, float]]
Box = tuple[float, float, float, float]


def to_mercator(lon: float, lat: float) -> tuple[float, float]:
    lat = min(85.05112877980659, max(-85.05112877980659, lat))
    return math.radians(lon) * EARTH_RADIUS, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * EARTH_RADIUS


def clip_segment(a, b, box: Box):
    """The part of a segment inside a box, by its entry and exit parameters; None if there is none."""
    (x0, y0), (x1, y1) = a, b
    low, high = 0.0, 1.0
    for delta, room_min, room_max in ((x1 - x0, box[0] - x0, box[2] - x0), (y1 - y0, box[1] - y0, box[3] - y0)):
        if delta == 0:
            if room_min > 0 or room_max < 0:
                return None
            continue
        enter, leave = sorted((room_min / delta, room_max / delta))
        low, high = max(low, enter), min(high, leave)
        if low > high:
            return None
    at = lambda t: (x0 + t * (x1 - x0), y0 + t * (y1 - y0))
    return at(low), at(high)


def clip_line(line: Ring, box: Box) -> list[Ring]:
    out: list[Ring] = []
    for a, b in zip(line, line[1:], strict=False):
        piece = clip_segment(a, b, box)
        if piece is None:
            continue
        if out and out[-1][-1] == piece[0]:
            out[-1].append(piece[1])
        else:
            out.append(list(piece))
    return [p for p in out if len(set(p)) > 1]


def clip_ring(ring: Ring, box: Box) -> Ring:
    """A closed ring cut to a box, side by side."""
    points = ring[:-1] if ring and ring[0] == ring[-1] else list(ring)
    if not points:
        return []
    for axis, bound, keep_above in ((0, box[0], True), (0, box[2], False), (1, box[1], True), (1, box[3], False)):
        ends = [p[axis] for p in points]
        if (min(ends) >= bound) if keep_above else (max(ends) <= bound):
            continue
        if (max(ends) < bound) if keep_above else (min(ends) > bound):
            return []
        inside = (lambda p: p[axis] >= bound) if keep_above else (lambda p: p[axis] <= bound)  # noqa: B023
        out: Ring = []
        for i, here in enumerate(points):
            before = points[i - 1]
            if inside(here) != inside(before):
                other = 1 - axis
                along = before[other] + (bound - before[axis]) / (here[axis] - before[axis]) * (here[other] - before[other])
                out.append((along, bound) if axis else (bound, along))
            if inside(here):
                out.append(here)
        points = out
        if not points:
            return []
    return [*points, points[0]] if len(points) > 2 else []


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at ``starts``, one run behind another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def clip_rings(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, boxes: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``clip_ring`` for many rings at once: points of all rings, the number of each ring's, and four arrays of the boxes'
    ends, one box a ring. What is left are open rings."""
    starts = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    a, b = starts[some], (starts + sizes - 1)[some]
    closed = (x[a] == x[b]) & (y[a] == y[b])
    keep = np.ones(len(x), bool)
    keep[b[closed]] = False
    x, y, sizes = x[keep], y[keep], sizes.copy()
    sizes[some] -= closed
    for axis, side, keep_above in ((0, 0, True), (0, 2, False), (1, 1, True), (1, 3, False)):
        p, q = (y, x) if axis else (x, y)
        bound = np.repeat(boxes[side], sizes)
        inside = p >= bound if keep_above else p <= bound
        if inside.all():
            continue
        ends = np.cumsum(sizes)
        starts, some = ends - sizes, sizes > 0
        before = np.arange(len(p)) - 1
        before[starts[some]] = ends[some] - 1
        cross = inside != inside[before]
        number = cross.astype(np.int64) + inside
        place = np.concatenate([[0], np.cumsum(number)])
        c, i = np.flatnonzero(cross), np.flatnonzero(inside)
        u, v = np.empty(place[-1]), np.empty(place[-1])
        pb, qb = p[before[c]], q[before[c]]
        u[place[c]], v[place[c]] = bound[c], qb + (bound[c] - pb) / (p[c] - pb) * (q[c] - qb)
        at = place[i] + cross[i]
        u[at], v[at] = p[i], q[i]
        sizes = place[ends] - place[starts]
        x, y = (v, u) if axis else (u, v)
    thin = sizes < 3
    if thin.any():
        keep = np.repeat(~thin, sizes)
        x, y, sizes = x[keep], y[keep], np.where(thin, 0, sizes)
    return x, y, sizes


def ring_sizes(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, x0: np.ndarray, y0: np.ndarray) -> np.ndarray:
    """Areas of open rings, each measured from a point of its own."""
    out = np.zeros(len(sizes))
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.cumsum(sizes) - sizes
        dx, dy = x - np.repeat(x0, sizes), y - np.repeat(y0, sizes)
        after = np.arange(len(x)) + 1
        after[(starts + sizes - 1)[some]] = starts[some]
        out[some] = np.abs(np.add.reduceat(dx * dy[after] - dx[after] * dy, starts[some])) / 2
    return out


def simplify(line: Ring, tolerance: float) -> Ring:
    """Douglas and Peucker's reduction; end points stay."""
    if len(line) < 3 or tolerance <= 0:
        return line
    points = np.asarray(line, float)
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        base, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = float(base @ base)
        along = np.clip(inner @ base / length, 0, 1) if length else np.zeros(len(inner))
        off = np.hypot(*(inner - along[:, None] * base).T)
        far = int(off.argmax())
        if off[far] > tolerance:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return [line[i] for i in np.flatnonzero(keep)]


def densify(line: Ring, step: float) -> Ring:
    out = line[:1]
    for a, b in zip(line, line[1:], strict=False):
        n = max(1, math.ceil(math.dist(a, b) / step))
        out += [(a[0] + (b[0] - a[0]) * i / n, a[1] + (b[1] - a[1]) * i / n) for i in range(1, n + 1)]
    return out


def area(ring: Ring) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))) / 2


def length(line: Ring) -> float:
    return sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False))


def point_in_rings(x: float, y: float, rings: list[Ring]) -> bool:
    """Even-odd rule."""
    inside = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                inside = not inside
    return inside


def rings_distance(x: float, y: float, rings: list[Ring]) -> float:
    """Distance of a point to the nearest edge."""
    best = math.inf
    for ring in rings:
        p = np.asarray(ring, float)
        a, d = p[:-1], np.diff(p, axis=0)
        n = (d * d).sum(axis=1)
        t = np.clip((((x, y) - a) * d).sum(axis=1) / np.where(n > 0, n, 1), 0, 1)
        best = min(best, float(np.hypot(*((x, y) - a - t[:, None] * d).T).min()))
    return best


def edges_distance(x: float, y: float, edges: np.ndarray) -> float:
    """Distance of a point to the nearest of the edges (x0, y0, x1, y1)."""
    a, d = edges[:, :2], edges[:, 2:] - edges[:, :2]
    n = (d * d).sum(axis=1)
    t = np.clip((((x, y) - a) * d).sum(axis=1) / np.where(n > 0, n, 1), 0, 1)
    return float(np.hypot(*((x, y) - a - t[:, None] * d).T).min())


def inside_rows(xs: np.ndarray, ys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each place of a raster, rows ys by columns xs in rising order, whether it is inside by the even-odd rule.
    Each row is crossed once; only edges at its height are looked at."""
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    some = edges[(low <= ys.max()) & (high >= ys.min()) & (low < high)]
    out = np.zeros((len(ys), len(xs)), bool)
    for j, y in enumerate(ys):
        x0, y0, x1, y1 = some[(some[:, 1] > y) != (some[:, 3] > y)].T
        crossings = np.sort((x1 - x0) * (y - y0) / (y1 - y0) + x0)
        out[j] = (len(crossings) - np.searchsorted(crossings, xs, "right")) % 2 == 1
    return out


def near_distances(xs: np.ndarray, ys: np.ndarray, edges: np.ndarray, far: float) -> np.ndarray:
    """Distance of each place of a raster, columns rising and rows falling, to the nearest edge; infinite where that
    is beyond ``far``. An edge is measured only from the places around it."""
    out = np.full((len(ys), len(xs)), np.inf)
    left, right = np.minimum(edges[:, 0], edges[:, 2]) - far, np.maximum(edges[:, 0], edges[:, 2]) + far
    low, high = np.minimum(edges[:, 1], edges[:, 3]) - far, np.maximum(edges[:, 1], edges[:, 3]) + far
    i0, i1 = np.searchsorted(xs, left), np.searchsorted(xs, right, "right")
    j0, j1 = np.searchsorted(-ys, -high), np.searchsorted(-ys, -low, "right")
    for k in np.flatnonzero((i0 < i1) & (j0 < j1)):
        x0, y0, x1, y1 = edges[k]
        x, y = xs[i0[k] : i1[k]][None, :], ys[j0[k] : j1[k]][:, None]
        dx, dy = x1 - x0, y1 - y0
        n = dx * dx + dy * dy
        t = np.clip(((x - x0) * dx + (y - y0) * dy) / (n if n > 0 else 1), 0, 1)
        part = out[j0[k] : j1[k], i0[k] : i1[k]]
        np.minimum(part, np.hypot(x - x0 - t * dx, y - y0 - t * dy), out=part)
    out[out > far] = np.inf
    return out


def tile_box(z: int, x: int, y: int) -> Box:
    """Mercator box of a tile."""
    w = WORLD / 2**z
    return (x * w - WORLD / 2, WORLD / 2 - (y + 1) * w, (x + 1) * w - WORLD / 2, WORLD / 2 - y * w)


def box_tiles(box: Box, z: int) -> tuple[int, int, int, int]:
    """Tiles (x0, y0, x1, y1) that a Mercator box touches, clamped to the level."""
    n, w = 2**z, WORLD / 2**z
    clamp = lambda v: min(n - 1, max(0, math.floor(v)))
    return clamp((box[0] + WORLD / 2) / w), clamp((WORLD / 2 - box[3]) / w), clamp((box[2] + WORLD / 2) / w), clamp((WORLD / 2 - box[1]) / w)


def shape_parts(geometry: dict) -> tuple[int, list[Ring]]:
    """(1 point, 2 line, 3 polygon; Mercator parts) of a GeoJSON geometry. Rings are closed."""
    kind, c = geometry["type"], geometry["coordinates"]
    flat = lambda line: [to_mercator(*p[:2]) for p in line]
    if kind == "Point":
        return 1, [flat([c])]
    if kind == "MultiPoint":
        return 1, [flat([p]) for p in c]
    if kind == "LineString":
        return 2, [flat(c)]
    if kind == "MultiLineString":
        return 2, [flat(part) for part in c]
    if kind in ("Polygon", "MultiPolygon"):
        rings = [flat(r) for poly in (c if kind == "MultiPolygon" else [c]) for r in poly]
        return 3, [r if r[0] == r[-1] else [*r, r[0]] for r in rings if r]
    raise ValueError(f"geometry {kind}")


def draw(kind: int, parts: list[Ring], z: int, x: int, y: int, extent: int = 4096, buffer: int = 80, tolerance: float = 4.0) -> list[list[tuple[int, int]]]:
    """Parts cut to a tile and its buffer, in whole units of the extent with y to the south."""
    box = tile_box(z, x, y)
    unit = (box[2] - box[0]) / extent
    wide = (box[0] - buffer * unit, box[1] - buffer * unit, box[2] + buffer * unit, box[3] + buffer * unit)
    if kind == 1:
        cut = [p for p in parts if wide[0] <= p[0][0] <= wide[2] and wide[1] <= p[0][1] <= wide[3]]
    elif kind == 2:
        cut = [c for p in parts for c in clip_line(simplify(p, tolerance * unit), wide)]
    else:
        cut = [c for p in parts if (c := clip_ring(simplify(p, tolerance * unit), wide))]
    out = []
    for part in cut:
        grid = [(math.floor((px - box[0]) / unit + 0.5), math.floor((box[3] - py) / unit + 0.5)) for px, py in part]
        slim = [p for i, p in enumerate(grid) if i == 0 or p != grid[i - 1]]
        if kind == 1 or kind == 2 and len(slim) > 1:
            out.append(slim)
        elif kind == 3 and len(slim) > 3:
            out.append(slim)
    return out
