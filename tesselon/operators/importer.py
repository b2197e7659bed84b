"""Import of shapes: levels that follow from one another, a quadtree cover, and properties that are joined last.

A planar shape is a row (index, kind, parts): its place in the input, 1 point, 2 line or 3 polygon, and lists of Mercator
points [x, y], the rings of a polygon closed and its outer one first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions import geometry as G
from tesselon.operators.borders import simplify_arcs
from tesselon.operators.stored import forget, maybe_broadcast, private_names, store
from tesselon.operators.thinning import thin_by_distance

PARTS = "array<array<array<double>>>"
#: Levels of the quadtree that a task goes down before pieces are dealt anew.
STRIDE = 3
POINT, LINE, AREA = 1, 2, 3
_PIECE = (("index", pa.int64()), ("kind", pa.int32()), ("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("whole", pa.bool_()), ("cut", pa.bool_()), ("parts", pa.list_(pa.list_(pa.list_(pa.float64())))))


def indexed(rows: DataFrame, name: str = "index") -> DataFrame:
    """The rows, stored, numbered from 0 in the order in which they are read: partitions are counted, not sorted."""
    own = private_names([*rows.columns, name], "at", "part", "before")
    at, part, before = own
    kept = store(rows.withColumn(at, F.monotonically_increasing_id()))
    number = F.shiftright(at, 33).alias(part)
    sizes = kept.groupBy(number).agg(F.count(F.lit(1)).alias("n"))
    sizes = store(sizes.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before)))
    out = kept.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(sizes), part)
    return store(out.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(*own))


def planar(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(planar shapes, attributes (index, id, props)) of shapes (id, geometry GeoJSON text, props). Each part of a
    multiple geometry is a shape of its own with the same id and properties. Rows without a geometry go."""

    kinds = (pa.int64(), pa.map_(pa.string(), pa.string()), pa.int32(), _PIECE[-1][1])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, geometry, props in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shape = json.loads(geometry)
                kind, c = shape["type"], shape["coordinates"]
                for one in [{"type": kind[5:], "coordinates": x} for x in c] if kind.startswith("Multi") else [shape]:
                    which, parts = G.shape_parts(one)
                    rows.append((id_, props, which, parts))
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "props", "kind", "parts"])

    rows = indexed(shapes.where("geometry IS NOT NULL").select(F.col("id").cast("bigint"), "geometry", "props").mapInArrow(split, f"id long, props map<string,string>, kind int, parts {PARTS}"))
    return rows.select("index", "kind", "parts"), rows.select("index", "id", "props")


# --- measures ------------------------------------------------------------------------------------


def _edges(part: Column, term) -> Column:
    """Sum of a term of each two points that follow one another."""
    steps = F.zip_with(F.slice(part, 1, F.greatest(F.size(part) - 1, F.lit(0))), F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), term(a, b)))
    return F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)


def line_length(parts: Column) -> Column:
    return F.aggregate(F.transform(parts, lambda p: _edges(p, lambda a, b: F.hypot(b[0] - a[0], b[1] - a[1]))), F.lit(0.0), lambda acc, v: acc + v)


def polygon_area(parts: Column) -> Column:
    """Area of the outer ring less those of the holes, measured from the first point."""
    ring = lambda p: F.abs(_edges(p, lambda a, b: (a[0] - p[0][0]) * (b[1] - p[0][1]) - (b[0] - p[0][0]) * (a[1] - p[0][1]))) / 2
    return F.aggregate(F.transform(parts, lambda p, i: F.when(i == 0, ring(p)).otherwise(-ring(p))), F.lit(0.0), lambda acc, v: acc + v)


def unit_of(level: int, extent: int = 4096) -> float:
    """Metres of the Mercator plane for a unit of a tile's extent."""
    return G.WORLD / 2**level / extent


# --- the cascade ---------------------------------------------------------------------------------


def keep_share(index: Column, ratio: float) -> Column:
    """True for a share of all indexes, the same ones at every level: the high 53 bits of their splitmix64."""

    @F.pandas_udf("boolean")
    def keep(number: pd.Series) -> pd.Series:
        # The generator's step and the factors of its finaliser.
        x = number.to_numpy(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return pd.Series(((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53) < ratio)

    return keep(index)


def _junctions(shapes: DataFrame) -> DataFrame:
    """(index, fixed): for each shape its points that have not exactly two neighbours over all shapes, or end a line."""
    part = shapes.where(F.col("kind") != POINT).select("index", F.explode("parts").alias("p")).where("size(p) > 1")
    place = lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.array(F.struct(place(a).alias("a"), place(b).alias("b")), F.struct(place(b).alias("a"), place(a).alias("b"))))
    nothing = F.lit(None).cast("struct<x: double, y: double>")
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    ends = F.when(first != last, F.array(*[F.struct(place(v).alias("a"), nothing.alias("b")) for v in (first, last)])).otherwise(F.array().cast("array<struct<a: struct<x: double, y: double>, b: struct<x: double, y: double>>>"))
    steps = part.select(F.explode(F.concat(F.flatten(pairs), ends)).alias("s")).select("s.a", "s.b").distinct()
    open_ = steps.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count("b").alias("k")).where("k <> 2 OR n <> k").select("a")
    touched = part.select("index", F.explode(F.transform("p", place)).alias("a")).distinct()
    return touched.join(open_, "a").groupBy("index").agg(F.collect_list("a").alias("fixed"))


def _simplified(shapes: DataFrame, tolerance: float) -> DataFrame:
    """Lines and rings between fixed points, simplified alike wherever they occur. Rings that fall together go."""

    @F.arrow_udf(PARTS)
    def slim(parts: pa.Array, fixed: pa.Array) -> pa.Array:
        out = []
        for shape, points in zip(parts.to_pylist(), fixed.to_pylist(), strict=True):
            known = {(p["x"], p["y"]) for p in points or ()}
            out.append([simplify_arcs(part, known, tolerance) if len(part) > 2 else part for part in shape])
        return pa.array(out, _PIECE[-1][1])

    return shapes.withColumn("parts", slim("parts", "fixed"))


def _kept_alike(shapes: DataFrame, levels: range, min_area: float, min_length: float, ratio: float) -> dict[int, DataFrame]:
    """The levels of a cascade in which shapes stay as they are: they are measured and stored once, with the deepest level's
    points and shapes, and each level is what of that table is large enough for it."""
    kind = F.col("kind")
    size = private_names(["index", "kind", "parts"], "size")[0]
    kept = shapes.withColumn(size, F.when(kind == LINE, line_length(F.col("parts"))).when(kind == AREA, polygon_area(F.col("parts"))))

    def fits(level: int) -> Column:
        unit = unit_of(level)
        return (kind == POINT) | (kind == LINE) & (F.col(size) >= min_length * unit) | (kind == AREA) & (F.col(size) >= min_area * unit * unit)

    if not levels:
        return {}
    if ratio < 1:
        kept = kept.where((kind != POINT) | keep_share(F.col("index"), ratio))
    stored = store(kept.where(fits(max(levels))))
    out = {}
    for level in reversed(levels):
        out[level] = stored.where(fits(level)).select("index", "kind", "parts")
        out[level]._stored = stored._stored
    return out


def cascade(shapes: DataFrame, levels: range, polygon_simplify: float = 4.0, line_simplify: float = 4.0, polygon_min_area: float = 4.0, line_min_length: float = 4.0, point_reduction: str = "min_distance", point_value: float | None = None) -> dict[int, DataFrame]:
    """The planar shapes that are left at each level, a stored table a level, from the deepest up, or one for all where shapes stay as they are.

    Each level reads what the finer one kept: it simplifies that to its own tolerance, drops lines and polygons
    below its own length and area, and thins its points by its own distance, all in units of a tile's
    extent. So a shape that goes is gone from all levels above, and tables shrink. Points that shapes share as
    junctions are found once and stay, so common borders stay common; lines and polygons have one tolerance, the smaller one
    that is not 0. point_reduction is none, drop_rate (keeps ``point_value``, 0.5, of all, by a hash of the index) or
    min_distance (``point_value``, 16 units, in the order of the index).
    """
    if point_reduction not in ("none", "drop_rate", "min_distance"):
        raise ValueError("point_reduction is none, drop_rate or min_distance")
    if point_value is None:
        point_value = 0.5 if point_reduction == "drop_rate" else 16.0
    tolerance = min((t for t in (polygon_simplify, line_simplify) if t > 0), default=0.0)
    now = shapes.select("index", "kind", "parts")
    if tolerance > 0:
        now = now.join(_junctions(now), "index", "left")
    if tolerance == 0 and point_reduction != "min_distance":
        return _kept_alike(now, levels, polygon_min_area, line_min_length, point_value if point_reduction == "drop_rate" else 1.0)
    out: dict[int, DataFrame] = {}
    for level in reversed(levels):
        unit = unit_of(level)
        if tolerance > 0:
            now = _simplified(now, tolerance * unit)
        kind = F.col("kind")
        fits = (kind == POINT) | (kind == LINE) & (line_length(F.col("parts")) >= line_min_length * unit) | (kind == AREA) & (polygon_area(F.col("parts")) >= polygon_min_area * unit * unit)
        now = now.where(fits)
        if point_reduction == "drop_rate" and point_value < 1:
            now = now.where((kind != POINT) | keep_share(F.col("index"), point_value))
        elif point_reduction == "min_distance" and point_value > 0:
            now = store(now)
            spots = now.where(kind == POINT).select("index", F.col("parts")[0][0][0].alias("mx"), F.col("parts")[0][0][1].alias("my"))
            kept = store(thin_by_distance(spots, point_value * unit, "index").select(F.col("index").alias("kept")))
            points = now.where(kind == POINT).join(maybe_broadcast(kept, 8), F.col("index") == F.col("kept"), "left_semi")
            now = now.where(kind != POINT).unionByName(points)
        now = out[level] = store(now)
    return out


# --- the cover -----------------------------------------------------------------------------------


def _local(ring: list, x: float, y: float) -> float:
    """Signed area of a ring, measured from a point nearby."""
    total, before = 0.0, None
    for px, py in ring:
        here = px - x, py - y
        if before:
            total += before[0] * here[1] - here[0] * before[1]
        before = here
    return total / 2


def piece_in(kind: int, parts: list, box: tuple) -> tuple[bool, list]:
    """(whether a polygon covers the box wholly, the parts of a shape within a box); no parts if it does not meet it.
    Polygons meet a box if they share some area with it, lines if they share some length."""
    if kind == POINT:
        return False, [p for p in parts if box[0] <= p[0][0] <= box[2] and box[1] <= p[0][1] <= box[3]]
    if kind == LINE:
        return False, [c for p in parts for c in G.clip_line(p, box)]
    full = (box[2] - box[0]) * (box[3] - box[1])
    rings, around, total = [], 0, 0.0
    for n, ring in enumerate(parts):
        cut = G.clip_ring(ring, box)
        size = abs(_local(cut, box[0], box[1])) if cut else 0.0
        if size <= full * 1e-15:
            continue
        rings.append(cut)
        around += size >= full * (1 - 1e-12)
        total += size if n == 0 else -size
    if total <= full * 1e-15:
        return False, []
    return around == len(rings) == 1, rings


def _boxes(rows: DataFrame, level: int, margin: float) -> DataFrame:
    """Each shape at the cells of the deepest level, at most the given one, at which its box spans three of them a side at most."""
    ends = lambda axis, f: f(F.transform(F.flatten("parts"), lambda p: p[axis]))
    rows = rows.withColumns({"x0": ends(0, F.array_min) - margin, "x1": ends(0, F.array_max) + margin, "y0": ends(1, F.array_min) - margin, "y1": ends(1, F.array_max) + margin})
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    start = F.when(wide <= 0, level).otherwise(F.greatest(F.lit(0), F.least(F.lit(level), F.floor(F.log2(F.lit(2 * G.WORLD) / wide))))).cast("int")
    rows = rows.withColumn("z", start)
    half = G.WORLD / 2
    side = F.pow(F.lit(2.0), "z")
    cell = lambda v: F.greatest(F.lit(0.0), F.least(side - 1, F.floor(v * side / G.WORLD))).cast("bigint")
    rows = rows.withColumn("x", F.explode(F.sequence(cell(F.col("x0") + half), cell(F.col("x1") + half))))
    return rows.withColumn("y", F.explode(F.sequence(cell(half - F.col("y1")), cell(half - F.col("y0"))))).drop("x0", "x1", "y0", "y1")


class _Pieces:
    """Pieces of polygons: numbers of each piece by name, the number of its rings, the number of each ring's points, and all points."""

    def __init__(self, numbers: dict[str, np.ndarray], rings: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.numbers, self.rings, self.sizes, self.x, self.y = numbers, rings, sizes, x, y

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> _Pieces:
        parts = batch.column("parts")
        whole = parts.offsets.to_numpy()
        ring = parts.values.offsets.to_numpy()[whole[0] : whole[-1] + 1]
        points = parts.values.values
        at = points.offsets.to_numpy()[ring[0] : ring[-1]]
        values = points.values.to_numpy(zero_copy_only=False)
        numbers = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("index", "z", "x", "y", "cut")}
        return cls(numbers | {"top": numbers["z"]}, np.diff(whole).astype(np.int64), np.diff(ring).astype(np.int64), values[at], values[at + 1])

    def take(self, which: np.ndarray) -> _Pieces:
        """The pieces of these numbers, which may repeat."""
        rings = self.rings[which]
        at = G.runs((np.cumsum(self.rings) - self.rings)[which], rings)
        sizes = self.sizes[at]
        points = G.runs((np.cumsum(self.sizes) - self.sizes)[at], sizes)
        return _Pieces({n: v[which] for n, v in self.numbers.items()}, rings, sizes, self.x[points], self.y[points])

    def children(self) -> _Pieces:
        n = len(self.rings)
        out = self.take(np.repeat(np.arange(n), 4))
        for name, bit in (("x", np.tile([0, 0, 1, 1], n)), ("y", np.tile([0, 1, 0, 1], n))):
            out.numbers[name] = 2 * out.numbers[name] + bit
        out.numbers["z"] = out.numbers["z"] + 1
        return out

    def clipped(self, margin: float) -> tuple[_Pieces, np.ndarray]:
        """What of each piece lies in its cell, without those that do not meet it, and whether the cell is covered: ``piece_in``."""
        width = G.WORLD / np.exp2(self.numbers["z"])
        half, x, y = G.WORLD / 2, self.numbers["x"], self.numbers["y"]
        box = x * width - half - margin, half - (y + 1) * width - margin, (x + 1) * width - half + margin, half - y * width + margin
        n = len(self.rings)
        owner = np.repeat(np.arange(n), self.rings)
        outer = G.runs(np.zeros(n, np.int64), self.rings) == 0
        mine = [b[owner] for b in box]
        x, y, sizes = G.clip_rings(self.x, self.y, self.sizes, mine)
        full = ((box[2] - box[0]) * (box[3] - box[1]))[owner]
        size = G.ring_sizes(x, y, sizes, mine[0], mine[1])
        kept = size > full * 1e-15
        total = np.bincount(owner, np.where(kept, np.where(outer, size, -size), 0.0), n)
        around = np.bincount(owner, kept & (size >= full * (1 - 1e-12)), n)
        rings = np.bincount(owner, kept, n).astype(np.int64)
        met = total > (box[2] - box[0]) * (box[3] - box[1]) * 1e-15
        kept &= met[owner]
        on = np.repeat(kept, sizes)
        out = _Pieces({k: v[met] for k, v in self.numbers.items()}, rings[met], sizes[kept], x[on], y[on])
        return out, ((around == 1) & (rings == 1))[met]

    def closed(self, bare: np.ndarray) -> pa.Array:
        """Parts in which each ring ends with its first point; nothing for the bare pieces."""
        held = self.take(np.flatnonzero(~bare))
        n, starts = len(held.x), np.cumsum(held.sizes) - held.sizes
        place = np.arange(n) + np.repeat(np.arange(len(held.sizes)), held.sizes)
        values = np.empty((n + len(held.sizes), 2))
        values[place, 0], values[place, 1] = held.x, held.y
        ends = np.cumsum(held.sizes + 1)
        values[ends - 1, 0], values[ends - 1, 1] = held.x[starts], held.y[starts]
        whole = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        points = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * 2, pa.int32()), values.ravel())
        rings = pa.ListArray.from_arrays(whole(held.sizes + 1), points)
        return pa.ListArray.from_arrays(whole(np.where(bare, 0, self.rings)), rings, mask=pa.array(bare))


#: Shapes that go down the quadtree together in numpy, and cells that a task looks at together.
TOGETHER = 2048


def _go_down(pieces: _Pieces, level: int, margin: float, deep: int, keep_parts: bool) -> Iterator[pa.RecordBatch]:
    cut = pieces.numbers["cut"] > 0
    todo = [pieces.take(np.flatnonzero(~cut)), pieces.take(np.flatnonzero(cut)).children()]
    while todo:
        now = todo.pop()
        if len(now.rings) > 4 * TOGETHER:
            halves = np.array_split(np.arange(len(now.rings)), 2)
            todo += [now.take(h) for h in halves]
            continue
        now, whole = now.clipped(margin)
        n = now.numbers
        ends = whole | (n["z"] == level) | (n["z"] - n["top"] == deep)
        rest = now.take(np.flatnonzero(~ends))
        if len(rest.rings):
            todo.append(rest.children())
        if ends.any():
            done, covered = now.take(np.flatnonzero(ends)), whole[ends]
            n, k = done.numbers, len(covered)
            bare = covered | (n["z"] == level) if not keep_parts else covered
            columns = (n["index"], np.full(k, AREA), n["z"], n["x"], n["y"], covered, np.ones(k, bool))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, (_, t) in zip(columns, _PIECE, strict=False)), done.closed(bare)], names=[c for c, _ in _PIECE])


def _descend(level: int, margin: float, deep: int, keep_parts: bool = True):
    """Goes down up to ``deep`` levels: a piece goes on to the children that it meets, a whole cell stays as it is. Polygons
    go together, a level at a time; points and lines one by one."""

    def box_of(z: int, x: int, y: int) -> tuple:
        b = G.tile_box(z, x, y)
        return b[0] - margin, b[1] - margin, b[2] + margin, b[3] + margin

    def one_by_one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            index, kind, top = row[:3]
            todo = [(*row[2:5], row[7], row[6])]
            while todo:
                z, x, y, parts, cut = todo.pop()
                whole = False
                if not cut:
                    whole, parts = piece_in(kind, parts, box_of(z, x, y))
                    if not parts:
                        continue
                if whole or z == level or z - top == deep:
                    rows.append((index, kind, z, x, y, whole, True, None if whole or z == level and not keep_parts else parts))
                else:
                    todo += [(z + 1, 2 * x + i, 2 * y + j, parts, False) for i in (0, 1) for j in (0, 1)]
        columns = zip(*rows, strict=True) if rows else ((),) * len(_PIECE)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _PIECE, strict=True)], names=[n for n, _ in _PIECE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                areas = np.equal(batch.column("kind").to_numpy(zero_copy_only=False), AREA)
                if areas.any():
                    yield from _go_down(_Pieces.read(batch.filter(pa.array(areas))), level, margin, deep, keep_parts)
                if not areas.all():
                    yield one_by_one(batch.filter(pa.array(~areas)))

    return run


def cover(shapes: DataFrame, level: int, margin: float = 0.0, keep_parts: bool = True) -> DataFrame:
    """(index, kind, z, x, y, whole, parts): the tiles of a level that planar shapes meet, with what lies within.

    Tiles are taken with ``margin`` metres on all sides. A cell of any level up to the given one that a polygon
    covers is one row with whole and without parts, and stands for all tiles below; so the rows of a polygon grow
    with its border, not its area, and a piece carries only its own points. Shapes begin at cells of about their own
    size; from there the quadtree is gone down in strides, after each of which pieces are stored and those that have
    still to go deeper dealt anew. Without ``keep_parts`` only the tiles are told, and parts are null.
    """
    start = _boxes(shapes.select("index", "kind", "parts").where("size(parts) > 0"), level, margin)
    now = start.select("index", "kind", "z", "x", "y", F.lit(False).alias("whole"), F.lit(False).alias("cut"), "parts")
    schema = f"index bigint, kind int, z int, x bigint, y bigint, whole boolean, cut boolean, parts {PARTS}"
    tasks = max(8, int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    done: list[DataFrame] = []
    while True:
        # A piece is a few numbers and much work: as many tasks as there are partitions, however few its bytes.
        made = store(now.repartition(tasks, "index", "z", "x", "y").mapInArrow(_descend(level, margin, STRIDE, keep_parts), schema))
        ends = F.col("whole") | (F.col("z") == level)
        done.append(made.where(ends))
        now = made.where(~ends)
        if now.isEmpty():
            return reduce(DataFrame.unionByName, done).drop("cut")


def tiles_met(covered: DataFrame, tiles: DataFrame, level: int) -> DataFrame:
    """(index, x, y) for each tile (x, y) of a level and shape that meet: a cell of the cover is a range of columns and rows."""
    return _in_ranges(_cell_ranges(covered, level), tiles, level)


def tiles_of(shapes: DataFrame, tiles: DataFrame, level: int, margin: float = 0.0) -> DataFrame:
    """``tiles_met`` of the cover of planar shapes. An upright rectangle needs no cover: its columns and rows are two
    ranges between its sides. Other shapes go down the quadtree, if there are any."""
    mine = private_names(["index", "kind", "parts"], "mine")[0]
    found = shapes.select("index", "kind", "parts", _rectangle_ranges(level, margin)("kind", "parts").alias(mine))
    ends = [F.get(mine, F.lit(i)).alias(n) for i, n in enumerate(("x0", "x1", "y0", "y1"))]
    ranges = found.where(F.col(mine).isNotNull()).select("index", *ends).where("x0 <= x1 AND y0 <= y1")
    others = store(found.where(F.col(mine).isNull()).drop(mine))
    if not others.isEmpty():
        ranges = ranges.unionByName(_cell_ranges(cover(others, level, margin, keep_parts=False), level))
    return _in_ranges(ranges, tiles, level)


def _met_between(low: np.ndarray, high: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last column of a level that share some width with what lies between two places, by the ends of the columns
    themselves; the first is beyond the last if none does."""
    width, half, n = G.WORLD / 2**level, G.WORLD / 2, 1 << level
    near = lambda v: np.floor(np.clip((v + half) / width, -1, n)).astype(np.int64)
    west = lambda c: c * width - half
    a, b = near(low), near(high)
    first = a + (west(a + 1) <= low) - (west(a) > low)
    last = b - (west(b) >= high) + (west(b + 1) < high)
    return np.maximum(first, 0), np.minimum(last, n - 1)


def _rectangle_ranges(level: int, margin: float):
    """First and last column and row of the tiles that an upright rectangle meets, null for every other shape."""

    @F.arrow_udf("array<bigint>")
    def ranges(kind: pa.Array, parts: pa.Array) -> pa.Array:
        sizes = lambda lists: lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = np.flatnonzero((kind.fill_null(0).to_numpy(zero_copy_only=False) == AREA) & (sizes(parts) == 1))
        rings = parts.take(pa.array(at)).flatten()
        five = np.flatnonzero(sizes(rings) == 5)
        points = rings.take(pa.array(five)).flatten()
        flat = (sizes(points) == 2).reshape(-1, 5).all(axis=1)
        at, points = at[five][flat], points.filter(pa.array(np.repeat(flat, 5)))
        p = points.flatten().to_numpy(zero_copy_only=False).reshape(-1, 5, 2)
        same = p[:, :4] == p[:, 1:]
        turned = (same == [[0, 1], [1, 0], [0, 1], [1, 0]]).all(axis=(1, 2)) | (same == [[1, 0], [0, 1], [1, 0], [0, 1]]).all(axis=(1, 2))
        low, high = p.min(axis=1), p.max(axis=1)
        box = turned & (p[:, 0] == p[:, 4]).all(axis=1) & np.isfinite(high - low).all(axis=1)
        at, low, high = at[box], low[box] - margin, high[box] + margin
        ends = np.stack([*_met_between(low[:, 0], high[:, 0], level), *_met_between(-high[:, 1], -low[:, 1], level)], axis=1)
        mask = np.ones(len(kind), bool)
        mask[at] = False
        offsets = np.concatenate([[0], np.cumsum(np.where(mask, 0, 4))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ends.ravel(), pa.int64()), mask=pa.array(mask))

    return ranges


def _cell_ranges(covered: DataFrame, level: int) -> DataFrame:
    first = lambda c: F.expr(f"shiftleft({c}, {level} - z)")
    last = lambda c: F.expr(f"shiftleft({c} + 1, {level} - z) - 1")
    return covered.select("index", first("x").alias("x0"), last("x").alias("x1"), first("y").alias("y0"), last("y").alias("y1"))


def _grids(level: int) -> list[tuple[int, int]]:
    """Blocks of 2**a rows and 2**b columns in which tiles and ranges of one size meet, from fine to coarse."""
    return [(2, 6), *((a, a + 10) for a in range(2, max(3, level - 8), 2))]


def _begins(columns: pa.Array, bits: pa.Array) -> pa.Array:
    """How many of a block's columns lie before each sixteenth of it, and how many there are."""
    n = len(columns)
    sizes = columns.value_lengths().to_numpy(zero_copy_only=False)
    shift = np.repeat(bits.to_numpy(zero_copy_only=False) - 4, sizes)
    mark = np.repeat(np.arange(n) * 17 + 1, sizes) + (columns.flatten().to_numpy(zero_copy_only=False) >> shift & 15)
    begins = np.cumsum(np.bincount(mark, minlength=17 * n).reshape(n, 17), axis=1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 17, pa.int32()), pa.array(begins.ravel(), pa.int32()))


def _in_ranges(ranges: DataFrame, tiles: DataFrame, level: int) -> DataFrame:
    """(index, x, y) of the tiles in each range (index, x0, x1, y0, y1). In a block of a grid each row of tiles is one list
    of columns, with the places in it at which each sixteenth of the block begins. A range meets the rows of a few
    blocks of the grid of its size and takes a part of each list: what is shuffled are ranges and tiles, not the pairs."""
    grids = _grids(level)
    tasks = max(8, int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = ["grid_rows", "grid_columns", "block", "run"]
    grid = lambda a, b: F.struct(F.lit(a).alias("grid_rows"), F.lit(b).alias("grid_columns"))
    t = tiles.select(F.col("x").cast("int").alias("x"), F.col("y").cast("bigint").alias("y")).distinct()
    t = t.withColumn("grid", F.explode(F.array(*[grid(*g) for g in grids]))).select("x", "y", "grid.*")
    t = t.withColumns({"block": F.expr("shiftright(y, grid_rows)"), "run": F.expr("shiftright(x, grid_columns)").cast("bigint")})
    t = t.repartition(tasks, *key).groupBy(*key, "y").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    lists = t.withColumn("begins", F.arrow_udf(_begins, "array<int>")("xs", "grid_columns"))

    blocks = lambda a, b: (F.shiftright("y1", a) - F.shiftright("y0", a) < 1024) & (F.shiftright("x1", b) - F.shiftright("x0", b) < (4 if b == 6 else 64))
    mine = reduce(lambda coarse, g: F.when(blocks(*g), grid(*g)).otherwise(coarse), grids[-2::-1], grid(*grids[-1]))
    r = ranges.withColumn("grid", mine).select("index", "x0", "x1", "y0", "y1", "grid.*")
    r = r.withColumn("block", F.explode(F.sequence(F.expr("shiftright(y0, grid_rows)"), F.expr("shiftright(y1, grid_rows)"))))
    r = r.withColumn("run", F.explode(F.sequence(F.expr("shiftright(x0, grid_columns)"), F.expr("shiftright(x1, grid_columns)"))))
    met = r.repartition(tasks, *key).join(lists.hint("shuffle_hash"), key).where("y BETWEEN y0 AND y1")
    west = F.expr("shiftleft(run, grid_columns)")
    place = lambda v: F.expr(f"CAST(shiftright({v}, grid_columns - 4) - shiftleft(run, 4) AS int)")
    met = met.withColumns({"from": F.when(F.col("x0") <= west, 0).otherwise(F.get("begins", place("x0"))), "to": F.get("begins", F.least(place("x1"), F.lit(15)) + 1)})
    met = met.select("index", "x0", "x1", F.explode(F.slice("xs", F.col("from") + 1, F.col("to") - F.col("from"))).alias("x"), "y")
    return met.where("x BETWEEN x0 AND x1").select("index", F.col("x").cast("bigint"), "y")


# --- drawing -------------------------------------------------------------------------------------


def _drawn(covered: DataFrame, level: int, extent: int, buffer: int) -> DataFrame:
    """Pieces in whole units of their tile; whole cells as all their tiles, each with a square that fills it and its buffer."""
    steps = F.lit(level) - F.col("z")
    span = lambda c: F.explode(F.sequence(F.expr(f"shiftleft({c}, {level} - z)"), F.expr(f"shiftleft({c} + 1, {level} - z) - 1")))
    rows = covered.withColumn("tx", span("x")).withColumn("ty", span("y")).withColumn("steps", steps)
    unit = unit_of(level, extent)
    west, north = F.col("tx") * (unit * extent) - G.WORLD / 2, G.WORLD / 2 - F.col("ty") * (unit * extent)
    grid = lambda p: F.array(F.floor((p[0] - west) / unit + 0.5).cast("bigint"), F.floor((north - p[1]) / unit + 0.5).cast("bigint"))
    slim = lambda part: F.filter(part, lambda p, i: (i == 0) | (p != F.get(part, i - 1)))
    parts = F.transform("parts", lambda part: slim(F.transform(part, grid)))
    least = F.when(F.col("kind") == AREA, 4).when(F.col("kind") == LINE, 2).otherwise(1)
    parts = F.filter(parts, lambda part: F.size(part) >= least)
    low, high = -buffer, extent + buffer
    square = F.array(F.array(*[F.array(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")) for a, b in ((low, low), (high, low), (high, high), (low, high), (low, low))]))
    out = rows.select("index", "kind", F.lit(level).cast("bigint").alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.when(F.col("whole"), square).otherwise(parts).alias("parts"))
    return out.where("size(parts) > 0")


def draw_levels(levels: dict[int, DataFrame], attributes: DataFrame, layer: str = "features", extent: int = 4096, buffer: int = 80) -> DataFrame:
    """Feature rows of the levels of a cascade. What travels through covers and cuts is an index and a piece's
    own points; id and props come from the attributes by one join on the index at the end."""
    each = [_drawn(cover(shapes, level, buffer * unit_of(level, extent)), level, extent, buffer) for level, shapes in sorted(levels.items())]
    drawn = reduce(DataFrame.unionByName, each)
    out = drawn.join(attributes, "index")
    return out.select("z", "x", "y", F.lit(layer).alias("layer"), F.col("index").alias("feat_no"), "id", "kind", "parts", "props", F.lit(extent).alias("extent"), F.lit(2).alias("version"))


def import_shapes(shapes: DataFrame, levels: range, layer: str = "features", **options) -> DataFrame:
    """Feature rows of shapes (id, geometry, props) at all levels: ``planar``, ``cascade``, ``draw_levels``."""
    flat, attributes = planar(shapes)
    made = cascade(flat, levels, **options)
    return draw_levels(made, attributes, layer)


def forget_levels(levels: dict[int, DataFrame]) -> None:
    """Deletes the stored tables of a cascade."""
    for table in levels.values():
        forget(table)
