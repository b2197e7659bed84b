"""Between vector tile blobs and feature rows: decoding, encoding, validation, repair, drawing of shapes."""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.functions import geometry as G
from tesselon.functions import mvt

KEY = ["z", "x", "y"]
#: What a tile that cannot be decoded raises.
BROKEN = (ValueError, IndexError, UnicodeDecodeError)
FEATURES = "z long, x long, y long, layer string, feat_no long, id long, kind int, parts array<array<array<long>>>, props map<string,string>, extent int, version int"
COLUMNS = [c.split()[0] for c in FEATURES.split(", ")]


_LONG, _INT, _TEXT = pa.int64(), pa.int32(), pa.string()
_FEATURE_TYPES = [_LONG, _LONG, _LONG, _TEXT, _LONG, _LONG, _INT, pa.list_(pa.list_(pa.list_(_LONG))), pa.map_(_TEXT, _TEXT), _INT, _INT]


def _each_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, memoryview]]:
    """Keys and bytes of tiles (z, x, y, data); the bytes are not copied."""
    for batch in batches:
        *key, data = batch.columns
        for i in range(batch.num_rows):
            yield tuple(k[i].as_py() for k in key), memoryview(data[i].as_buffer())


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a few thousand, however many a tile has."""
    while some := list(itertools.islice(rows, mvt.FEW)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)


def decode(tiles: DataFrame, skip_broken: bool = False) -> DataFrame:
    """Feature rows of vector tiles (z, x, y, data). A tile that cannot be decoded stops the job, or with skip_broken
    has no rows; ``broken`` lists such tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, data in _each_tile(batches):
            made = _batches(((*key, *f.values()) for f in mvt.each_row(data)), COLUMNS, _FEATURE_TYPES)
            try:
                yield from list(made) if skip_broken else made
            except BROKEN:
                if not skip_broken:
                    raise

    return tiles.select(*KEY, "data").mapInArrow(run, FEATURES)


def decode_recorded(tiles: DataFrame):
    """Features of vector tiles, and the tiles that cannot be decoded with what is wrong, from one pass: see ``errors``."""
    from tesselon.operators.errors import split_errors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for z, x, y, data in zip(batch["z"], batch["x"], batch["y"], batch["data"], strict=True):
                try:
                    rows += [(z, x, y, *f.values(), None) for f in mvt.to_rows(bytes(data))]
                except BROKEN as error:
                    rows.append((z, x, y, *[None] * (len(COLUMNS) - len(KEY)), f"{type(error).__name__}: {error}"))
            out = pd.DataFrame(rows, columns=[*COLUMNS, "error"])
            whole = {c: "Int64" for c in ("feat_no", "id", "kind", "extent", "version")}
            yield out.astype(whole)

    made = tiles.select(*KEY, "data").mapInPandas(run, FEATURES + ", error string")
    return split_errors(made, "error", "decode", KEY)


def broken(tiles: DataFrame) -> DataFrame:
    """(z, x, y, error) of the vector tiles that cannot be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for z, x, y, data in zip(batch["z"], batch["x"], batch["y"], batch["data"], strict=True):
                try:
                    mvt.decode_tile(bytes(data))
                except BROKEN as error:
                    rows.append((z, x, y, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=[*KEY, "error"])

    return tiles.select(*KEY, "data").mapInPandas(run, "z long, x long, y long, error string")


def drop_layers(tiles: DataFrame, names: list[str], invert: bool = False) -> DataFrame:
    """Vector tiles without the named layers, or with invert with no others. Features are not decoded, and tiles
    that lose their last layer stay, empty."""
    listed = set(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(data=[mvt.without_layers(bytes(data), listed, invert) for data in batch["data"]])

    return tiles.select(*KEY, "data").mapInPandas(run, "z long, x long, y long, data binary")


def encode(features: DataFrame, extent: int = 4096, version: int = 2) -> DataFrame:
    """Vector tiles of feature rows. A tile's features stream through one task in order, which keeps their bytes: what it
    holds is about the tile that it makes. Layers have the extent and version of their rows; the parameters hold
    for rows without them. Rows of a layer that differ in extent stop the job."""
    for name, default in (("extent", extent), ("version", version)):
        features = features.withColumn(name, F.coalesce(name, F.lit(default)) if name in features.columns else F.lit(default))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: dict = {}

        def value_of(text: str):
            if text not in values:
                if len(values) > mvt.FEW:
                    values.clear()
                values[text] = json.loads(text)
            return values[text]

        rows = (r for batch in batches for at in range(0, batch.num_rows, mvt.FEW) for r in zip(*(c.to_pylist() for c in batch.slice(at, mvt.FEW).columns), strict=True))
        for key, tile in itertools.groupby(rows, lambda r: r[:3]):
            out = bytearray()
            for name, layer in itertools.groupby(tile, lambda r: r[3]):
                if name is None:
                    continue
                writer, size, newest = mvt.LayerWriter(name), None, 1
                for _, _, _, _, id_, kind, parts, props, own, v in layer:
                    if size not in (None, own):
                        raise ValueError(f"rows of layer {name} differ in extent")
                    size, newest = own, max(newest, v)
                    writer.add(id_, kind, parts, {k: value_of(t) for k, t in dict(props).items()})
                out += writer.done(size, newest)
            yield pa.RecordBatch.from_arrays([*(pa.array([k], _LONG) for k in key), pa.array([bytes(out)], pa.binary())], names=[*KEY, "data"])

    met = features.repartition(*KEY).sortWithinPartitions(*KEY, "layer", F.col("feat_no").asc_nulls_last())
    return met.select(*KEY, "layer", "id", "kind", "parts", "props", "extent", "version").mapInArrow(run, "z long, x long, y long, data binary")


def validate(tiles: DataFrame) -> DataFrame:
    """(z, x, y, issue, layer, feature): what is wrong with vector tiles; undecodable ones are DecodeFailure."""
    names, types = [*KEY, "issue", "layer", "feature"], [_LONG, _LONG, _LONG, _TEXT, _TEXT, _INT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, data in _each_tile(batches):
            found = ((*key, *i) for some in mvt.layer_issues(mvt.read_layers(data)) for i in some)
            try:
                yield from list(_batches(found, names, types))
            except BROKEN:
                yield from _batches(iter([(*key, "DecodeFailure", None, -1)]), names, types)

    return tiles.select(*KEY, "data").mapInArrow(run, "z long, x long, y long, issue string, layer string, feature int")


def repair(tiles: DataFrame, drop_offenders: bool = False) -> DataFrame:
    """Tiles without issues as they are, others repaired. Tiles that cannot be decoded stay as they are, or go with
    drop_offenders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data in batch["data"]:
                try:
                    layers = mvt.decode_tile(bytes(data))
                except BROKEN:
                    out.append(None if drop_offenders else bytes(data))
                    continue
                out.append(mvt.encode_tile(mvt.repair(layers, drop_offenders)) if mvt.issues(layers) else bytes(data))
            batch = batch.assign(data=out)
            yield batch[batch["data"].notna()]

    return tiles.mapInPandas(run, tiles.schema)


def within_packed_cap(tiles: DataFrame, cap: int) -> DataFrame:
    """The tiles whose content takes at most so many bytes when it is gzipped."""

    @F.arrow_udf("bigint")
    def packed(data: pa.Array) -> pa.Array:
        return pa.array([len(zlib.compress(x.as_buffer(), wbits=31)) for x in data], pa.int64())

    return tiles.where((F.length("data") <= cap) | (packed("data") <= cap))


def draw_shapes(shapes: DataFrame, levels: range, layer: str = "features", extent: int = 4096, buffer: int = 80, tolerance: float = 4.0, min_area: float = 4.0, min_length: float = 4.0, line_tolerance: float | None = None) -> DataFrame:
    """Feature rows of shapes (id, geometry GeoJSON text, props) at each level.

    A spatial join by tiles: each shape's box is exploded into the tiles it touches, in Spark, and only
    then cut, one (shape, tile) a row; shapes too small at a level go before that. Lines are simplified by
    line_tolerance, by default as polygons are."""

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                kind, parts = G.shape_parts(json.loads(r.geometry))
                xs, ys = [p[0] for part in parts for p in part], [p[1] for part in parts for p in part]
                size = sum(map(G.area, parts)) if kind == 3 else sum(map(G.length, parts)) if kind == 2 else 0.0
                rows.append((r.id, r.geometry, r.props, kind, min(xs), min(ys), max(xs), max(ys), size))
            yield pd.DataFrame(rows, columns=["id", "geometry", "props", "kind", "x0", "y0", "x1", "y1", "measure"])

    known = shapes.select("id", "geometry", "props").mapInPandas(boxes, "id long, geometry string, props map<string,string>, kind int, x0 double, y0 double, x1 double, y1 double, measure double")
    at = known.withColumn("z", F.explode(F.sequence(F.lit(levels.start).cast("bigint"), F.lit(levels.stop - 1).cast("bigint"))))
    unit = F.lit(G.WORLD) / F.pow(F.lit(2.0), "z") / extent
    at = at.where((F.col("kind") == 1) | (F.col("kind") == 2) & (F.col("measure") >= min_length * unit) | (F.col("kind") == 3) & (F.col("measure") >= min_area * unit * unit))
    last = F.pow(F.lit(2.0), "z") - 1
    cell = lambda v: F.greatest(F.lit(0.0), F.least(last, F.floor(v / (unit * extent)))).cast("bigint")
    half, edge = G.WORLD / 2, buffer * unit
    at = at.withColumn("x", F.explode(F.sequence(cell(F.col("x0") - edge + half), cell(F.col("x1") + edge + half))))
    at = at.withColumn("y", F.explode(F.sequence(cell(half - F.col("y1") - edge), cell(half - F.col("y0") + edge))))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                kind, parts = G.shape_parts(json.loads(r.geometry))
                drawn = G.draw(kind, parts, int(r.z), int(r.x), int(r.y), extent, buffer, tolerance if kind != 2 or line_tolerance is None else line_tolerance)
                if drawn:
                    rows.append((r.z, r.x, r.y, layer, 0, r.id, kind, [[list(p) for p in part] for part in drawn], r.props, extent, 2))
            out = pd.DataFrame(rows, columns=COLUMNS)
            yield out.assign(id=out["id"].astype("Int64"))

    drawn = at.select(*KEY, "id", "geometry", "props").mapInPandas(cut, FEATURES)
    return drawn.withColumn("feat_no", F.coalesce("id", F.lit(0)))


def shape_sizes(shapes: DataFrame) -> DataFrame:
    """(size): what each shape counts for the choice of a deepest level, in metres of the Mercator plane. Points are 0,
    lines count by their length, polygons by the root of their area; broken ones of no size are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["geometry"]:
                kind, parts = G.shape_parts(json.loads(text))
                size = 0.0 if kind == 1 else sum(map(G.length, parts)) if kind == 2 else sum(map(G.area, parts)) ** 0.5
                if kind == 1 or 0 < size < float("inf"):
                    found.append(size)
            yield pd.DataFrame({"size": found}, dtype=float)

    return shapes.select("geometry").mapInPandas(run, "size double")


def thin_points(points: DataFrame, cell: float, order: str = "id") -> DataFrame:
    """At most one point (mx, my in metres) of each square cell, the first by ``order``: the distributed
    form of thinning. ``thin_min_distance`` is the exact, sequential one."""
    square = [F.floor(F.col(c) / cell).cast("bigint").alias(f"_{c}") for c in ("mx", "my")]
    return points.select("*", *square).groupBy("_mx", "_my").agg(F.min_by(F.struct(*points.columns), order).alias("_p")).select("_p.*")


def thin_min_distance(points: DataFrame, distance: float, group: str, order: str = "id") -> DataFrame:
    """Points of each group, in order, that are at least ``distance`` from all kept before them. Sequential
    by definition: each group is one task, so groups (a level of a region) must fit a worker; ``thinning.thin_by_distance``
    has no such limit. Points without finite coordinates go."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf["mx"].astype(float)) & np.isfinite(pdf["my"].astype(float))].sort_values(order)
        cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
        keep = []
        for x, y in zip(pdf["mx"], pdf["my"], strict=True):
            i, j = int(x // distance), int(y // distance)
            near = (p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in cells.get((i + a, j + b), ()))
            free = all((x - px) ** 2 + (y - py) ** 2 >= distance * distance for px, py in near)
            keep.append(free)
            if free:
                cells.setdefault((i, j), []).append((x, y))
        return pdf[keep]

    return points.groupBy(group).applyInPandas(one, points.schema)


def overzoom(features: DataFrame, level_base: int, level_max: int, extent: int = 4096, buffer: int = 80) -> DataFrame:
    """Features of level_base cut to and enlarged for the deeper tiles up to level_max; levels up to
    level_base pass through, deeper ones of the source go. Each feature's children are exploded in Spark.
    A row's own extent counts; the parameter holds for rows without one."""
    for name, default in (("extent", extent), ("version", 2)):
        features = features.withColumn(name, (F.coalesce(name, F.lit(default)) if name in features.columns else F.lit(default)).cast("int"))

    def child(kind: int, parts: list, extent: int, steps: int, i: int, j: int) -> list:
        size = 1 << steps
        width, edge = extent / size, buffer / size
        box = (i * width - edge, j * width - edge, (i + 1) * width + edge, (j + 1) * width + edge)
        lines = [[(float(p[0]), float(p[1])) for p in part] for part in parts]
        if kind == mvt.LINE:
            cut = [c for p in lines for c in G.clip_line(p, box)]
        else:
            cut = [c for p in lines if (c := G.clip_ring(p, box))]
        return [[[int((px - i * width) * size // 1), int((py - j * width) * size // 1)] for px, py in part] for part in cut]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [child(int(r.kind), r.parts, int(r.extent), int(r.steps), int(r.i), int(r.j)) for r in batch.itertuples()]
            out = batch.assign(parts=parts)[[bool(p) for p in parts]].drop(columns=["steps", "i", "j"])
            yield out.assign(id=out["id"].astype("Int64"))

    base = features.where(F.col("z") == level_base)
    steps = F.explode(F.sequence(F.lit(1), F.lit(level_max - level_base))) if level_max > level_base else None
    out = features.where(F.col("z") <= level_base)
    if steps is None:
        return out.select(COLUMNS)
    points = F.flatten("parts")
    reach = lambda axis, f: f(F.transform(points, lambda p: p[axis]))
    edge, side = buffer / F.pow(F.lit(2.0), "steps"), F.pow(F.lit(2.0), "steps")
    within = lambda v: F.greatest(F.lit(0), F.least(side - 1, v)).cast("int")
    # Children whose box, edges included, the feature's range touches.
    first = lambda axis: within(F.ceil((reach(axis, F.array_min) - edge) * side / F.col("extent")) - 1)
    last = lambda axis: within(F.floor((reach(axis, F.array_max) + edge) * side / F.col("extent")))
    kids = base.withColumn("steps", steps)
    kids = kids.withColumn("i", F.explode(F.sequence(first(0), last(0)))).withColumn("j", F.explode(F.sequence(first(1), last(1))))
    size = F.pow(F.lit(2.0), "steps").cast("bigint")
    kids = kids.withColumns({"z": F.col("z") + F.col("steps"), "x": F.col("x") * size + F.col("i"), "y": F.col("y") * size + F.col("j")})
    # Points need no cutting: they stay in Spark, and only lines and polygons go to Python.
    width, side = F.col("extent") / F.pow(F.lit(2.0), "steps"), F.pow(F.lit(2.0), "steps")
    low, high = (lambda i: F.col(i) * width - buffer / side), (lambda i: (F.col(i) + 1) * width + buffer / side)
    within_box = lambda p: (p[0][0] >= low("i")) & (p[0][0] <= high("i")) & (p[0][1] >= low("j")) & (p[0][1] <= high("j"))
    at = lambda v, i: F.floor((v - F.col(i) * width) * side).cast("bigint")
    enlarged = F.transform(F.filter("parts", within_box), lambda part: F.transform(part, lambda p: F.array(at(p[0], "i"), at(p[1], "j"))))
    spots = kids.where(F.col("kind") == mvt.POINT).withColumn("parts", enlarged).where(F.size("parts") > 0)
    rest = kids.where(F.coalesce(F.col("kind") != mvt.POINT, F.lit(True)))
    made = spots.select(COLUMNS).unionByName(rest.select(*COLUMNS, "steps", "i", "j").mapInPandas(run, FEATURES))
    return out.select(COLUMNS).unionByName(made)


BYTES = ("features", "vertices", "geometry", "tags", "keys", "vals", "ids", "encoded", "other")


def layer_bytes(tiles: DataFrame) -> DataFrame:
    """By level and layer the tiles, features, vertices and bytes of vector tiles; the largest layers first."""

    names = ["z", "layer", *BYTES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, data = batch.columns
            rows = ((z[i].as_py(), s["layer"], *(s[k] for k in BYTES)) for i in range(batch.num_rows) for s in mvt.layer_bytes(data[i].as_buffer()))
            yield from _batches(rows, names, [_LONG, _TEXT, *[_LONG] * len(BYTES)])

    each = tiles.select("z", "data").mapInArrow(run, "z long, layer string, " + ", ".join(f"{k} long" for k in BYTES))
    return each.groupBy("z", "layer").agg(F.count(F.lit(1)).alias("tiles"), *[F.sum(k).cast("bigint").alias(k) for k in BYTES]).orderBy("z", F.desc("encoded"), "layer")


def largest_features(features: DataFrame, n: int = 10) -> DataFrame:
    vertices = F.aggregate("parts", F.lit(0), lambda a, p: a + F.size(p))
    return features.select(*KEY, "layer", "feat_no", "id", vertices.alias("vertices")).orderBy(F.desc("vertices"), *KEY, "layer", "feat_no").limit(n)


def attribute_use(features: DataFrame) -> DataFrame:
    """By layer and attribute: features that have it, distinct values, bytes of the values' texts."""
    each = features.select("layer", F.explode("props").alias("attribute", "value"))
    return each.groupBy("layer", "attribute").agg(F.count(F.lit(1)).alias("features"), F.countDistinct("value").alias("distinct_values"), F.sum(F.octet_length("value")).cast("bigint").alias("bytes"))


def drop_rate(points: DataFrame, ratio: float, index: str = "id") -> DataFrame:
    """Keeps the points whose hashed number lies below the ratio: the same ones in every run and at every size."""
    @F.pandas_udf("boolean")
    def keep(number: pd.Series) -> pd.Series:
        x = number.to_numpy(np.int64).view(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return pd.Series(((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53) < ratio)

    return points.where(keep(F.col(index)))


def overzoom_climbing(features: DataFrame, level_base: int, level_max: int, level_min: int = 0, extent: int = 4096, buffer: int = 80) -> DataFrame:
    """As ``overzoom``; where level_base has no tile, features come from the nearest ancestor down to level_min.

    Levels are filled from below: what a level draws into the base is kept only where no deeper level has a tile."""
    for name, default in (("extent", extent), ("version", 2)):
        features = features.withColumn(name, (F.coalesce(name, F.lit(default)) if name in features.columns else F.lit(default)).cast("int"))
    base = features.where(F.col("z") == level_base)
    taken = base.select("x", "y").distinct()
    for level in range(level_base - 1, level_min - 1, -1):
        steps = level_base - level
        own = features.where(F.col("z") == level)
        here = overzoom(own, level, level_base, extent, buffer).where(F.col("z") == level_base)
        base = base.unionByName(here.join(taken, ["x", "y"], "left_anti").select(base.columns))
        side = F.sequence(F.lit(0).cast("bigint"), F.lit((1 << steps) - 1).cast("bigint"))
        below = own.select("x", "y").distinct().withColumn("_i", F.explode(side)).withColumn("_j", F.explode(side))
        taken = taken.unionByName(below.select((F.col("x") * (1 << steps) + F.col("_i")).alias("x"), (F.col("y") * (1 << steps) + F.col("_j")).alias("y"))).distinct()
    low = features.where(F.col("z") < level_base)
    return low.unionByName(overzoom(base, level_base, level_max, extent, buffer).select(low.columns))
