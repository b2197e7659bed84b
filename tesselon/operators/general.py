"""Operators on any tile relation (z, x, y, …): filters, remapping, stacking, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.coords import MAX_LEVEL, in_bbox, near_bbox, remap

KEY = ["z", "x", "y"]


def filter_tiles(
    tiles: DataFrame,
    bbox: tuple[float, float, float, float] | None = None,
    bbox_border: int | None = None,
    level_min: int | None = None,
    level_max: int | None = None,
    mask: DataFrame | None = None,
) -> DataFrame:
    """Tiles within a range of levels, a geographic box with a ring of tiles, and a relation of keys."""
    low, high = level_min or 0, MAX_LEVEL if level_max is None else level_max
    if low > high:
        raise ValueError("level_min is above level_max")
    if bbox_border and bbox is None:
        raise ValueError("bbox_border needs a bbox")
    out = tiles.where(F.col("z").between(low, high)) if level_min is not None or level_max is not None else tiles
    if bbox is not None:
        stored = _is_stored(tiles)
        out = out.where(in_bbox(bbox, range(low, high + 1), bbox_border or 0) if stored else near_bbox(bbox, bbox_border or 0))
    return out if mask is None else out.join(mask.select(KEY), KEY, "left_semi")


def _is_stored(tiles: DataFrame) -> bool:
    """Whether the keys are columns of files, which comparisons with literals can be pushed into."""
    plan = tiles._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() in ("Project", "Filter") and not any(a in plan.toString().split("\n")[0] for a in (" AS z#", " AS x#", " AS y#")):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() in ("LogicalRelation", "DataSourceV2ScanRelation")


def remap_coords(tiles: DataFrame, flip_x: bool = False, flip_y: bool = False, swap_xy: bool = False) -> DataFrame:
    a, b = remap("z", "x", "y", flip_x, flip_y, swap_xy)
    return tiles.withColumns({"x": a, "y": b})


def _ranked(sources: list[DataFrame]) -> DataFrame:
    if len(sources) < 2:
        raise ValueError("at least two sources are needed")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)])


def stack(sources: list[DataFrame]) -> DataFrame:
    """Each tile from the first source that has it. The first-ranked row is found by an aggregation that
    combines on the map side: no tile of a lower source is sorted or held."""
    rows = _ranked(sources)
    rest = [c for c in rows.columns if c not in (*KEY, "_rank")]
    best = rows.groupBy(KEY).agg(F.min_by(F.struct(*rest), "_rank").alias("_best"))
    return best.select(*KEY, "_best.*")


def stack_native(sources: list[DataFrame], native: Column) -> DataFrame:
    """As ``stack``, for tiles of which at least one source has a native (not overscaled) one."""
    rows = _ranked([s.withColumn("_native", native) for s in sources])
    rest = [c for c in rows.columns if c not in (*KEY, "_rank", "_native")]
    best = rows.groupBy(KEY).agg(F.min_by(F.struct(*rest), "_rank").alias("_best"), F.bool_or("_native").alias("_any"))
    return best.where("_any").select(*KEY, "_best.*")


def merge_features(sources: list[DataFrame]) -> DataFrame:
    """Features (z, x, y, layer, …) of all sources; in each layer those of earlier sources come first.

    Layers that are merged must agree on ``extent`` where the sources have that column."""
    rows = _ranked(sources)
    if "extent" in rows.columns:
        clash = F.size(F.collect_set(F.coalesce("extent", F.lit(4096))).over(Window.partitionBy(*KEY, "layer"))) > 1
        rows = rows.withColumn("extent", F.when(clash, F.raise_error(F.lit("layers to merge differ in extent"))).otherwise(F.coalesce("extent", F.lit(4096))))
    order = Window.partitionBy(*KEY, "layer").orderBy("_rank", "feat_no")
    return rows.withColumn("feat_no", (F.row_number().over(order) - 1).cast("bigint")).drop("_rank")


def first_of_each(tiles: DataFrame, order: str) -> DataFrame:
    """One row for each key, the first by ``order``: what a sink that ignores repeated tiles writes."""
    rest = [c for c in tiles.columns if c not in KEY]
    return tiles.groupBy(KEY).agg(F.min_by(F.struct(*rest), order).alias("_best")).select(*KEY, "_best.*")


# --- coverage ------------------------------------------------------------------------------------


def coverage(tiles: DataFrame) -> DataFrame:
    return tiles.select(KEY).distinct()


def cover_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(KEY).union(b.select(KEY)).distinct()


def cover_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(KEY).intersect(b.select(KEY))


def cover_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(KEY).subtract(b.select(KEY))


def cover_buffer(a: DataFrame, size: int) -> DataFrame:
    """The tiles within ``size`` steps of a covered one, clamped to the level."""
    shift = F.explode(F.sequence(F.lit(-size), F.lit(size)))
    out = a.select(KEY).withColumn("_i", shift).withColumn("_j", shift).select("z", (F.col("x") + F.col("_i")).alias("x"), (F.col("y") + F.col("_j")).alias("y"))
    last = F.pow(F.lit(2.0), "z").cast("bigint") - 1
    return out.where(F.col("x").between(0, last) & F.col("y").between(0, last)).select(*[F.col(c).cast("bigint").alias(c) for c in KEY]).distinct()


def pyramid_summary(tiles: DataFrame) -> DataFrame:
    """For each level the covered range, the number of tiles and the whole percentage of the range covered."""
    cover = coverage(tiles).groupBy("z").agg(*[f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))], F.count(F.lit(1)).alias("tiles"))
    area = (F.col("x_max") - F.col("x_min") + 1) * (F.col("y_max") - F.col("y_min") + 1)
    return cover.withColumn("percent", F.floor(F.col("tiles") * 100 / area).cast("bigint"))


def weighted_bbox(tiles: DataFrame) -> DataFrame:
    """One row: the mean of the levels' bounds, weighted by their tiles, in degrees."""
    from tesselon.functions.coords import tile_north, tile_west

    levels = pyramid_summary(tiles)
    sides = {"west": tile_west("x_min", "z"), "south": tile_north(F.col("y_max") + 1, "z"), "east": tile_west(F.col("x_max") + 1, "z"), "north": tile_north("y_min", "z")}
    return levels.agg(*[F.round(F.sum(v * F.col("tiles")) / F.sum("tiles"), 6).alias(k) for k, v in sides.items()])


def center_and_touching_bbox(tiles: DataFrame) -> DataFrame:
    """One row: center_lon, center_lat and center_zoom (the middle of the deepest level's bounds, two levels under
    the first at most), and the touching box: the smallest from which a client that asks for all tiles it overlaps gets
    every tile of every level, with half a tile of the deepest level around it. Where all levels are one
    tile it is the bounds of the deepest. No tiles give no row."""
    from tesselon.functions.coords import tile_north, tile_west

    levels, side = pyramid_summary(tiles), F.pow(F.lit(2.0), F.col("z"))
    deepest = lambda v: F.max_by(v, "z")
    bounds = {"west": tile_west("x_min", "z"), "south": tile_north(F.col("y_max") + 1, "z"), "east": tile_west(F.col("x_max") + 1, "z"), "north": tile_north("y_min", "z")}
    inner = [F.min((F.col("x_min") + 1) / side).alias("_w"), F.min((F.col("y_min") + 1) / side).alias("_n"), F.max(F.col("x_max") / side).alias("_e"), F.max(F.col("y_max") / side).alias("_s")]
    row = levels.agg(*inner, F.min("z").alias("_first"), F.max("z").alias("_last"), *[deepest(v).alias(k) for k, v in bounds.items()]).where("_last IS NOT NULL")
    half = 0.5 / F.pow(F.lit(2.0), F.col("_last"))
    within = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    row = row.withColumns({"_w": within(F.col("_w") - half), "_n": within(F.col("_n") - half), "_e": within(F.col("_e") + half), "_s": within(F.col("_s") + half)})
    whole = (F.col("_w") < F.col("_e")) & (F.col("_n") < F.col("_s"))
    zero = F.lit(0)
    touching = {"west": tile_west("_w", zero), "south": tile_north("_s", zero), "east": tile_west("_e", zero), "north": tile_north("_n", zero)}
    return row.select(
        ((F.col("west") + F.col("east")) / 2).alias("center_lon"),
        ((F.col("south") + F.col("north")) / 2).alias("center_lat"),
        F.least(F.col("_first") + 2, F.col("_last")).cast("bigint").alias("center_zoom"),
        *[F.when(whole, v).otherwise(F.col(k)).alias(k) for k, v in touching.items()],
    )


def outline(cover: DataFrame) -> DataFrame:
    """The outline of a coverage: (z, axis, line, first, last), edges in tile units that bound it on one
    side only, neighbouring ones joined. axis v: vertical, at x = line from y = first to last."""
    edge = lambda axis, line, along: F.struct(F.lit(axis).alias("axis"), line.alias("line"), along.alias("along"))
    x, y = F.col("x"), F.col("y")
    edges = coverage(cover).select("z", F.explode(F.array(edge("v", x, y), edge("v", x + 1, y), edge("h", y, x), edge("h", y + 1, x))).alias("e")).select("z", "e.*")
    single = edges.groupBy("z", "axis", "line", "along").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    order = Window.partitionBy("z", "axis", "line").orderBy("along")
    runs = single.withColumn("_run", F.col("along") - F.row_number().over(order))
    return runs.groupBy("z", "axis", "line", "_run").agg(F.min("along").alias("first"), (F.max("along") + 1).alias("last")).drop("_run")
