"""Operators between levels: overviews, resizing, overscaling, climbing to the nearest ancestor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions.coords import ancestor

KEY = ["z", "x", "y"]


def parent_of(tiles: DataFrame, steps: int = 1) -> DataFrame:
    """The keys moved so many levels up; tiles of too low a level go."""
    up = tiles.where(F.col("z") >= steps)
    return up.withColumns({"x": ancestor("x", F.lit(steps)), "y": ancestor("y", F.lit(steps)), "z": F.col("z") - steps})


def overview(tiles: DataFrame, level: int, aggregates: dict[str, Column]) -> DataFrame:
    """Levels 0 to ``level`` from the tiles of ``level``: each aggregate must be one that can be applied
    to its own result (sums, minima, maxima, counts as sums). Each level is made from the one below it,
    so the work shrinks by four a level."""
    now = tiles.where(F.col("z") == level).groupBy(KEY).agg(*[a.alias(n) for n, a in aggregates.items()])
    out = now
    for _ in range(level):
        now = parent_of(now).groupBy(KEY).agg(*[a.alias(n) for n, a in aggregates.items()])
        out = out.unionByName(now)
    return out


def dem_overview(pixels: DataFrame, alpha: bool = False) -> DataFrame:
    """Halves elevation images given as pixel rows (z, x, y, px, py, raw[, a]), px and py within a parent
    of twice the size: the rounded mean of a 2 x 2 block. With alpha only visible pixels count."""
    block = [*KEY, F.floor(F.col("px") / 2).cast("bigint").alias("px"), F.floor(F.col("py") / 2).cast("bigint").alias("py")]
    if not alpha:
        return pixels.groupBy(*block).agg(F.floor((F.sum("raw") + 2) / 4).cast("bigint").alias("raw"))
    seen = F.col("a") > 0
    n = F.count(F.when(seen, 1))
    mean = F.when(n > 0, F.floor((F.sum(F.when(seen, F.col("raw"))) + F.floor(n / 2)) / n)).otherwise(0)
    return pixels.groupBy(*block).agg(mean.cast("bigint").alias("raw"), F.floor((F.sum("a") + 2) / 4).cast("bigint").alias("a"))


def split_tiles(tiles: DataFrame) -> DataFrame:
    """Each tile as its four quadrants one level down (quadrant: 0 NW, 1 NE, 2 SW, 3 SE); level 0 also stays."""
    quarter = tiles.withColumn("quadrant", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
    quarter = quarter.withColumns({"z": F.col("z") + 1, "x": F.col("x") * 2 + F.col("quadrant") % 2, "y": F.col("y") * 2 + F.floor(F.col("quadrant") / 2).cast("bigint")})
    return quarter.unionByName(tiles.where("z = 0").withColumn("quadrant", F.lit(None).cast("bigint")))


def merge_tiles(tiles: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """Four tiles as one of the level above."""
    return parent_of(tiles).groupBy(KEY).agg(*[a.alias(n) for n, a in aggregates.items()])


def group_by_parent(tiles: DataFrame) -> DataFrame:
    """For each parent its children as an ordered array of structs."""
    rest = [c for c in tiles.columns if c not in KEY]
    kids = tiles.where("z > 0").withColumn("_kid", F.struct("y", "x", *rest))
    return parent_of(kids).groupBy(KEY).agg(F.array_sort(F.collect_list("_kid")).alias("children"))


def overscale(wanted: DataFrame, source: DataFrame, level_base: int) -> DataFrame:
    """Wanted tiles up to ``level_base`` as they are in the source, deeper ones from their ancestor there:
    columns of the source with source_z and the place within the ancestor, sub_x and sub_y."""
    steps = F.greatest(F.col("z") - level_base, F.lit(0))
    keys = wanted.select(KEY).withColumns({"_z": F.col("z") - steps, "_x": ancestor("x", steps), "_y": ancestor("y", steps)})
    size = F.pow(F.lit(2.0), steps).cast("bigint")
    keys = keys.withColumns({"sub_x": F.pmod("x", size), "sub_y": F.pmod("y", size)})
    named = source.withColumnsRenamed({"z": "_z", "x": "_x", "y": "_y"})
    return keys.join(named, ["_z", "_x", "_y"]).withColumnRenamed("_z", "source_z").drop("_x", "_y")


def climb(wanted: DataFrame, source: DataFrame, level_base: int, level_min: int = 0) -> DataFrame:
    """As ``overscale``, from the nearest ancestor at or above level_base that the source has: an as-of
    join, made of an equi-join on every ancestor and the deepest of the matches."""
    top = F.least(F.col("z"), F.lit(level_base))
    chain = wanted.select(KEY).distinct().withColumn("_z", F.explode(F.sequence(top.cast("bigint"), F.least(top, F.lit(level_min)).cast("bigint"), F.lit(-1).cast("bigint"))))
    steps = F.col("z") - F.col("_z")
    chain = chain.withColumns({"_x": ancestor("x", steps), "_y": ancestor("y", steps)})
    rest = [c for c in source.columns if c not in KEY]
    named = source.select(F.col("z").alias("_z"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.struct(F.lit(0).alias("_"), *rest).alias("_row"))
    best = chain.join(named, ["_z", "_x", "_y"]).groupBy(KEY).agg(F.max("_z").alias("source_z"), F.max_by("_row", "_z").alias("_row"))
    return best.select(*KEY, "source_z", *[F.col(f"_row.{c}") for c in rest])


def overzoom_points(points: DataFrame, level_base: int, level_max: int, extent: int = 4096, buffer: int = 80) -> DataFrame:
    """Point features (z, x, y, px, py, …) of level_base drawn in all deeper tiles up to level_max: the
    child's square of the extent, with its share of the buffer, is scaled up to the full extent. Levels
    up to level_base pass through; children that a point is not in get no row."""
    base = points.where(F.col("z") == level_base)
    out = points.where(F.col("z") <= level_base)
    for level in range(level_base + 1, level_max + 1):
        size = 2 ** (level - level_base)
        width, edge = extent / size, buffer / size
        first = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - edge) / width - 1)).cast("bigint")  # noqa: B023,E731
        last = lambda c: F.least(F.lit(size - 1), F.floor((F.col(c) + edge) / width)).cast("bigint")  # noqa: B023,E731
        kids = base.where((first("px") <= last("px")) & (first("py") <= last("py")))
        kids = kids.withColumn("_i", F.explode(F.sequence(first("px"), last("px")))).withColumn("_j", F.explode(F.sequence(first("py"), last("py"))))
        move = lambda c, i: F.floor((F.col(c) - F.col(i) * width) * size + 0.5).cast("bigint")  # noqa: B023,E731
        kids = kids.withColumns({"z": F.lit(level).cast("bigint"), "x": F.col("x") * size + F.col("_i"), "y": F.col("y") * size + F.col("_j"), "px": move("px", "_i"), "py": move("py", "_j")})
        out = out.unionByName(kids.drop("_i", "_j"))
    return out
