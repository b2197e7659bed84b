"""Tiles inside, outside and on the border of a mask of many edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.coords import WORLD


def ring_edges(rings: DataFrame, level: int) -> DataFrame:
    """(x0, y0, x1, y1): the edges of rings (points: array of Mercator [x, y], closed or not) in tiles of a level."""
    closed = F.when(F.element_at("points", 1) == F.element_at("points", -1), F.col("points")).otherwise(F.concat("points", F.slice("points", 1, 1)))
    side = float(1 << level)
    place = lambda p: F.struct(((p[0] / WORLD + 0.5) * side).alias("x"), ((0.5 - p[1] / WORLD) * side).alias("y"))
    pairs = F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r") - 1), lambda a, b: F.struct(place(a).alias("a"), place(b).alias("b")))
    rows = rings.where("size(points) > 1").select(closed.alias("r")).select(F.explode(pairs).alias("e"))
    return rows.select(F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"))


def _rows(edges: DataFrame, level: int) -> DataFrame:
    """Edges dealt to the rows of tiles that they pass: (y, and the part's ends in x). A row for each row of tiles."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    last = (1 << level) - 1
    dealt = edges.where((low < last + 1) & (high >= 0)).withColumn("y", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(low)).cast("bigint"), F.least(F.lit(last), F.floor(high)).cast("bigint"))))
    along = lambda at: F.col("x0") + (F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - F.col("y0")) / (F.col("y1") - F.col("y0"))))
    flat = F.col("y0") == F.col("y1")
    a = F.when(flat, F.col("x0")).otherwise(along(F.col("y")))
    b = F.when(flat, F.col("x1")).otherwise(along(F.col("y") + 1))
    return dealt.withColumns({"left": F.least(a, b), "right": F.greatest(a, b)})


def border_tiles(edges: DataFrame, level: int) -> DataFrame:
    """(x, y): the tiles of a level that an edge passes, as many as the border is long."""
    last = (1 << level) - 1
    rows = _rows(edges, level).where((F.col("right") >= 0) & (F.col("left") < last + 1))
    first, final = F.greatest(F.lit(0), F.floor("left")).cast("bigint"), F.least(F.lit(last), F.floor("right")).cast("bigint")
    return rows.select(F.explode(F.sequence(first, final)).alias("x"), "y").distinct()


def crossings(edges: DataFrame, level: int) -> DataFrame:
    """(y, x, odd): columns in which an odd number of edges crosses the middle of a row of tiles; -1 is left of all."""
    middle = F.col("y") + 0.5
    crossed = _rows(edges, level).where((F.col("y0") > middle) != (F.col("y1") > middle))
    at = F.col("x0") + (F.col("x1") - F.col("x0")) * (middle - F.col("y0")) / (F.col("y1") - F.col("y0"))
    column = F.greatest(F.lit(-1), F.floor(at)).cast("bigint").alias("x")
    return crossed.select("y", column).groupBy("y", "x").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1")


def classify(tiles: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """The distinct tiles (x, y) of a level with class: partial if an edge passes them, else inside or outside, by the
    even-odd rule over all edges (x0, y0, x1, y1 in tiles of the level; see ``ring_edges``).

    Edges are dealt to the rows and columns that they pass, so work grows with the border's length and not with tiles times
    edges. Whether a tile without an edge is inside is the parity of crossings before it in its row, summed by a window over tiles
    and crossings. An empty mask has no inside; horizontal edges cross no row.
    """
    keys = tiles.select("x", "y").distinct()
    on_border = border_tiles(edges, level).withColumn("hit", F.lit(True))
    events = crossings(edges, level).select("y", "x", F.col("odd").cast("bigint"), F.lit(False).alias("asked")).unionByName(keys.select("y", "x", F.lit(0).cast("bigint").alias("odd"), F.lit(True).alias("asked")))
    before = Window.partitionBy("y").orderBy("x").rangeBetween(Window.unboundedPreceding, -1)
    told = events.withColumn("count", F.coalesce(F.sum("odd").over(before), F.lit(0))).where("asked")
    kind: Column = F.when(F.col("hit"), "partial").when(F.col("count") % 2 == 1, "inside").otherwise("outside")
    return told.join(on_border, ["x", "y"], "left").select("x", "y", kind.alias("class"))
