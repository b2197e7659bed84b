"""Outlines of coverages as closed rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.operators.stored import forget, store

#: Sides of a tile, clockwise with the tile on the right hand: top, right, bottom, left. For each the step along it,
#: and the step across it, away from the tile.
ALONG = ((1, 0), (0, 1), (-1, 0), (0, -1))
ACROSS = ((0, -1), (1, 0), (0, 1), (-1, 0))
_AROUND = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i, j) != (0, 0)]
MAX_ROUNDS = 64


def _bit(step: tuple[int, int]) -> int:
    return 1 << _AROUND.index(step)


def edge_id(z: Column, x: Column, y: Column, side: Column) -> Column:
    """A number for a side of a tile within its level, by rows."""
    return ((y * F.pow(F.lit(2.0), z).cast("bigint") + x) * 4 + side).cast("bigint")


def sides(tiles: DataFrame) -> DataFrame:
    """(z, x, y, side, edge, next): the sides of tiles that no other tile has, and the side that follows on the outline.

    Each tile learns which of its eight neighbours are there by one aggregation. Where two tiles touch only at a
    corner, the outline stays with its tile, so such tiles have outlines of their own."""
    keys = tiles.select("z", "x", "y").distinct()
    near = F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(_bit((i, j))).alias("bit")) for i, j in _AROUND], F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(256).alias("bit")))
    told = keys.select("z", "x", "y", F.explode(near).alias("n")).groupBy("z", (F.col("x") + F.col("n.i")).alias("x"), (F.col("y") + F.col("n.j")).alias("y")).agg(F.bit_or("n.bit").alias("mask"))
    has = lambda step: F.col("mask").bitwiseAND(F.lit(_bit(step))) != 0
    out = []
    for side in range(4):
        along, across = ALONG[side], ACROSS[side]
        ahead, beyond = has(along), has((along[0] + across[0], along[1] + across[1]))
        z, x, y = F.col("z"), F.col("x"), F.col("y")
        turn = edge_id(z, x, y, F.lit((side + 1) % 4))
        straight = edge_id(z, x + along[0], y + along[1], F.lit(side))
        back = edge_id(z, x + along[0] + across[0], y + along[1] + across[1], F.lit((side + 3) % 4))
        follows = F.when(~ahead, turn).when(~beyond, straight).otherwise(back)
        own = F.struct(F.lit(side).alias("side"), edge_id(z, x, y, F.lit(side)).alias("edge"), follows.alias("next"), (ahead & ~beyond).alias("straight"))
        out.append(F.when(~has(across), own))
    each = told.where(F.col("mask") >= 256).select("z", "x", "y", F.explode(F.filter(F.array(*out), lambda s: s.isNotNull())).alias("s"))
    return each.select("z", "x", "y", "s.*")


def runs(edges: DataFrame) -> DataFrame:
    """(z, side, start, next, least, length, x, y, edge): straight runs of sides, with the run's first side, the one that follows
    it, its smallest side, and the corner where it begins; a row for each side of the run, named by edge."""
    level = F.col("side") % 2 == 0
    line, place = F.when(level, F.col("y")).otherwise(F.col("x")), F.when(level, F.col("x")).otherwise(F.col("y"))
    place = F.when(F.col("side").isin(0, 1), place).otherwise(-place)
    order = Window.partitionBy("z", "side", "line").orderBy("place")
    rows = edges.withColumns({"line": line, "place": place})
    joined = (F.lag("place").over(order) == F.col("place") - 1) & F.lag("straight").over(order)
    rows = rows.withColumn("run", F.sum(F.when(joined, 0).otherwise(1)).over(order))
    whole = Window.partitionBy("z", "side", "line", "run")
    first = F.min_by(F.struct("edge", "x", "y"), "place").over(whole)
    rows = rows.withColumns({"first": first, "least": F.min("edge").over(whole), "length": F.count(F.lit(1)).over(whole), "onward": F.max_by("next", "place").over(whole)})
    dx = F.when(F.col("side").isin(1, 2), 1).otherwise(0)
    dy = F.when(F.col("side").isin(2, 3), 1).otherwise(0)
    return rows.select("z", "side", F.col("first.edge").alias("start"), F.col("onward").alias("next"), "least", "length", (F.col("first.x") + dx).alias("x"), (F.col("first.y") + dy).alias("y"), "edge")


def _labelled(nodes: DataFrame) -> DataFrame:
    """(z, start, ring): the smallest ``least`` of the circle that (z, start) -> (z, next) belongs to, by pointer doubling."""
    now = store(nodes.select("z", "start", "next", F.col("least").alias("ring")))
    for _ in range(MAX_ROUNDS):
        ahead = now.select("z", F.col("start").alias("next"), F.col("next").alias("far"), F.col("ring").alias("other"))
        after = store(now.join(ahead, ["z", "next"]).select("z", "start", F.col("far").alias("next"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("changed")))
        forget(now)
        settled = after.where("changed").isEmpty()
        now = after
        if settled:
            return now.select("z", "start", "ring")
    raise RuntimeError("outlines did not settle")


def _ranked(nodes: DataFrame) -> DataFrame:
    """(z, start, place): how many runs lie between the head of a ring and each run, by pointer doubling from a chain that
    ends before the head."""
    head = F.col("least") == F.col("ring")
    heads = nodes.where(head).select("z", F.col("start").alias("next"), F.lit(True).alias("last"))
    now = nodes.join(heads, ["z", "next"], "left").select("z", "start", "ring", F.when(F.col("last").isNull(), F.col("next")).alias("next"), F.when(F.col("last").isNull(), 1).otherwise(0).cast("bigint").alias("left"))
    now = store(now)
    for _ in range(MAX_ROUNDS):
        if now.where("next IS NOT NULL").isEmpty():
            longest = now.groupBy("z", "ring").agg(F.max("left").alias("most"))
            return now.join(longest, ["z", "ring"]).select("z", "start", (F.col("most") - F.col("left")).alias("place"))
        ahead = now.select("z", F.col("start").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"))
        after = store(now.join(ahead, ["z", "next"], "left").select("z", "start", "ring", F.col("far").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
        forget(now)
        now = after
    raise RuntimeError("outlines did not settle")


def outline_rings(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rings, corners) of the tiles of all levels.

    rings: z, ring, corners, area, parent. A ring is named by its smallest side; its area, in tiles, is positive
    for outer rings, and negative for holes, whose parent is the outer ring around them. corners: z, ring,
    place, x, y, the corners in their order, clockwise for outer rings, from 0. Repeated tiles count once, an empty
    coverage has no rings.

    Sides are linked to the next one by a tile's neighbours alone; straight runs are put together along each line of
    tiles; circles get their name and their order by pointer doubling, so rounds grow with the logarithm of the longest
    ring and no task needs a whole one. A hole looks to its left: what it meets first there is its parent, or another hole of the same.
    """
    edges = store(runs(sides(tiles)))
    nodes = store(edges.select("z", "side", "start", "next", "least", "length", "x", "y").where("start IS NOT NULL").distinct())
    named = store(nodes.join(_labelled(nodes), ["z", "start"]))
    step = lambda k: F.element_at(F.array(*[F.lit(a[k]) for a in ALONG]), (F.col("side") + 1).cast("int")) * F.col("length")
    cross = F.col("x") * step(1) - F.col("y") * step(0)
    rings = named.groupBy("z", "ring").agg(F.count(F.lit(1)).alias("corners"), (F.sum(cross) / 2).cast("bigint").alias("area"))
    rings = store(rings)
    # The leftmost tile side of each hole lies right of a tile; that tile's row of tiles begins at another side.
    ring_of = named.select("z", F.col("start"), "ring")
    sided = edges.where(F.col("side").isin(1, 3)).select("z", "side", "start", "edge", F.floor(F.floor(F.col("edge") / 4) / F.pow(F.lit(2.0), F.col("z"))).cast("bigint").alias("row"), F.pmod(F.floor(F.col("edge") / 4), F.pow(F.lit(2.0), F.col("z")).cast("bigint")).alias("column"))
    sided = store(sided.join(ring_of, ["z", "start"]))
    left = Window.partitionBy("z", "row").orderBy("column", F.desc("side"))
    # Within a row left sides (3) and right sides (1) of runs of tiles take turns.
    before = sided.withColumn("west", F.lag("ring").over(left))
    holes = rings.where("area < 0").select("z", "ring")
    seen = before.where("side = 1").join(holes, ["z", "ring"], "left_semi").groupBy("z", "ring").agg(F.min_by("west", F.struct("column", "row")).alias("up"))
    now = store(seen.join(rings.select("z", F.col("ring").alias("up"), (F.col("area") > 0).alias("found")), ["z", "up"]))
    for _ in range(MAX_ROUNDS):
        if now.where("NOT found").isEmpty():
            break
        ahead = now.select("z", F.col("ring").alias("up"), F.col("up").alias("far"), F.col("found").alias("there"))
        after = store(now.join(ahead, ["z", "up"], "left").select("z", "ring", F.coalesce("far", "up").alias("up"), (F.col("found") | F.coalesce("there", F.lit(False))).alias("found")))
        forget(now)
        now = after
    else:
        raise RuntimeError("holes did not find their outlines")
    out = rings.join(now.select("z", "ring", F.col("up").alias("parent")), ["z", "ring"], "left")
    corners = named.join(_ranked(named), ["z", "start"]).select("z", "ring", "place", "x", "y")
    return out.select("z", "ring", "corners", "area", "parent"), corners


def outline_geojson(tiles: DataFrame) -> DataFrame:
    """(z, ring, geometry): a GeoJSON polygon for each outer ring, with its holes, in degrees. A polygon is one text, so its
    corners meet in one row."""
    rings, corners = outline_rings(tiles)
    side = F.pow(F.lit(2.0), F.col("z"))
    lon, lat = F.col("x") / side * 360 - 180, F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * F.col("y") / side))))
    point = F.concat(F.lit("["), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("]"))
    lines = corners.select("z", "ring", "place", point.alias("p")).groupBy("z", "ring").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "p"))), lambda v: v["p"]).alias("points"))
    text = F.concat(F.lit("["), F.array_join(F.concat(F.col("points"), F.slice("points", 1, 1)), ","), F.lit("]"))
    own = lines.join(rings, ["z", "ring"]).select("z", F.coalesce("parent", "ring").alias("ring"), F.struct(F.col("parent").isNotNull().alias("hole"), F.col("ring").alias("own"), text.alias("text")).alias("line"))
    each = own.groupBy("z", "ring").agg(F.transform(F.sort_array(F.collect_list("line")), lambda v: v["text"]).alias("lines"))
    return each.select("z", "ring", F.concat(F.lit('{"type":"Polygon","coordinates":['), F.array_join("lines", ","), F.lit("]}")).alias("geometry"))
