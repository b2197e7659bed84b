"""Thinning of points by a least distance, exactly and in parallel."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.operators.stored import forget, maybe_broadcast, store

#: Cells along a side of the blocks in which points are decided one after the other, and the first points of a
#: cell that are looked at in a round: together they bound the rows of a task.
BLOCK, EACH = 64, 16
#: Cells whose points can lie within the distance: a cell's diagonal is just below it.
REACH = 2


def _decide(distance: float, block: int):
    """Points that are kept for certain, in one block and a ring of REACH cells around it, by their order.

    A point goes if a kept one is near. It is kept if no earlier one that may yet be kept is near: none that is
    undecided, and none in a cell whose later points are not here, unless that cell has its kept point."""
    square = distance * distance
    steps = range(-REACH, REACH + 1)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["o", "x", "y"], kind="stable")
        last = rows[rows["over"]]
        limit = {(i, j): at for i, j, *at in zip(last["i"], last["j"], last["o"], last["x"], last["y"], strict=True)}
        rows = rows[~rows["over"]]
        own = (rows["i"] // block == key[0]) & (rows["j"] // block == key[1])
        kept: dict[tuple, tuple] = {}
        open_: dict[tuple, list] = {}
        out = []
        for o, x, y, i, j, mine in zip(rows["o"], rows["x"], rows["y"], rows["i"], rows["j"], own, strict=True):
            cells = [(i + a, j + b) for a in steps for b in steps]
            near = lambda p, x=x, y=y: (p[0] - x) ** 2 + (p[1] - y) ** 2 < square
            if any(c in kept and near(kept[c]) for c in cells):
                continue
            if not mine or any(c not in kept and (c in limit and limit[c] < [o, x, y] or any(map(near, open_.get(c, ())))) for c in cells):
                open_.setdefault((i, j), []).append((x, y))
            else:
                kept[i, j] = (x, y)
                out.append((o, x, y, i, j))
        return pd.DataFrame(out, columns=["o", "x", "y", "i", "j"])

    return run


def thin_by_distance(points: DataFrame, distance: float, order: str = "id", x: str = "mx", y: str = "my", block: int = BLOCK, each: int = EACH) -> DataFrame:
    """The points, in the order of a column, that lie at least ``distance`` from every point kept before them.

    Points with a null, infinite or undefined coordinate go; of points that share a place and an order one stays;
    a distance of 0 or less keeps all. The order is a whole number, null the smallest; points of one order follow one
    another by x and y. An empty table gives no rows. Other columns pass through.

    Points lie in square cells just small enough that two of a cell are too near to one another, so a cell keeps one at
    most. A round looks at the first ``each`` points of each cell, which are cut off before the shuffle, and decides them in
    blocks of cells with a ring around them, as far as what is known there allows; blocks are shifted from round
    to round. All points near those just kept then go by an equi-join on cells. The earliest point left is decided in
    each round. No task holds more than ``each`` points a cell, however many a place has. Rounds are few unless the
    order itself runs across the map, when they grow with the number of blocks along its way.
    """
    if distance <= 0:
        return points
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    number = F.coalesce(F.col(order).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    side = distance / 2**0.5 * (1 - 1e-9)
    cell = lambda c: F.floor(F.col(c) / side).cast("bigint").alias
    spots = points.where(finite(x) & finite(y)).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.min(number).alias("o"))
    rest = store(spots.select("o", "x", "y", cell("x")("i"), cell("y")("j")))
    ring = lambda c: F.explode(F.sequence(F.col(c) - REACH, F.col(c) + REACH))
    blocks = lambda c: F.explode(F.array_distinct(F.transform(F.array(F.lit(-REACH), F.lit(REACH)), lambda d: F.floor((F.col(c) + d) / block))))
    found: list[DataFrame] = []
    while not rest.isEmpty():
        shift = len(found) % 2 * block // 2
        rank = F.row_number().over(Window.partitionBy("i", "j").orderBy("o", "x", "y"))
        active = rest.withColumn("rank", rank).where(F.col("rank") <= each + 1)
        active = active.select("o", "x", "y", (F.col("i") + shift).alias("i"), (F.col("j") + shift).alias("j"), (F.col("rank") > each).alias("over"))
        dealt = active.withColumn("bi", blocks("i")).withColumn("bj", blocks("j"))
        kept = dealt.groupBy("bi", "bj").applyInPandas(_decide(distance, block), "o bigint, x double, y double, i bigint, j bigint")
        kept = store(kept.select("o", "x", "y", (F.col("i") - shift).alias("i"), (F.col("j") - shift).alias("j")))
        found.append(kept)
        around = kept.select(F.col("x").alias("kx"), F.col("y").alias("ky"), "j", ring("i").alias("ki"))
        around = store(around.select("kx", "ky", "ki", ring("j").alias("kj")))
        near = F.pow(F.col("kx") - F.col("x"), 2) + F.pow(F.col("ky") - F.col("y"), 2) < distance * distance
        left = store(rest.join(maybe_broadcast(around, 32), (F.col("i") == F.col("ki")) & (F.col("j") == F.col("kj")) & near, "left_anti"))
        for done in (rest, around):
            forget(done)
        rest = left
    forget(rest)
    if not found:
        return points.limit(0)
    keep = store(reduce(DataFrame.unionByName, found).select("o", "x", "y"))
    for done in found:
        forget(done)
    same = (number == keep["o"]) & (points[x].cast("double") == keep["x"]) & (points[y].cast("double") == keep["y"])
    return points.join(keep, same, "left_semi").dropDuplicates([order, x, y])
