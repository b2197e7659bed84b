"""Simplification that keeps shared borders shared.

Lines are cut into arcs at junctions, points whose neighbours differ from those of a plain line. An arc
between two junctions is the same sequence of points in every shape that has it, so simplifying it in
one fixed direction gives every shape the same result, wherever it is worked on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.functions import geometry as G


def lines_of(geometry: dict) -> list[list]:
    """The lines or closed rings of a geometry, as they stand in it."""
    kind, c = geometry["type"], geometry["coordinates"]
    return {"LineString": [c], "MultiLineString": c, "Polygon": c}.get(kind, [r for p in c for r in p] if kind == "MultiPolygon" else [])


def junctions(shapes: DataFrame) -> DataFrame:
    """(x, y) of points that do not have exactly two neighbours over all shapes, or where a line ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["geometry"]:
                for line in lines_of(json.loads(text)):
                    for a, b in zip(line, line[1:], strict=False):
                        rows += [(*a[:2], *b[:2]), (*b[:2], *a[:2])]
                    if line[0][:2] != line[-1][:2]:
                        rows += [(*p[:2], None, None) for p in (line[0], line[-1])]
            yield pd.DataFrame(rows, columns=["x", "y", "nx", "ny"], dtype=float)

    steps = shapes.select("geometry").mapInPandas(run, "x double, y double, nx double, ny double").distinct()
    return steps.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.count("nx").alias("k")).where("k <> 2 OR n <> k").select("x", "y")


def simplify_arcs(line: list, fixed: set, tolerance: float) -> list:
    """A line with its arcs between fixed points simplified, each in the direction from its smaller end."""
    points = [tuple(p[:2]) for p in line]
    closed = points[0] == points[-1]
    cuts = [i for i, p in enumerate(points) if p in fixed]
    if closed:
        # A ring is turned so that it begins at a fixed point, or else at its smallest.
        start = cuts[0] if cuts else min(range(len(points) - 1), key=lambda i: points[i])
        points = points[start:-1] + points[:start] + [points[start]]
        cuts = [i for i, p in enumerate(points) if p in fixed]
    cuts = sorted({0, *cuts, len(points) - 1})
    out = points[:1]
    for a, b in zip(cuts, cuts[1:], strict=False):
        arc = points[a : b + 1]
        turn = (arc[-1], arc[-2]) < (arc[0], arc[1])
        arc = arc[::-1] if turn else arc
        kept = G.simplify(arc, tolerance)
        if arc[0] == arc[-1] and len(kept) < 4:
            kept = [arc[0], arc[len(arc) // 3], arc[2 * len(arc) // 3], arc[-1]]
        out += (kept[::-1] if turn else kept)[1:]
    return [list(p) for p in out]


def simplify_shared(shapes: DataFrame, tolerance: float) -> DataFrame:
    """Shapes (id, geometry, props) simplified to a tolerance in the units of their coordinates. Junctions
    are found by aggregation and brought to the shapes that touch them by a join on the point, so no task
    needs more than one shape and its own junctions."""
    keyed = shapes.withColumn("_key", F.xxhash64("id", "geometry"))

    def vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {(k, *p[:2]) for k, text in zip(batch["_key"], batch["geometry"], strict=True) for line in lines_of(json.loads(text)) for p in line}
            yield pd.DataFrame(sorted(rows), columns=["_key", "x", "y"])

    touched = keyed.select("_key", "geometry").mapInPandas(vertices, "_key long, x double, y double").join(junctions(shapes), ["x", "y"])
    own = touched.groupBy("_key").agg(F.collect_set(F.struct("x", "y")).alias("_fixed"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, fixed in zip(batch["geometry"], batch["_fixed"], strict=True):
                g = json.loads(text)
                points = {(p["x"], p["y"]) for p in (fixed if fixed is not None else ())}
                slim = lambda line, points=points: simplify_arcs(line, points, tolerance)
                c = g["coordinates"]
                if g["type"] == "LineString":
                    g["coordinates"] = slim(c)
                elif g["type"] in ("Polygon", "MultiLineString"):
                    g["coordinates"] = [slim(line) for line in c]
                elif g["type"] == "MultiPolygon":
                    g["coordinates"] = [[slim(ring) for ring in p] for p in c]
                out.append(json.dumps(g))
            yield batch.assign(geometry=out).drop(columns=["_fixed"])

    return keyed.join(own, "_key", "left").drop("_key").mapInPandas(run, shapes.schema)
