"""Classes of tiles against every edge, and a feed of changes against its last versions."""

import math
import random
from collections import Counter

import pytest

from tesselon.functions import geometry as G
from tesselon.functions.coords import WORLD
from tesselon.operators import masks
from tesselon.streaming import changes


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_of_tiles(spark, seed):
    rng = random.Random(seed)
    level, side = 5, WORLD / 32
    rings = []
    for _ in range(9):
        x, y, r, n = rng.uniform(-WORLD / 2, WORLD / 2), rng.uniform(-WORLD / 2, WORLD / 2), rng.uniform(0.3, 9) * side, rng.randint(3, 7)
        rings.append([[x + r * math.cos(2 * math.pi * k / n + seed), y + r * math.sin(2 * math.pi * k / n + seed)] for k in range(n)])
    rings[0].append(rings[0][0])
    flat = [[-3.2 * side, 2.5 * side], [4.3 * side, 2.5 * side], [4.3 * side, 6.5 * side], [-3.2 * side, 6.5 * side]]
    rings.append(flat)
    closed = [r if r[0] == r[-1] else [*r, r[0]] for r in rings]
    keys = [(x, y) for x in range(32) for y in range(32)]
    edges = masks.ring_edges(spark.createDataFrame([(r,) for r in rings] + [([],), ([[1.0, 2.0]],)], "points array<array<double>>"), level)
    got = {(r.x, r.y): r["class"] for r in masks.classify(spark.createDataFrame(keys * 2, "x long, y long"), edges, level).collect()}
    assert set(got) == set(keys)
    for x, y in keys:
        box = G.tile_box(level, x, y)
        hit = any(G.clip_segment(a, b, box) for r in closed for a, b in zip(r, r[1:], strict=False))
        middle = ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)
        expected = "partial" if hit else "inside" if G.point_in_rings(*middle, closed) else "outside"
        assert got[x, y] == expected


def test_empty_masks_and_tiles(spark):
    none = masks.ring_edges(spark.createDataFrame([], "points array<array<double>>"), 3)
    assert [tuple(r) for r in masks.classify(spark.createDataFrame([(1, 2)], "x long, y long"), none, 3).collect()] == [(1, 2, "outside")]
    assert masks.classify(spark.createDataFrame([], "x long, y long"), none, 3).count() == 0


def test_changes_and_deletions(spark, tmp_path):
    """Versions that come late, deletions, moves and rows without a place, over several batches."""
    rng = random.Random(3)
    rows = [(rng.randrange(25) if i % 40 else None, rng.randrange(10**6) if i % 37 else None, rng.random() < 0.2, rng.uniform(-180, 180) if i % 23 else None, rng.uniform(-80, 80)) for i in range(300)]
    schema = "key long, version long, deleted boolean, lon double, lat double"
    for n in range(3):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    log = str(tmp_path / "log")
    run = changes.follow_counts(feed, 2, log)
    assert run.awaitTermination(120) or not run.stop()
    last = {}
    for k, v, *rest in rows:
        if k is not None and v is not None and (k not in last or v > last[k][0]):
            last[k] = (v, *rest)
    expected = Counter()
    for _, deleted, lon, lat in last.values():
        if deleted or lon is None:
            continue
        for z in range(3):
            y = 0.5 - 0.5 * math.log(math.tan(math.radians(lat) / 2 + math.pi / 4)) / math.pi
            expected[z, int((lon / 360 + 0.5) * 2**z), int(y * 2**z)] += 1
    assert {tuple(r)[:3]: r.n for r in changes.counts(spark, log).collect()} == dict(expected)
