"""Rings of coverages, the Hilbert curve back and in boxes, mosaics, errors kept aside, parameters of imports."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tesselon.functions import coords as C
from tesselon.operators import errors, mosaic, outlines, tiles
from tesselon.plans.vpl import PipelineError, run_vpl
from tesselon.sources.containers import hilbert_number, tile_key


def rings_by_walk(cells):
    """For each ring its smallest side, corners and signed area, and the ring that it lies in."""
    step = ((1, 0), (0, 1), (-1, 0), (0, -1))
    out = ((0, -1), (1, 0), (0, 1), (-1, 0))
    corner = ((0, 0), (1, 0), (1, 1), (0, 1))
    sides = {(x, y, s) for x, y in cells for s in range(4) if (x + out[s][0], y + out[s][1]) not in cells}

    def follow(x, y, s):
        a, o = step[s], out[s]
        if (x + a[0], y + a[1]) not in cells:
            return x, y, (s + 1) % 4
        if (x + a[0] + o[0], y + a[1] + o[1]) not in cells:
            return x + a[0], y + a[1], s
        return x + a[0] + o[0], y + a[1] + o[1], (s + 3) % 4

    rings, left, ring_of = [], set(sides), {}
    while left:
        now = start = min(left)
        walk = []
        while True:
            walk.append(now)
            left.discard(now)
            now = follow(*now)
            if now == start:
                break
        turns = [(x + corner[s][0], y + corner[s][1]) for i, (x, y, s) in enumerate(walk) if walk[i - 1][2] != s]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(turns, turns[1:] + turns[:1], strict=True)) // 2
        rings.append((walk, turns, area))
        for side in walk:
            ring_of[side] = len(rings) - 1

    def outer(n):
        walk, _, area = rings[n]
        if area > 0:
            return n
        x, y, _ = min(w for w in walk if w[2] == 1)
        while (x - 1, y) in cells:
            x -= 1
        return outer(ring_of[x, y, 3])

    return rings, [outer(n) for n in range(len(rings))]


def number(z, side):
    return (side[1] * 2**z + side[0]) * 4 + side[2]


@pytest.mark.parametrize(("z", "share", "seed"), [(4, 0.5, 1), (5, 0.62, 2), (4, 0.9, 3), (3, 1.0, 4)])
def test_outline_rings(spark, z, share, seed):
    rng = random.Random(seed)
    cells = {(x, y) for x in range(2**z) for y in range(2**z) if rng.random() < share}
    rings, parents = rings_by_walk(cells)
    names = [min(number(z, s) for s in walk) for walk, _, _ in rings]
    expected = {(z, names[n], len(turns), area, names[parents[n]] if area < 0 else None) for n, (_, turns, area) in enumerate(rings)}
    table = spark.createDataFrame([(z, x, y) for x, y in cells] * 2 + [(1, 0, 1)], "z long, x long, y long").repartition(3)
    got, corners = outlines.outline_rings(table)
    assert {tuple(r) for r in got.where(f"z = {z}").collect()} == expected
    assert [tuple(r) for r in got.where("z = 1").collect()] == [(1, 8, 4, 1, None)]
    for n, (_, turns, _) in enumerate(rings):
        assert names[n] is not None and len(turns) >= 4
    walks = {}
    for r in sorted(corners.where(f"z = {z}").collect(), key=lambda r: r.place):
        walks.setdefault(r.ring, []).append((r.x, r.y))
    for n, (_, turns, _) in enumerate(rings):
        mine = walks[names[n]]
        at = turns.index(mine[0])
        assert any(mine == turns[i:] + turns[:i] for i in range(len(turns)) if turns[i] == mine[0]), (at, mine, turns)
    assert sum(a for _, _, a in rings) == len(cells)


def test_outline_as_geojson(spark):
    cells = [(3, x, y) for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (2, 1))]
    (r,) = outlines.outline_geojson(spark.createDataFrame(cells, "z long, x long, y long")).collect()
    shape = json.loads(r.geometry)
    assert shape["type"] == "Polygon" and [len(line) for line in shape["coordinates"]] == [5, 5]
    assert all(line[0] == line[-1] for line in shape["coordinates"])
    assert sorted({p[0] for p in shape["coordinates"][0]}) == [-180.0, 0.0] and max(p[1] for p in shape["coordinates"][0]) == pytest.approx(85.0511287798066)
    empty = spark.createDataFrame([], "z long, x long, y long")
    assert outlines.outline_geojson(empty).count() == 0


def test_hilbert_back(spark):
    rng = random.Random(1)
    ids = [*range(400), *[s + d for s in C.LEVEL_STARTS[1:31] for d in (-1, 0, 1)], *[rng.randrange(C.LEVEL_STARTS[31]) for _ in range(200)]]
    rows = spark.createDataFrame([(i,) for i in ids] + [(None,), (-5,)], "id long").select("id", C.hilbert_tile("id").alias("t"), C.hilbert_level("id").alias("z")).collect()
    for r in rows:
        if r.id is None or r.id < 0:
            assert r.t is None
        else:
            assert tuple(r.t) == tile_key(r.id) and r.z == r.t.z


def test_hilbert_of_all_levels(spark):
    rng = random.Random(2)
    tiles = [(z, *(rng.choice((0, (1 << z) - 1, rng.randrange(1 << z))) for _ in "xy")) for z in range(32) for _ in range(40)]
    table = spark.createDataFrame([*tiles, (3, None, 1), (None, 1, 1)], "z long, x long, y long").withColumn("id", C.hilbert_id("z", "x", "y"))
    for r in table.withColumn("t", C.hilbert_tile("id")).collect():
        if r.z is None or r.x is None:
            assert r.id is None and r.t is None
        else:
            assert r.id == hilbert_number(r.z, r.x, r.y) and tuple(r.t) == (r.z, r.x, r.y)


def test_hilbert_takes_few_steps(spark):
    """Four levels a step: less time for an id and its tile than for a Morton number, which goes bit by bit."""
    at = spark.range(0, 400_000, 1, 4).select(F.lit(30).cast("long").alias("z"), (F.col("id") * 2311 % (1 << 30)).alias("x"), (F.col("id") * 1543 % (1 << 30)).alias("y"))

    def seconds(value):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            at.select(F.max(value)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(C.hilbert_tile(C.hilbert_id("z", "x", "y"))) < 2 * seconds(C.morton("z", "x", "y"))


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_hilbert_ranges(most):
    rng = random.Random(most)
    for level in (0, 1, 5):
        n = 1 << level
        for _ in range(20):
            x0, x1 = sorted((rng.randrange(n), rng.randrange(n)))
            y0, y1 = sorted((rng.randrange(n), rng.randrange(n)))
            wanted = {hilbert_number(level, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
            found = C.hilbert_ranges(level, (x0, y0, x1, y1), most)
            assert len(found) <= most and all(a <= b for a, b in found)
            inside = {i for a, b in found for i in range(a, b + 1)}
            assert wanted <= inside and (most < 1000 or wanted == inside)
    assert C.hilbert_ranges(5, (3, 3, 2, 9)) == []


def test_boxes_prune_a_sorted_table(spark, tmp_path):
    """Row groups outside the box are not read."""
    grid = spark.range(1 << 14).select(F.lit(7).cast("bigint").alias("z"), (F.col("id") % 128).alias("x"), F.floor(F.col("id") / 128).cast("bigint").alias("y"))
    sorted_ = grid.withColumn("id", C.hilbert_id("z", "x", "y")).repartitionByRange(16, "id").sortWithinPartitions("id")
    sorted_.write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
    box = (10, 20, 30, 37)
    read = spark.read.parquet(str(tmp_path / "t"))
    out = read.where(C.in_hilbert_box(7, box))
    plan = out._jdf.queryExecution().executedPlan()
    assert {(r.x, r.y) for r in out.collect()} == {(x, y) for x in range(10, 31) for y in range(20, 38)}
    assert "PushedFilters: [Or(" in plan.toString().replace("PushedFilters: [IsNotNull(id), ", "PushedFilters: [")
    first, last = (f(v) for f, v in ((min, [a for a, _ in C.hilbert_ranges(7, box)]), (max, [b for _, b in C.hilbert_ranges(7, box)])))
    files = [f.asDict() for f in read.groupBy(F.input_file_name().alias("f")).agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()]
    runs = C.hilbert_ranges(7, box)
    touched = [f for f in files if any(a <= f["b"] and b >= f["a"] for a, b in runs)]
    assert len(touched) < len(files) / 2 and first <= last


def test_mosaic(spark):
    def blend(base, top):
        total = base[3] + top[3]
        if not total:
            return (0, 0, 0, 0)
        out = 255 if total >= 250 else total
        return (*[min(255, (base[c] * (out - top[3]) + top[c] * top[3] + out // 2) // out) for c in range(3)], out)

    rng = random.Random(2)
    rows = []
    for x in range(60):
        for source in rng.sample(range(6), rng.randint(1, 5)):
            kind = rng.random()
            alpha = lambda kind=kind: 255 if kind < 0.2 else 0 if kind < 0.35 else rng.choice([0, 1, 60, 125, 249, 254, 255])
            rows.append((3, x, 0, source, [(rng.randrange(256), rng.randrange(256), rng.randrange(256), alpha()) for _ in range(4)]))
    expected = {}
    for x in {r[1] for r in rows}:
        mine = [r for r in sorted(rows) if r[1] == x and any(p[3] for p in r[4])]
        solid = [r for r in mine if all(p[3] == 255 for p in r[4])]
        if solid:
            expected[x] = [tuple(p) for p in solid[0][4]]
        elif mine:
            top = [tuple(p) for p in mine[0][4]]
            for r in mine[1:]:
                top = [blend(b, t) for b, t in zip(r[4], top, strict=True)]
            expected[x] = top
    schema = "z long, x long, y long, source int, pixels array<struct<r: int, g: int, b: int, a: int>>"
    got = {r.x: [tuple(p) for p in r.pixels] for r in mosaic.assemble(spark.createDataFrame(rows, schema).repartition(4)).collect()}
    assert got == expected
    assert mosaic.assemble(spark.createDataFrame([], schema)).count() == 0


def test_errors_are_kept_aside(spark):
    rows = spark.createDataFrame([(1, "1"), (2, "x"), (3, None), (4, "4")], "id long, v string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def check(v):
        calls.add(1)
        return f"no number: {v}" if v == "x" else None

    split = errors.split_errors(rows, check("v"), "numbers", ["id"])
    assert (split.total, split.errors) == (4, 1) and {r.id for r in split.rows.collect()} == {1, 3, 4}
    assert [tuple(r) for r in split.failed.collect()] == [(2, "no number: x")] and calls.value == 4, "worked on once"
    with pytest.raises(errors.FailedRows, match="1 of 4"):
        split.or_fail()
    none = errors.split_errors(rows.where("id = 9"), F.lit(None), "nothing")
    assert (none.total, none.errors) == (0, 0) and none.or_fail().count() == 0


def test_broken_tiles_in_one_pass(spark):
    point = [(0, 0, x, "a", x, x, 1, [[[x, x]]], {"k": "1"}) for x in range(3)]
    made = tiles.encode(spark.createDataFrame(point, "z long, y long, x long, layer string, feat_no long, id long, kind int, parts array<array<array<long>>>, props map<string,string>"))
    bad = made.withColumn("data", F.when(F.col("x") == 1, F.unhex(F.lit("1AFF")).cast("binary")).otherwise(F.col("data")))
    split = tiles.decode_recorded(bad)
    assert {r.id for r in split.rows.collect()} == {0, 2} and [tuple(r)[:3] for r in split.failed.collect()] == [(0, 1, 0)]
    assert split.errors == 1 and split.rows.columns == tiles.COLUMNS


def test_parameters_of_imports(spark, tmp_path):
    lines = ["lon,lat,n"] + [f"{3 + i / 1000},2,{i}" for i in range(40)]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n")
    read = lambda more: run_vpl(spark, f"from_csv filename='{tmp_path}/p.csv' lon_column=lon lat_column=lat min_zoom=5 max_zoom=5 {more}")
    assert read("point_reduction=none").features.count() == 40
    unit = 360 / 2**5 / 4096
    kept, last = 0, None
    for i in range(40):
        if last is None or i / 1000 - last >= 16 * unit - 1e-12:
            kept, last = kept + 1, i / 1000
    assert read("").features.count() == kept < 40
    assert 5 < read("point_reduction=drop_rate point_reduction_value=0.5").features.count() < 35
    assert read("point_reduction=none max_tile_bytes=50").tiles.count() == 0
    for wrong in ("point_reduction=some", "max_tile_bytes=many"):
        with pytest.raises(PipelineError):
            read(wrong)
