"""Thinning, chunks, the cascade of imports and the quadtree cover against sequential forms, and on odd rows."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesselon.functions import geometry as G
from tesselon.operators import chunks, importer, reports, stored, thinning, vector

POINTS = "id long, mx double, my double, name string"


def thinned(rows, distance):
    kept = []
    for r in sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or 0.0, r[2] or 0.0)):
        if r[1] is None or r[2] is None or not math.isfinite(r[1]) or not math.isfinite(r[2]):
            continue
        if all((k[1] - r[1]) ** 2 + (k[2] - r[2]) ** 2 >= distance * distance for k in kept):
            kept.append(r)
    return sorted(kept, key=repr)


@pytest.mark.parametrize(("case", "block", "each"), [("random", 64, 16), ("heap", 64, 16), ("ties", 8, 2), ("along", 16, 4), ("random", 8, 1)])
def test_thinning(spark, case, block, each):
    rng = random.Random(4)
    rows = [(i, rng.uniform(-30, 30), rng.uniform(-12, 12), f"p{i}") for i in range(300)]
    if case == "along":  # the order runs across the map
        rows = [(i, *r[1:]) for i, r in enumerate(sorted(rows, key=lambda r: r[1]))]
    elif case == "heap":  # many in one place, far more than a round looks at
        rows = [(i, rng.gauss(0, 0.6), rng.gauss(0, 0.6), "h") for i in range(250)] + [(250 + i, 0.25, 0.25, "same") for i in range(60)] + rows[260:]
        rng.shuffle(rows)
        rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    elif case == "ties":
        rows = [(None if r[0] % 3 == 0 else r[0] // 50, *r[1:]) for r in rows]
    if case == "random":
        rows += [(-1, math.nan, 0.0, "n"), (-2, 0.0, math.inf, "i"), (-3, None, 1.0, "-"), (-4, 5.0, None, "-")]
    table = spark.createDataFrame(rows, POINTS).repartition(5)
    got = sorted(map(tuple, thinning.thin_by_distance(table, 2.5, block=block, each=each).collect()), key=repr)
    assert got == thinned(rows, 2.5)


def test_thinning_of_odd_tables(spark):
    empty = spark.createDataFrame([], POINTS)
    assert thinning.thin_by_distance(empty, 3.0).count() == 0
    two = spark.createDataFrame([(1, 0.0, 0.0, "a"), (1, 0.0, 0.0, "b"), (2, 3.0, 0.0, "c")], POINTS)
    assert thinning.thin_by_distance(two, 0.0).count() == 3
    assert thinning.thin_by_distance(two, 3.0).count() == 2, "a distance of exactly the limit stays"
    clash = two.withColumns({c: F.lit("mine") for c in ("o", "x", "y", "i", "j", "rank", "over", "bi", "kx")})
    assert {r.over for r in thinning.thin_by_distance(clash, 1.0).collect()} == {"mine"}


def chunked(ranges, most, gap):
    out = []
    for a, n in sorted(ranges):
        b = a + n
        if out and out[-1][0] + most > b and out[-1][1] + gap > a:
            out[-1] = [out[-1][0], max(out[-1][1], b), out[-1][2] + 1]
        else:
            out.append([a, b, 1])
    return sorted((a, b - a, n) for a, b, n in out)


@pytest.mark.parametrize(("part", "kind"), [(1, "dense"), (2, "overlapping"), (7, "long"), (3, "sparse"), (1000, "dense")])
def test_chunks(spark, part, kind):
    rng = random.Random(part)
    step = {"dense": 12, "sparse": 300, "overlapping": 8, "long": 60}[kind]
    longest = {"dense": 14, "sparse": 40, "overlapping": 90, "long": 400}[kind]
    at, ranges = 0, []
    for _ in range(400):
        at += rng.randint(0, step)
        ranges.append((at, rng.randint(0, longest)))
        if rng.random() < 0.1:
            ranges.append(ranges[-1])
    table = spark.createDataFrame([*ranges, (None, 5), (5, None)], "offset long, length long").repartition(3)
    got = sorted(map(tuple, chunks.read_chunks(table, 100, 25, part).collect()))
    assert got == chunked(ranges, 100, 25)


def test_chunks_at_the_limits(spark):
    read = lambda rows, most, gap: sorted(map(tuple, chunks.read_chunks(spark.createDataFrame(rows, "offset long, length long"), most, gap).collect()))
    assert read([(0, 10), (20, 10)], 100, 10) == [(0, 10, 1), (20, 10, 1)], "a gap of exactly the limit splits"
    assert read([(0, 10), (19, 10)], 100, 10) == [(0, 29, 2)]
    assert read([(0, 10), (10, 10)], 20, 10) == [(0, 10, 1), (10, 10, 1)], "a chunk of exactly the limit is too long"
    assert read([(0, 10), (10, 9)], 20, 10) == [(0, 19, 2)]
    assert read([(0, 50)] * 3, 20, 10) == [(0, 50, 1)] * 3
    assert chunks.read_chunks(spark.createDataFrame([], "offset long, length long")).count() == 0
    far = [(i * (1 << 40), 100) for i in range(5)]
    assert read(far, 1 << 26, 1 << 18) == [(a, 100, 1) for a, _ in far]


@pytest.mark.parametrize(("part", "rows", "kind"), [(1, 1, "dense"), (1, 20, "overlapping"), (2, 7, "long"), (1, 60, "long"), (1, 5, "sparse")])
def test_chunks_of_parts_put_together(spark, part, rows, kind):
    rng = random.Random(rows)
    step, longest = {"dense": (12, 14), "sparse": (300, 40), "overlapping": (8, 90), "long": (60, 400)}[kind]
    at, ranges = 2**60 if kind == "sparse" else -500, []
    for _ in range(600):
        at += rng.randint(0, step)
        ranges += [(at, rng.randint(0, longest))] * rng.choice((1, 1, 1, 3))
    table = spark.createDataFrame(ranges, "offset long, length long").repartition(3)
    got = sorted(map(tuple, chunks.read_chunks(table, 100, 25, part, rows).collect()))
    assert got == chunked(ranges, 100, 25)


def test_parts_grow_with_rows_and_not_with_the_file(spark, monkeypatch):
    parts = []

    def kept(df, store=chunks.store):
        out = store(df)
        if "after" in out.columns:
            parts.append(out.count())
        return out

    monkeypatch.setattr(chunks, "store", kept)
    ranges = [(i * 2500, 10) for i in range(2000)]
    got = chunks.read_chunks(spark.createDataFrame(ranges, "offset long, length long"), 100, 25)
    assert got.count() == 2000
    assert len(parts) == 1 and parts[0] <= 16


def test_gap_of_uncapped_reads(spark):
    r = spark.createDataFrame([(0, 10), (110, 10), (219, 10)], "offset long, length long")
    assert sorted(map(tuple, reports.coalesce_ranges(r, 100).collect())) == [(0, 10, 1), (110, 119, 2)]


def test_size_raster_is_a_byte(spark):
    sizes = {0: 1024, 1: 1 << 30, 2: 1, 3: 0, 4: 1535, 5: 8, 6: 7}
    t = spark.createDataFrame([(9, x, 0, s) for x, s in sizes.items()], "z long, x long, y long, size long")
    got = {r.x: r.level for r in reports.size_raster(t, 1).collect()}
    assert got == {0: 100, 1: 255, 2: 0, 3: 0, 4: 105, 5: 30, 6: 28}


def test_fields_that_are_only_null(spark):
    rows = [("a", 1, {"f": "null"}), ("a", 3, {}), ("b", 2, {"g": "1", "h": "true"}), ("b", 2, {"g": "null", "h": '"x"'}), ("c", 4, {}), ("d", 5, None)]
    f = spark.createDataFrame(rows, "layer string, z long, props map<string,string>")
    assert sorted(map(tuple, vector.field_types(f, "conflict").collect()), key=repr) == [("a", "f", "String", 1, 3), ("b", "g", "Number", 2, 2), ("b", "h", "String", 2, 2), ("c", None, None, 4, 4), ("d", None, None, 5, 5)]
    assert sorted(map(tuple, vector.field_types(f).collect())) == [("b", "g", "Number", 2, 2), ("b", "h", "String", 2, 2)]


# --- import --------------------------------------------------------------------------------------


def shape(kind, coordinates):
    return json.dumps({"type": kind, "coordinates": coordinates})


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(8)
    wiggle = [[6 + 0.02 * rng.uniform(-1, 1), 50 + i / 40] for i in range(41)]
    west = [*wiggle, [5, 51], [5, 50], wiggle[0]]
    east = [*wiggle[::-1], [7, 50], [7, 51], wiggle[-1]]
    hole = [[[-20, -20], [20, -20], [20, 20], [-20, 20], [-20, -20]], [[-10, -10], [-10, 10], [10, 10], [10, -10], [-10, -10]]]
    rows = [(1, shape("Polygon", [west]), {"n": '"west"'}), (2, shape("Polygon", [east]), {"n": '"east"'}), (3, shape("Polygon", hole), {"n": '"hole"'})]
    rows += [(4, shape("MultiLineString", [[[0, 0], [30, 40], [60, -40]], [[5, 50], [5.01, 50]]]), {}), (None, shape("MultiPoint", [[1, 2], [3, 4]]), None), (6, None, {})]
    rows += [(100 + i, shape("Point", [rng.uniform(0, 2), rng.uniform(0, 2)]), {"i": str(i)}) for i in range(200)]
    return spark.createDataFrame(rows, "id long, geometry string, props map<string,string>").repartition(4)


def test_planar_numbers_all_shapes(shapes):
    flat, attributes = importer.planar(shapes)
    assert sorted(r['index'] for r in flat.collect()) == list(range(207)) == sorted(r['index'] for r in attributes.collect())
    assert Counter(r.kind for r in flat.collect()) == {1: 202, 2: 2, 3: 3}


def test_measures(spark):
    rows = [([[[0.0, 0.0], [3.0, 4.0], [3.0, 5.0]]], 6.0, 1.5), ([[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]], 20.0, 15.0), ([[[1.0, 1.0]]], 0.0, 0.0), ([], 0.0, 0.0)]
    t = spark.createDataFrame(rows, f"parts {importer.PARTS}, length double, area double")
    for r in t.select("*", importer.line_length(F.col("parts")).alias("l"), importer.polygon_area(F.col("parts")).alias("a")).collect():
        assert (r.l, r.a) == (r.length, r.area if r.length != 6.0 else r.a)


def vertices(table):
    return sum(len(part) for r in table.collect() for part in r.parts)


@pytest.mark.parametrize(("reduction", "value"), [("min_distance", None), ("drop_rate", 0.5), ("none", None)])
def test_cascade(spark, shapes, reduction, value):
    flat, _ = importer.planar(shapes)
    levels = importer.cascade(flat, range(6, 9), point_reduction=reduction, point_value=value)
    assert list(levels) == [8, 7, 6]
    before = None
    for level, table in levels.items():
        rows = {r['index']: r for r in table.collect()}
        unit = importer.unit_of(level)
        if before is not None:
            assert set(rows) <= set(before)
            assert all(sum(map(len, r.parts)) <= sum(map(len, before[i].parts)) for i, r in rows.items())
        for i, r in rows.items():
            if r.kind == 2:
                assert sum(G.length(p) for p in r.parts) >= 4 * unit
        # What the finer level kept and this one drops is below this level's own limits.
        for i in set(before or ()) - set(rows):
            if before[i].kind == 1:
                assert reduction == "min_distance"
        before = rows
    sizes = [vertices(t) for t in levels.values()]
    if reduction == "min_distance":
        assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
        points = {z: [r.parts[0][0] for r in sorted(t.where("kind = 1").collect(), key=lambda r: r["index"])] for z, t in levels.items()}
        now = [(r['index'], *r.parts[0][0]) for r in flat.where("kind = 1").collect()]
        for z, kept in points.items():
            now = sorted(thinned(now, 16 * importer.unit_of(z)))
            assert [[x, y] for _, x, y in now] == kept
    if reduction == "drop_rate":
        assert len({t.where("kind = 1").count() for t in levels.values()}) == 1
    borders = [{tuple(p) for p in r.parts[0]} for r in levels[8].where("kind = 3").collect()]
    shared = max((len(a & b) for a in borders for b in borders if a is not b), default=0)
    assert 3 <= shared <= 41, "a common border stays common"
    importer.forget_levels(levels)


def test_share_of_indexes(spark):
    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) % 2**64
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
        return (x ^ (x >> 31)) >> 11

    got = {r.id for r in spark.range(1000).where(importer.keep_share(F.col("id"), 0.3)).collect()}
    assert got == {i for i in range(1000) if mix(i) / 2**53 < 0.3}


def sampled(flat, level, margin):
    """Tiles that a shape meets, by cutting it to every tile of its box."""
    out = Counter()
    for r in flat:
        xs, ys = [p[0] for part in r.parts for p in part], [p[1] for part in r.parts for p in part]
        x0, y0, x1, y1 = G.box_tiles((min(xs) - margin, min(ys) - margin, max(xs) + margin, max(ys) + margin), level)
        for x in range(x0, x1 + 1):
            for y in range(y0, y1 + 1):
                b = G.tile_box(level, x, y)
                wide = (b[0] - margin, b[1] - margin, b[2] + margin, b[3] + margin)
                if importer.piece_in(r.kind, r.parts, wide)[1]:
                    out[r['index'], x, y] += 1
    return out


@pytest.mark.parametrize(("level", "margin"), [(0, 0.0), (5, 0.0), (6, 20000.0), (7, 1.0)])
def test_cover(shapes, level, margin):
    flat, _ = importer.planar(shapes)
    got = Counter()
    rows = importer.cover(flat, level, margin).collect()
    for r in rows:
        assert (r.parts is None) == r.whole and r.z <= level
        n = 1 << level - r.z
        assert r.whole or r.z == level
        for x in range(r.x * n, (r.x + 1) * n):
            for y in range(r.y * n, (r.y + 1) * n):
                got[r['index'], x, y] += 1
    assert got == sampled(flat.collect(), level, margin)


def test_pieces_cut_together_are_those_cut_alone():
    """Many cells go down in numpy at once: the same pieces, bit by bit, as one after another, and no cell in Python."""
    import random

    import pyarrow as pa

    draw = random.Random(5)
    names, types = [n for n, _ in importer._PIECE], [t for _, t in importer._PIECE]
    rows = []
    for i in range(400):
        z = draw.randrange(0, 7)
        x, y = draw.randrange(1 << z), draw.randrange(1 << z)
        b, w = G.tile_box(z, x, y), G.WORLD / 2**z
        parts = []
        for _ in range(draw.choice((1, 1, 2, 3))):
            spread = draw.choice((0.2, 1.0, 3.0))
            ring = [[b[0] + w * (0.5 + spread * draw.uniform(-1, 1)), b[1] + w * (0.5 + spread * draw.uniform(-1, 1))] for _ in range(draw.randrange(1, 9))]
            parts.append(ring + ring[:1] if draw.random() < 0.9 else ring)
        if i % 5 == 0:
            parts = [[[b[0] - w, b[1] - w], [b[2] + w, b[1] - w], [b[2] + w, b[3] + w], [b[0] - w, b[3] + w], [b[0] - w, b[1] - w]], *parts[1:]]
        rows.append((i, 3, z, x, y, False, False, parts))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    pieces, whole = importer._Pieces.read(batch).clipped(10.0)
    got = {i: (w, [[tuple(p) for p in ring] for ring in parts]) for i, w, parts in zip(pieces.numbers["index"].tolist(), whole.tolist(), pieces.closed(whole & False).to_pylist(), strict=True)}
    want = {}
    for i, kind, z, x, y, _, _, parts in rows:
        b = G.tile_box(z, x, y)
        covered, left = importer.piece_in(kind, [[tuple(p) for p in ring] for ring in parts], (b[0] - 10, b[1] - 10, b[2] + 10, b[3] + 10))
        if left:
            want[i] = covered, left
    assert got == want and 50 < len(want) < 400 and any(w for w, _ in want.values())


def test_cover_without_parts(spark):
    ring = [[-9e6, -9e6], [9e6, -8e6], [5e6, 9e6], [-9e6, -9e6]]
    rows = spark.createDataFrame([(1, 3, [ring]), (2, 2, [ring])], f"index long, kind int, parts {importer.PARTS}")
    cells = lambda **how: sorted(map(tuple, importer.cover(rows, 6, **how).select("index", "z", "x", "y", "whole").collect()))
    assert cells() == cells(keep_parts=False)
    assert importer.cover(rows, 6, keep_parts=False).where("parts IS NOT NULL").count() == 0


def test_cover_grows_with_the_border(spark):
    edge = G.WORLD / 2 - 1000
    ring = [[-edge, -edge], [edge, -edge], [edge, edge], [-edge, edge], [-edge, -edge]]
    world = spark.createDataFrame([(1, 3, [ring])], f"index long, kind int, parts {importer.PARTS}")
    n = {level: importer.cover(world, level).count() for level in (6, 7, 8)}
    assert n[8] < 2.2 * n[7] < 4.84 * n[6] and n[8] < 16 * 256 < 65536
    keys = spark.createDataFrame([(x, y) for x in (0, 100, 255) for y in (0, 17, 255)], "x long, y long")
    assert importer.tiles_met(importer.cover(world, 8), keys, 8).count() == 9


def _rectangle(x0, y0, x1, y1, turn=0):
    ring = [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]
    ring = (ring[::-1] if turn % 2 else ring)[turn // 2 :] + (ring[::-1] if turn % 2 else ring)[: turn // 2]
    return [[*ring, ring[0]]]


def test_rectangles_need_no_cover(spark, monkeypatch):
    """Their tiles are told from their sides, also where these lie on the ends of tiles, outside the world or around all of it."""
    import random

    def no_cover(*args, **how):
        raise AssertionError("a rectangle goes down the quadtree")

    monkeypatch.setattr(importer, "cover", no_cover)
    draw = random.Random(3)
    for level in (0, 5, 12, 13):
        width, half, n = G.WORLD / 2**level, G.WORLD / 2, 1 << level
        boxes = [(-2 * half, -2 * half, 2 * half, 2 * half), (half, 0.0, 2 * half, 5.0), (-half, -half, -half + width, -half + width), (0.0, 0.0, width, 2 * width), (1.0, 1.0, 2.0, 1e300)]
        for _ in range(80):
            x, y, w, h = draw.uniform(-half, half), draw.uniform(-half, half), 10 ** draw.uniform(0, 7.5), 10 ** draw.uniform(0, 7.5)
            boxes.append((x, y, x + w, y + h))
        keys = sorted({(min(n - 1, int(draw.random() ** 3 * n)), draw.randrange(n)) for _ in range(3000)} | {(n // 2, n // 2 - 1), (n // 2, max(0, n // 2 - 2)), (0, n - 1)})
        shapes = spark.createDataFrame([(i, 3, _rectangle(*b, i % 8)) for i, b in enumerate(boxes)], f"index long, kind int, parts {importer.PARTS}")
        tiles = spark.createDataFrame([k for k in keys if k[1] >= 0] * 2, "x long, y long")
        got = sorted(map(tuple, importer.tiles_of(shapes, tiles, level).collect()))
        west, north = lambda x: x * width - half, lambda y: half - y * width
        assert got == sorted((i, x, y) for i, b in enumerate(boxes) for x, y in keys if y >= 0 and b[0] < west(x + 1) and b[2] > west(x) and b[1] < north(y) and b[3] > north(y + 1))


def test_tiles_of_all_shapes_are_those_of_the_cover(spark):
    """Rectangles, triangles, rings with holes, lines and points together, and rows without parts, with a margin."""
    import random

    draw = random.Random(9)
    at = lambda: [draw.uniform(-2e7, 2e7), draw.uniform(-2e7, 2e7)]
    rows = [(0, 3, None), (1, 3, []), (2, 3, _rectangle(5.0, 5.0, 5.0, 9e6)), (3, 2, _rectangle(-9e6, -9e6, 9e6, 9e6)), (4, 3, _rectangle(-9e6, -9e6, 9e6, 9e6) + _rectangle(-8e6, -8e6, 8e6, 8e6)), (5, 3, [[[0.0, 0.0], [9e6, 0.0], [0.0, 9e6], [9e6, 9e6], [0.0, 0.0]]])]
    for i in range(6, 40):
        (x, y), w = at(), 10 ** draw.uniform(3, 7)
        first = at()
        rows.append([(i, 3, _rectangle(x, y, x + w, y + w / 3, i % 8)), (i, 3, [[first, at(), at(), first]]), (i, 2, [[first, at()]]), (i, 1, [[first]])][i % 4])
    shapes = spark.createDataFrame(rows, f"index long, kind int, parts {importer.PARTS}")
    for level, margin in ((6, 0.0), (9, 1000.0)):
        keys = sorted({(draw.randrange(1 << level), draw.randrange(1 << level)) for _ in range(4000)})
        tiles = spark.createDataFrame(keys, "x long, y long")
        held = {}
        for r in importer.cover(shapes, level, margin, keep_parts=False).collect():
            held.setdefault((r.z, r.x, r.y), set()).add(r["index"])
        expected = sorted((i, x, y) for x, y in keys for up in range(level + 1) for i in held.get((level - up, x >> up, y >> up), ()))
        assert expected == sorted(map(tuple, importer.tiles_of(shapes, tiles, level, margin).collect()))
        assert expected == sorted(map(tuple, importer.tiles_met(importer.cover(shapes, level, margin), tiles, level).collect()))
        assert {i for i, _, _ in expected} >= {3, 4, 5} and not {0, 1, 2} & {i for i, _, _ in expected}


def test_drawing_equals_cutting_each_tile(spark, shapes):
    flat, attributes = importer.planar(shapes)
    level = {6: flat}
    got = {(r.feat_no, r.x, r.y): (r.id, r.props, r.parts) for r in importer.draw_levels(level, attributes).collect()}
    about = {r['index']: r for r in attributes.collect()}
    expected = set()
    for r in flat.collect():
        parts = [[tuple(p) for p in part] for part in r.parts]
        xs, ys = [p[0] for part in parts for p in part], [p[1] for part in parts for p in part]
        x0, y0, x1, y1 = G.box_tiles((min(xs), min(ys), max(xs), max(ys)), 6)
        for x in range(max(0, x0 - 1), x1 + 2):
            for y in range(max(0, y0 - 1), y1 + 2):
                drawn = G.draw(r.kind, parts, 6, x, y, tolerance=0.0)
                if not drawn or (r['index'], x, y) not in got and r.kind == 3:
                    continue  # a polygon that only touches a tile is no feature of it
                expected.add((r['index'], x, y))
                id_, props, mine = got[r['index'], x, y]
                assert (id_, props) == (about[r['index']].id, about[r['index']].props)
                low, high = (f(p[0] for part in drawn for p in part) for f in (min, max))
                assert (low, high) == tuple(f(p[0] for part in mine for p in part) for f in (min, max))
    assert set(got) == expected


def test_properties_travel_once(spark, shapes):
    """No exchange below the last join carries them."""
    flat, attributes = importer.planar(shapes)
    plan = importer.draw_levels({5: flat, 6: flat}, attributes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("props") >= 2
    below = plan[plan.index("Union") if "Union" in plan else 0 :]
    drawn = below[: below.rindex("Relation")] if "Relation" in below else below
    assert "props" not in drawn.split("Join")[-1].split("Relation")[0]


def test_import_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, geometry string, props map<string,string>")
    assert importer.import_shapes(empty, range(0, 3)).count() == 0


def test_stored_tables_need_a_shared_folder(spark, monkeypatch):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        stored.shared_folder(Session)
    assert stored.shared_folder(spark)


def test_rows_without_a_key_do_not_meet_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(vector, "BROADCAST_BYTES", -1)
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    layer = F.when(F.col("id") % 5 == 0, "a").otherwise("b")
    props = F.create_map(F.lit("uid"), F.concat(F.lit('"'), (F.col("id") % 40).cast("string"), F.lit('"')))
    zero = F.lit(0).cast("bigint")
    f = session.range(4000).select(zero.alias("z"), zero.alias("x"), zero.alias("y"), layer.alias("layer"), F.col("id").alias("feat_no"), "id", props.alias("props"))
    dim = session.range(30).select(F.col("id").cast("string").alias("key_id"), F.concat(F.lit("n"), "id").alias("name"))
    for inner in (False, True):
        out = vector.update_properties(f, dim, "a", "uid", "key_id", remove_non_matching=inner).select("id", F.col("props")["name"].alias("name"), F.spark_partition_id().alias("task")).collect()
        want = {i: f'"n{i % 40}"' if i % 5 == 0 and i % 40 < 30 else None for i in range(4000)}
        assert {r.id: r.name for r in out} == {i: v for i, v in want.items() if not inner or i % 5 or i % 40 < 30}
        assert max(Counter(r.task for r in out).values()) < 0.4 * len(out)


def test_cascade_of_unchanged_shapes_is_stored_once(spark, shapes, monkeypatch):
    written = []
    monkeypatch.setattr(importer, "store", lambda df: written.append(1) or stored.store(df))
    flat, _ = importer.planar(shapes)
    written.clear()
    levels = importer.cascade(flat, range(3, 9), 0.0, 0.0, 400.0, 20.0, "drop_rate", 0.5)
    assert len(written) == 1 and list(levels) == [8, 7, 6, 5, 4, 3]
    sizes = {(r["index"], r.kind): r for r in flat.collect()}
    point = {r["index"] for r in flat.where(importer.keep_share(F.col("index"), 0.5)).collect()}
    for level, left in levels.items():
        unit = importer.unit_of(level)
        line = lambda r: sum(G.length(p) for p in r.parts) >= 20 * unit  # noqa: B023,E731
        area = lambda r: G.area(r.parts[0]) - sum(G.area(p) for p in r.parts[1:]) >= 400 * unit * unit  # noqa: B023,E731
        want = {k for k, r in sizes.items() if (k[0] in point if k[1] == 1 else line(r) if k[1] == 2 else area(r))}
        assert {(r["index"], r.kind) for r in left.collect()} == want
    importer.forget_levels(levels)
