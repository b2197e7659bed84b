"""Pure functions: codecs, geometry, parsers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselon.functions import geometry as G
from tesselon.functions import mvt
from tesselon.functions import png as P
from tesselon.functions.coords import bbox_to_range
from tesselon.operators.reports import plan_windows, splitmix64, windows_for_sample
from tesselon.plans import vpl
from tesselon.plans.cel import ExpressionError, _tokens
from tesselon.plans.tileset import TileJSON
from tesselon.sources import containers as C
from tesselon.sources import features as S


def test_bbox_to_range_golden():
    kept = {(z, x, y) for z in range(6) for a, b, c, d in [bbox_to_range((0, 0, 40, 20), z)] for x in range(a, c + 1) for y in range(b, d + 1)}
    expected = {(0, 0, 0), (1, 1, 0), (2, 2, 1), (3, 4, 3), (4, 8, 7), (4, 9, 7)} | {(5, x, y) for x in range(16, 20) for y in (14, 15)}
    assert kept == expected
    with pytest.raises(ValueError):
        bbox_to_range((10, 0, 0, 1), 3)


@given(st.integers(0, 2**64 - 1))
def test_varint_round_trip(value):
    assert mvt.read_varint(mvt.varint(value), 0)[0] == value


@given(st.integers(-(2**31), 2**31))
def test_zigzag(value):
    assert mvt.unzigzag(mvt.zigzag(value)) == value


@settings(max_examples=60)
@given(st.lists(st.tuples(st.integers(-100, 5000), st.integers(-100, 5000)), min_size=2, max_size=12))
def test_geometry_round_trip(line):
    assert mvt.decode_geometry(mvt.encode_geometry([line], mvt.LINE)) == [line]
    ring = [*line, (line[0][0] + 1, line[0][1] + 7), line[0]]
    assert mvt.decode_geometry(mvt.encode_geometry([ring], mvt.POLYGON)) == [ring]


def test_tile_round_trip_and_dictionary_order():
    f = lambda i, props: {"id": i, "kind": mvt.POINT, "parts": [[(i, 2 * i)]], "props": props}
    layers = [{"name": "a", "extent": 512, "version": 2, "features": [f(1, {"s": "x", "n": -5, "d": 1.5, "b": True}), f(2, {"s": "x"})]}]
    out = mvt.decode_tile(mvt.encode_tile(layers))
    assert [(x["id"], x["props"], x["parts"]) for x in out[0]["features"]] == [(x["id"], x["props"], x["parts"]) for x in layers[0]["features"]]
    assert (out[0]["name"], out[0]["extent"], out[0]["version"]) == ("a", 512, 2)


def test_issues_and_repair():
    ring = [(0, 0), (10, 0), (10, 10), (0, 0)]
    feature = lambda parts, kind=3: {"id": None, "kind": kind, "parts": parts, "props": {}, "error": None}
    layers = [
        {"name": "a", "extent": None, "version": None, "features": [feature([ring]), feature([ring[::-1]]), feature([[(0, 0), (1, 1), (0, 0)]]), feature([[(1, 1), (2, 2), (3, 3), (1, 1)]]), feature([]), feature([], 0)]},
        {"name": "a", "extent": 1, "version": 1, "features": []},
    ]
    assert [i[0] for i in mvt.issues(layers)] == ["MissingExtent", "MissingVersion", "OrphanInnerRing", "TooFewVertices", "Collinear", "EmptyGeometryForType", "UnknownGeometryType", "DuplicateLayerName"]
    fixed = mvt.repair(layers, drop_offenders=True)
    assert len(fixed) == 1 and len(fixed[0]["features"]) == 2 and mvt.issues(fixed) == []


def test_clipping():
    box = (0, 0, 10, 10)
    assert G.clip_segment((-5, 5), (15, 5), box) == ((0, 5), (10, 5))
    assert G.clip_segment((-5, 20), (15, 20), box) is None
    assert G.area(G.clip_ring([(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)], box)) == 25
    assert G.clip_ring([(20, 20), (30, 20), (30, 30), (20, 20)], box) == []
    assert G.clip_line([(-5, 5), (5, 5), (5, 20), (8, 20), (8, 5)], box) == [[(0, 5), (5, 5), (5, 10)], [(8, 10), (8, 5)]]


def test_simplify_densify_distance():
    assert G.simplify([(0, 0), (1, 0.01), (2, 0)], 0.1) == [(0, 0), (2, 0)]
    assert len(G.densify([(0, 0), (10, 0)], 3)) == 5
    square = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]]
    assert G.point_in_rings(5, 5, square) and not G.point_in_rings(15, 5, square)
    assert math.isclose(G.rings_distance(13, 5, square), 3)


@settings(max_examples=20)
@given(st.sampled_from([1, 2, 3, 4]), st.integers(0, 2**31))
def test_png_round_trip(channels, seed):
    image = np.random.default_rng(seed).integers(0, 256, (5, 7, channels), np.uint8)
    assert (P.decode_png(P.encode_png(image)) == image).all()


def test_png_filters():
    import struct
    import zlib

    image = np.random.default_rng(1).integers(0, 256, (5, 4, 3), np.uint8)
    flat, rows = image.reshape(5, 12).astype(int), b""
    for y in range(5):
        up = flat[y - 1] if y else np.zeros(12, int)
        left, corner = np.concatenate([[0] * 3, flat[y][:-3]]), np.concatenate([[0] * 3, up[:-3]])
        if y == 4:
            p = left + up - corner
            far = np.abs(np.stack([p - left, p - up, p - corner]))
            guess = np.choose(far.argmin(axis=0), [left, up, corner])
        else:
            guess = [np.zeros(12, int), left, up, (left + up) // 2][y]
        rows += bytes([y]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (P.decode_png(data) == image).all()


def test_image_operations():
    half = np.array([[[200, 100, 0, 128]]], np.uint8)
    assert P.flatten(half).tolist() == [[[(200 * 128 + 255 * 127 + 127) // 255, (100 * 128 + 255 * 127 + 127) // 255, (255 * 127 + 127) // 255]]]
    grey = np.full((2, 2, 3), 100, np.uint8)
    assert (P.adjust(grey, contrast=255 / 255) >= 0).all() and P.is_opaque(grey) and not P.is_empty(grey)
    assert P.overlay(np.array([[[9, 9, 9, 255]]], np.uint8), half).tolist() == [[[9, 9, 9, 255]]]
    dem = np.array([[[0, 0, 1], [0, 0, 2]], [[0, 0, 3], [0, 1, 0]]], np.uint8)
    assert P.dem_raw(P.dem_halve(dem)).tolist() == [[(1 + 2 + 3 + 256 + 2) // 4]]
    assert P.enlarge(np.arange(16, dtype=np.uint8).reshape(4, 4, 1), 1, 1, 0)[:, :, 0].tolist() == [[2, 2, 3, 3], [2, 2, 3, 3], [6, 6, 7, 7], [6, 6, 7, 7]]


def test_pmtiles_directory():
    entries = [(0, 0, 10, 1), (1, 10, 5, 3), (9, 0, 10, 1), (30, 15, 7, 2)]
    assert C.decode_directory(C.encode_directory(entries)) == entries
    keys = [C.tile_key(i) for i in range(85)]
    assert len(set(keys)) == 85 and keys[0] == (0, 0, 0) and max(k[0] for k in keys) == 3
    level = [k for k in keys if k[0] == 3]
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(level, level[1:], strict=False))


def test_tilejson_merge():
    a = TileJSON((0, 0, 1, 1), None, 2, 5, {"attribution": "x", "name": "a"}, {"l": {"fields": {"p": "String"}, "minzoom": 3}})
    b = TileJSON((-1, 0, 0, 2), None, 1, 4, {"attribution": "y · x", "name": "b"}, {"l": {"fields": {"q": "Number"}, "minzoom": 1}})
    m = a.merge(b)
    assert (m.bounds, m.minzoom, m.maxzoom) == ((-1, 0, 1, 2), 1, 5)
    assert m.values == {"attribution": "x · y", "name": "b"} and m.vector_layers["l"] == {"fields": {"p": "String", "q": "Number"}, "minzoom": 1}


def test_parse_pipeline():
    nodes = vpl.parse('from_stacked [ from_debug level_max=2, from_color color="ff0000" | raster_levels gamma=2 ] # note\n | filter bbox=[0, 0, 40, 20] level_min=1')
    assert [n.name for n in nodes] == ["from_stacked", "filter"]
    assert [[m.name for m in s] for s in nodes[0].sources] == [["from_debug"], ["from_color", "raster_levels"]]
    assert nodes[1].args == {"bbox": ["0", "0", "40", "20"], "level_min": ["1"]}
    for bad in ("", "from_debug |", "from_debug a=", "from_debug ]", 'from_debug a="x'):
        with pytest.raises(vpl.PipelineError):
            vpl.parse(bad)


def test_check_pipeline():
    assert vpl.check(vpl.parse("from_nothing")) == ["unknown operator from_nothing"]
    assert vpl.check(vpl.parse("filter")) == ["filter is no read operator"]
    assert vpl.check(vpl.parse("from_debug | raster_overview")) == [] and vpl.check(vpl.parse("from_debug | raster_tile_resize")) == ["raster_tile_resize: tile_size is missing"]
    assert vpl.check(vpl.parse("from_debug what=1")) == ["from_debug: unknown parameter what"]
    assert vpl.check(vpl.parse("from_stacked [from_debug]")) == ["from_stacked needs two sources at least"]


def test_expression_tokens():
    assert [t[1] for t in _tokens('a >= 1.5 && !b.matches("x")')] == ["a", ">=", "1.5", "&&", "!", "b", ".", "matches", "(", '"x"', ")", ""]
    with pytest.raises(ExpressionError):
        _tokens("a @ b")


def test_sampling():
    assert splitmix64(0) == 0 and splitmix64(1) == 0x5692161D100B05E5
    assert [windows_for_sample(*a) for a in ((1.0, 16_384), (0.1, 16_384), (0.1, 4_000_000), (0.001, 1))] == [4, 1, 98, 1]
    with pytest.raises(ValueError):
        windows_for_sample(0.0, 10)
    assert plan_windows(4, (2, 3, 12, 9), 3) == [(2, 3, 12, 9)]
    found = plan_windows(10, (100, 200, 900, 1000), 5)
    assert len(found) == 5 == len(set(found)) and all(100 <= a and c <= 900 and 200 <= b and d <= 1000 and c - a == d - b == 63 for a, b, c, d in found)
    first = (100 + splitmix64(10 << 40) % 738, 200 + splitmix64((10 << 40) ^ 1) % 738)
    assert first in {w[:2] for w in found}


def test_colors_and_tables():
    assert S.parse_color("#f00") == (255, 0, 0) and S.parse_color("00ff0080") == (0, 255, 0, 128)
    with pytest.raises(ValueError):
        S.parse_color("12345")
    assert S.grid_zoom(1000, 4096) == 10


@given(st.lists(st.text(max_size=12), min_size=1, max_size=3))
def test_rendered_pipeline_parses_back(values):
    nodes = [vpl.Node("from_stacked", {}, [[vpl.Node("from_debug", {"a": values})], [vpl.Node("from_color"), vpl.Node("filter", {"b_c": ["1"]})]]), vpl.Node("remap_coords", {"flip_x": ["true"]})]
    assert vpl.parse(vpl.render(nodes)) == nodes


def test_all_operators_are_described():
    known = {name for _, name, _, _ in vpl.describe()}
    read = "from_color from_container from_csv from_debug from_geo from_grid from_merged_vector from_stacked from_stacked_raster from_tile from_tilejson"
    change = "filter meta_update remap_coords dem_overview dem_quantize dem_tile_resize raster_flatten raster_format raster_levels raster_mask raster_overscale raster_overview raster_tile_resize vector_filter_features vector_filter_layers vector_filter_properties vector_overzoom vector_repair vector_update_properties"
    assert known == set(f"{read} {change}".split())


def test_numbers_and_nulls_in_expressions(spark):
    from tesselon.functions.values import format_template, value_type
    from tesselon.plans.cel import compile_expression

    texts = [("-0", "Int"), ("0", "UInt"), ("-42", "Int"), ("-042", "String"), ("-00.0", "String"), ("1e-3", "Double"), ("-0.5", "Double"), (".42", "String"), ("", "String"), (" 42", "String"), ("true", "Bool")]
    got = {r.t: r.k for r in spark.createDataFrame(texts, "t string, want string").select("t", value_type("t").alias("k")).collect()}
    assert got == dict(texts)
    rows = [({"n": "9007199254740993"},), ({"n": "null"},), ({},), ({"n": "1.5"},), ({"n": "-3"},)]
    df = spark.createDataFrame(rows, "props map<string,string>")
    holds = lambda e: [r[0] for r in df.select(compile_expression(e)).collect()]
    assert holds("n == null") == [False, True, True, False, False]
    assert holds("has(props.n)") == [True, False, False, True, True]
    assert holds("n == 9007199254740992") == [False] * 5 and holds("n == 9007199254740993")[0] and holds("n > 9007199254740992")[0]
    assert holds("n == -3 || n == 1.5") == [False, False, False, True, True] and holds("n < 2") == [False, False, False, True, True]
    short = spark.range(3).select(format_template("{v:03}", {"v": F.col("id") * 777}).alias("t")).collect()
    assert [r.t for r in short] == ["000", "777", "1554"]


def test_boxes(spark):
    from tesselon.functions import coords as C

    a, b = (1, 1, 3, 4), (3, 0, 6, 2)
    assert C.box_union(a, b) == (1, 0, 6, 4) and C.box_intersection(a, b) == (3, 1, 3, 2) and C.box_intersection(a, (5, 5, 6, 6)) is None
    assert C.box_union(None, a) == a and C.box_intersection(None, a) is None
    assert C.box_grow(a, 2, 3) == (0, 0, 5, 6) and C.box_shift(a, -2, 5, 3) == (0, 6, 1, 7) and C.box_shift(a, 9, 0, 3) is None
    assert C.box_at_level(a, 3, 4) == (2, 2, 7, 9) and C.box_at_level((2, 3, 7, 9), 4, 3) == (1, 1, 3, 4)
    assert C.box_remapped(a, 3, flip_x=True) == (4, 1, 6, 4) and C.box_remapped(a, 3, flip_y=True, swap_xy=True) == (3, 1, 6, 3)
    x, y = C.box_tile(a)
    rows = spark.range(12).withColumnRenamed("id", "index").select("index", x.alias("x"), y.alias("y")).select("*", C.box_index(a).alias("again")).collect()
    assert all(r["index"] == r.again for r in rows) and (rows[4].x, rows[4].y) == (2, 2)
    assert spark.range(1).select(C.box_index(a, F.lit(0), F.lit(1))).first()[0] is None


def test_find_in_runs(spark):
    from tesselon.operators.reports import find_in_runs

    runs = spark.createDataFrame([(0, 3, "a"), (5, 100, "b"), (200, 1, "c")], "first long, run long, hash string")
    got = {r.id: r.hash for r in find_in_runs(runs, spark.createDataFrame([(i,) for i in (0, 2, 3, 5, 104, 105, 200, 201)], "id long"), span=16).collect()}
    assert got == {0: "a", 2: "a", 3: None, 5: "b", 104: "b", 105: None, 200: "c", 201: None}


def test_rules_with_allowed_values(spark):
    from tesselon.operators.reports import schema_violations

    f = spark.createDataFrame([("l", 3, {"k": '"a"'}), ("l", 3, {"k": '"z"'}), ("l", 3, {"k": "null"}), ("l", 3, {"k": "5"})], "layer string, z long, props map<string,string>")
    rules = spark.createDataFrame([("l", "k", "String", True, 0, ["a", "b"])], "layer string, attribute string, type string, required boolean, minzoom int, enum array<string>")
    assert {(r.problem, r.features) for r in schema_violations(f, rules).collect()} == {("enum", 1), ("missing", 1), ("type", 1)}


def test_orders_in_parts(spark):
    """Parts of any size give what one order over all rows gives."""
    from tesselon.operators import reports

    rng = np.random.default_rng(5)
    ids = np.flatnonzero(rng.random(400) < 0.8)
    entries = spark.createDataFrame([(int(i), int(i) // 37 % 2, k) for i in ids for k in ("a", None)], "id long, hash int, k string")
    offsets = np.sort(rng.integers(0, 5000, 200))
    ranges = spark.createDataFrame([(int(o), int(rng.integers(0, 60)), "ab"[i % 2]) for i, o in enumerate(offsets)], "offset long, length long, k string")
    spans = spark.createDataFrame([(int(a), int(a + rng.integers(0, 300))) for a in rng.integers(0, 3000, 300)], "start long, stop long")
    for job in (
        lambda n: reports.merge_runs(entries.where("k = 'a'").drop("k"), span=n),
        lambda n: reports.merge_runs(entries, ["k"], span=n),
        lambda n: reports.coalesce_ranges(ranges, 20, span=n),
        lambda n: reports.coalesce_ranges(ranges, 20, ["k"], span=n),
        lambda n: reports.peak_in_flight(spans, span=n),
    ):
        results = [sorted(map(str, job(n).collect())) for n in (1 << 40, 7, 64)]
        assert results[0] == results[1] == results[2] and results[0]


def test_rasters_against_single_points():
    from tesselon.functions import geometry as G

    rng = np.random.default_rng(8)
    angles = np.sort(rng.uniform(0, 2 * np.pi, 40))
    ring = np.column_stack([np.cos(angles), np.sin(angles)]) * rng.uniform(20, 90, 40)[:, None] + 100
    hole = [(90.0, 90.0), (110.0, 90.0), (110.0, 111.0), (90.0, 90.0)]
    rings = [[*map(tuple, ring.tolist()), tuple(ring[0].tolist())], hole]
    edges = np.concatenate([np.hstack([p[:-1], p[1:]]) for p in map(np.array, rings)])
    xs, ys = np.arange(0.5, 200, 7.3), np.arange(199.5, 0, -6.1)
    inside, near = G.inside_rows(xs, ys, edges), G.near_distances(xs, ys, edges, 15.0)
    for j, y in enumerate(ys):
        for i, x in enumerate(xs):
            assert inside[j, i] == G.point_in_rings(x, y, rings)
            d = G.rings_distance(x, y, rings)
            assert abs(G.edges_distance(x, y, edges) - d) < 1e-9 and (abs(near[j, i] - d) < 1e-9 if d <= 15 else near[j, i] == np.inf)


def test_text_functions_of_expressions(spark):
    from tesselon.plans.cel import compile_expression

    rows = [{"a": '"Łódź"', "b": '"ó"'}, {"a": '""', "b": '""'}, {"a": '"say \\"ó\\""', "b": "null"}, {"a": "12", "b": '"1"'}, {"a": "true"}, {}]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, props map<string,string>")
    holds = lambda e: [r.i for r in df.where(compile_expression(e)).orderBy("i").collect()]
    assert holds("size(a) == 4") == [0] and holds("a.size() == 0") == [1] and holds("size(a) == 7") == [2]
    assert holds("a.startsWith('Ł')") == [0] and holds("a.endsWith('\"')") == [2] and holds("a.contains(b)") == [0, 1]
    assert holds("!a.startsWith('Ł')") == [1, 2]  # of what is no text the answer is an error either way
    assert holds("size([1, 2, 3]) == 3 && size('ab') == 2") == [0, 1, 2, 3, 4, 5] and holds("size(a) >= 0") == [0, 1, 2]
    for wrong in ("size(1) == 1", "a.startsWith(1)", "a.size(1)", "size()", "a.starts('x')"):
        with pytest.raises(ExpressionError):
            compile_expression(wrong)
