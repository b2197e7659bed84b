"""Operators and pipelines on small inputs, and every query against DuckDB."""

import json
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesselon.functions import coords as C
from tesselon.functions import mvt
from tesselon.functions import png as P
from tesselon.operators import general, raster, tiles
from tesselon.plans.cel import compile_expression
from tesselon.plans.vpl import PipelineError, run_vpl
from tesselon.queries import ORACLE_SQL, QUERIES
from tesselon.sources import containers, features
from tesselon.streaming.pyramid import apply_to_feed, tile_counts

TABLES = "region nation customer supplier part orders lineitem events".split()


def frame(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    cell = lambda v: None if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(cell(v) for v in row) for row in df[columns].itertuples(index=False)), key=str)


@pytest.fixture(scope="session")
def duck(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert frame(got, columns) == frame(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() >= 0


def test_bbox_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    features.coordinates(spark, range(5)).write.parquet(path)
    plan = general.filter_tiles(spark.read.parquet(path), level_min=2, level_max=3)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(z), GreaterThanOrEqual(z,2), LessThanOrEqual(z,3)]" in plan


def test_filter_rejects(spark):
    t = features.coordinates(spark, range(2))
    for bad in ({"level_min": 3, "level_max": 1}, {"bbox_border": 1}):
        with pytest.raises(ValueError):
            general.filter_tiles(t, **bad)


def test_merge_rejects_other_extent(spark):
    row = lambda e: spark.createDataFrame([(0, 0, 0, "l", 0, e)], "z long, x long, y long, layer string, feat_no long, extent int")
    with pytest.raises(Exception, match="extent"):
        general.merge_features([row(512), row(4096)]).collect()


@pytest.mark.parametrize(
    ("expression", "passes"),
    [('kind == "a"', [1]), ("n > 3 || kind == 'b'", [1, 2]), ("!(n > 3)", [2]), ("flag", [1]), ("missing == null", [1, 2, 3]), ("kind > 3", []), ("n != '7'", [1, 2, 3]), ("n in [7, -2]", [1, 2]), ("-n == 2", []), ('kind.matches("^[ab]$")', [1, 2])],
)
def test_expressions(spark, expression, passes):
    rows = [(1, {"kind": '"a"', "n": "7", "flag": "true"}), (2, {"kind": '"b"', "n": "-2", "flag": "false"}), (3, {"kind": '"c"'})]
    if expression == "-n == 2":
        with pytest.raises(ValueError):
            compile_expression(expression)
        return
    df = spark.createDataFrame(rows, "id long, props map<string,string>")
    assert sorted(r.id for r in df.where(compile_expression(expression)).collect()) == passes


def test_vector_pipeline(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,lon,lat,name\n1,13.4,52.5,Berlin\n2,x,1,bad\n3,24.7,42.1,"Plovdiv, old"\n')
    (tmp_path / "d.csv").write_text("city,people\nBerlin,100\nBerlin,200\n")
    text = f"from_csv filename='{tmp_path}/p.csv' lon_column=lon lat_column=lat id_column=id layer_name=places max_zoom=2 | vector_update_properties data_source_path='{tmp_path}/d.csv' layer_name=places id_field_tiles=name id_field_data=city | vector_filter_features layer=[places] expr='people >= 200'"
    out = run_vpl(spark, text)
    rows = tiles.decode(out.tiles).collect()
    assert {(r.z, r.id) for r in rows} == {(0, 1), (1, 1), (2, 1)}
    assert all(r.props == {"name": '"Berlin"', "people": "200"} for r in rows)
    assert out.explain() == "from_csv | vector_update_properties | vector_filter_features"
    with pytest.raises(PipelineError, match="needs raster"):
        run_vpl(spark, "from_debug level_max=1 | raster_flatten")


def test_geojson_both_forms(spark, tmp_path):
    feats = [
        {"type": "Feature", "id": 7, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [40, 0], [40, 40], [0, 40], [0, 0]]]}, "properties": {"kind": "area", "n": 3, "o": {"x": 1}}},
        {"type": "Feature", "id": 8, "geometry": {"type": "LineString", "coordinates": [[-50, 0], [50, 10]]}, "properties": {"kind": "line", "ok": True}},
    ]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    (tmp_path / "a.geojsonl").write_text("\n".join("\x1e" + json.dumps(f) for f in feats))
    one, two = (sorted(map(str, features.read_geojson(spark, str(tmp_path / f"a.{e}")).selectExpr("id", "props").collect())) for e in ("geojson", "geojsonl"))
    assert one == two and '"area"' in one[0] and "'n': '3'" in one[0] and "'o'" not in one[0]
    drawn = tiles.draw_shapes(features.read_geojson(spark, str(tmp_path / "a.geojson")), range(0, 3)).collect()
    assert {r.z for r in drawn} == {0, 1, 2} and {r.kind for r in drawn} == {2, 3}


def test_shapefile(spark, tmp_path):
    import struct

    point = lambda n, x, y: struct.pack(">2i", n, 10) + struct.pack("<i2d", 1, x, y)
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + point(1, 1.5, 2.5) + point(2, 3.0, 4.0))
    head = struct.pack("<B3BIHH20x", 3, 0, 0, 0, 2, 32 + 64 + 1, 1 + 5 + 8)
    field = lambda name, kind, size: name.ljust(11, b"\0") + kind + b"\0" * 4 + bytes([size]) + b"\0" * 15
    (tmp_path / "s.dbf").write_bytes(head + field(b"NAME", b"C", 5) + field(b"DAY", b"D", 8) + b"\r" + b" abc  20200101" + b" de   " + b" " * 8)
    rows = features.read_shapefile(spark, str(tmp_path / "s.shp")).orderBy("id").collect()
    assert [json.loads(r.geometry)["coordinates"] for r in rows] == [[1.5, 2.5], [3.0, 4.0]]
    assert rows[0].props == {"NAME": '"abc"', "DAY": '"20200101"'} and rows[1].props == {"NAME": '"de"'}


def test_raster_pipeline(spark):
    out = run_vpl(spark, "from_stacked_raster [from_color color=ff000080 size=4 level_max=2, from_color color=0000ff size=4 level_max=1] | raster_flatten | raster_levels brightness=10").tiles.collect()
    pixel = {r.z: P.decode_png(bytes(r.data))[0, 0].tolist() for r in out}
    assert len(out) == 21 and pixel[0][2] > 100 and pixel[0][0] > 100 and len(pixel[2]) == 3


def test_overview_overscale_resize(spark):
    image = lambda v: P.encode_png(np.full((4, 4, 3), v, np.uint8))
    t = spark.createDataFrame([(1, x, y, image(40 * (x + 2 * y))) for x in (0, 1) for y in (0, 1)], "z long, x long, y long, data binary")
    top = raster.overview(t, 1).where("z = 0").collect()
    assert P.decode_png(bytes(top[0].data))[:, :, 0].tolist() == [[0, 0, 40, 40], [0, 0, 40, 40], [80, 80, 120, 120], [80, 80, 120, 120]]
    deep = raster.overscaled(features.coordinates(spark, range(2, 3)), t, 1).collect()
    assert len(deep) == 16 and {int(P.decode_png(bytes(r.data))[0, 0, 0]) for r in deep} == {0, 40, 80, 120}
    big = raster.resize(t, 512).collect()
    assert len(big) == 1 and P.decode_png(bytes(big[0].data)).shape == (8, 8, 3)
    back = raster.resize(spark.createDataFrame(big), 256).where("z = 1").collect()
    assert {(r.x, r.y): bytes(r.data) for r in back} == {(r.x, r.y): bytes(r.data) for r in t.collect()}


def test_mask(spark):
    box = [(-1.0, -1.0), (2e7, -1.0), (2e7, 2e7), (-1.0, 2e7), (-1.0, -1.0)]
    t = features.color_tiles(features.coordinates(spark, range(2)), "ff0000", 8)
    kept = {(r.z, r.x, r.y): P.decode_png(bytes(r.data)) for r in raster.mask(t, [box]).collect()}
    assert (1, 0, 1) not in kept and (1, 1, 0) in kept
    assert kept[(0, 0, 0)][0, 7, 3] == 255 and kept[(0, 0, 0)][7, 0, 3] == 0


def test_validate_and_repair(spark):
    bad = mvt.encode_tile([{"name": "a", "extent": 1, "version": 1, "features": [{"id": 1, "kind": 3, "parts": [[(0, 0), (1, 1), (0, 0)]], "props": {}}]}])
    t = spark.createDataFrame([(0, 0, 0, bad), (1, 0, 0, b"\xff\xff")], "z long, x long, y long, data binary")
    assert {(r.z, r.issue) for r in tiles.validate(t).collect()} == {(0, "TooFewVertices"), (1, "DecodeFailure")}
    assert tiles.validate(tiles.repair(t.where("z = 0"))).count() == 0


def test_extent_is_kept(spark, tmp_path):
    from tesselon.plans.vpl import run_vpl

    point = lambda e: mvt.encode_tile([{"name": "a", "extent": e, "version": 1, "features": [{"id": 1, "kind": 1, "parts": [[(e // 2, e // 2)]], "props": {"n": 1}}]}])
    for name, extent in (("small", 512), ("large", 4096)):
        (tmp_path / name / "0" / "0").mkdir(parents=True)
        (tmp_path / name / "0" / "0" / "0.mvt").write_bytes(point(extent))
    small = f'from_container filename="{tmp_path}/small"'
    out = run_vpl(spark, small + " | vector_filter_properties regex='/m$'").tiles.head()
    layer = mvt.decode_tile(bytes(out.data))[0]
    assert (layer["extent"], layer["version"], layer["features"][0]["parts"]) == (512, 1, [[(256, 256)]])
    zoomed = run_vpl(spark, small + " | vector_overzoom level_base=0 level_max=1").features.where("z = 1").collect()
    assert [(r.x, r.y, r.parts, r.extent) for r in zoomed if r.x == r.y == 1] == [(1, 1, [[[0, 0]]], 512)]
    with pytest.raises(Exception, match="extent"):
        run_vpl(spark, f'from_merged_vector [{small}, from_container filename="{tmp_path}/large"]').tiles.collect()
    same = run_vpl(spark, f"from_merged_vector [{small}, {small}]").features.collect()
    assert [(r.feat_no, r.extent) for r in sorted(same, key=lambda r: r.feat_no)] == [(0, 512), (1, 512)]


def test_filter_layers_keeps_emptied_tiles(spark, tmp_path):
    from tesselon.plans.vpl import run_vpl

    layer = lambda n: {"name": n, "extent": 256, "version": 2, "features": [{"id": 1, "kind": 1, "parts": [[(1, 1)]], "props": {}}]}
    for x, names in ((0, "ab"), (1, "a")):
        (tmp_path / "1" / str(x)).mkdir(parents=True)
        (tmp_path / "1" / str(x) / "0.mvt").write_bytes(mvt.encode_tile([layer(n) for n in names]))
    source = f'from_container filename="{tmp_path}"'
    for text in (source + " | vector_filter_layers filter=[a]", source + " | vector_filter_properties regex=q | vector_filter_layers filter=[a]", source + " | vector_filter_layers filter=[b] invert=true"):
        got = {r.x: [x["name"] for x in mvt.decode_tile(bytes(r.data))] for r in run_vpl(spark, text).tiles.collect()}
        assert got == {0: ["b"], 1: []}


def test_broken_tiles(spark):
    good = mvt.encode_tile([{"name": "a", "extent": 256, "version": 2, "features": [{"id": 1, "kind": 1, "parts": [[(1, 1)]], "props": {}}]}])
    t = spark.createDataFrame([(0, 0, 0, bytearray(good)), (1, 0, 0, bytearray(b"\x1a\xff\xff"))], "z long, x long, y long, data binary")
    assert tiles.decode(t, skip_broken=True).count() == 1 and [r.z for r in tiles.broken(t).collect()] == [1]
    with pytest.raises(Exception):
        tiles.decode(t).collect()
    assert (tiles.repair(t).count(), tiles.repair(t, drop_offenders=True).count()) == (2, 1)


def test_overzoom_lines(spark):
    rows = [(0, 0, 0, "l", 0, 1, 2, [[[0, 100], [4096, 100]]], {"a": "1"}, 4096, 2), (0, 0, 0, "l", 1, 2, 1, [[[3000, 3000]]], {}, 4096, 2)]
    f = spark.createDataFrame(rows, tiles.FEATURES)
    out = tiles.overzoom(f, 0, 1).where("z = 1").collect()
    assert {(r.id, r.x, r.y) for r in out} == {(1, 0, 0), (1, 1, 0), (2, 1, 1)}
    assert [r.parts for r in out if r.id == 2] == [[[[1904, 1904]]]]


@pytest.mark.parametrize("name", ["out", "t.tar", "t.mbtiles", "t.pmtiles", "t.parquet"])
def test_container_round_trip(spark, tmp_path, name):
    keys = features.coordinates(spark, range(4))
    t = keys.withColumn("data", F.encode(F.concat(F.lit("tile "), (F.col("x") % 2).cast("string")), "utf-8"))
    path = str(tmp_path / name)
    containers.write_container(t.unionByName(t.where("z = 2")), path, "png")
    back = containers.read_container(spark, path).select("z", "x", "y", "data")
    assert sorted((r.z, r.x, r.y, bytes(r.data)) for r in back.collect()) == sorted((r.z, r.x, r.y, bytes(r.data)) for r in t.collect())
    if name == "t.pmtiles":
        header = containers.read_header(open(path, "rb").read(127))
        assert (header["addressed"], header["contents"], header["minzoom"], header["maxzoom"], header["type"]) == (85, 2, 0, 3, "png")


def test_compression(spark):
    t = spark.createDataFrame([(0, 0, 0, b"abc" * 9)], "z long, x long, y long, data binary")
    for kind in ("gzip", "zstd"):
        there = containers.recompress(t, "none", kind)
        assert bytes(containers.recompress(there, kind, "none").head().data) == b"abc" * 9
    with pytest.raises(ValueError):
        containers.compress(b"", "brotli")


def test_thinning(spark):
    p = spark.createDataFrame([(i, 1, float(i % 10), float(i // 10)) for i in range(100)], "id long, g long, mx double, my double")
    kept = tiles.thin_min_distance(p, 3.0, "g").collect()
    assert all((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2 >= 9 for a in kept for b in kept if a.id < b.id) and len(kept) > 8
    assert tiles.thin_points(p, 5.0).count() == 4


def test_streaming_counts(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    spark.createDataFrame([(0.0, 0.0), (10.0, 10.0), (-170.0, 80.0)], "lon double, lat double").write.parquet(source)
    feed = spark.readStream.schema("lon double, lat double").parquet(source)
    assert tile_counts(feed, range(0, 2)).isStreaming
    query = apply_to_feed(feed, lambda df: tile_counts(df, range(0, 2)), lambda df, n: out.extend(df.collect()), str(tmp_path / "c"))
    query.awaitTermination(120)
    assert sum(r.n for r in out if r.z == 0) == 3


def test_no_training_operator_is_imported():
    import subprocess
    import sys

    code = "import sys, tesselon.queries, tesselon.plans.vpl; sys.exit(any('llm' in m for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__))).returncode == 0


def test_tilejson_address(spark, tmp_path):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/t.json":
                body = json.dumps({"tiles": [f"http://127.0.0.1:{server.server_port}/{{z}}/{{x}}/{{y}}"], "maxzoom": 1, "format": "png", "name": "n"}).encode()
            else:
                body = b"" if self.path == "/1/1/1" else self.path.encode()
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    out = run_vpl(spark, f'from_tilejson url="http://127.0.0.1:{server.server_port}/t.json"')
    assert sorted(bytes(r.data) for r in out.tiles.collect()) == [b"/0/0/0", b"/1/0/0", b"/1/0/1", b"/1/1/0"]
    assert (out.tilejson.values["name"], out.tilejson.maxzoom, out.format) == ("n", 1, "png")
    server.shutdown()


def test_overscaled_stack(spark):
    t = lambda color, levels: features.color_tiles(features.coordinates(spark, levels), color, 4)
    out = {(r.z, r.x, r.y): P.decode_png(bytes(r.data))[0, 0].tolist() for r in raster.stack_overscaled([t("ff0000", range(2)), t("0000ff", range(3))]).collect()}
    assert len(out) == 21 and out[(2, 3, 3)] == [255, 0, 0]


def test_climbing_overzoom(spark):
    row = lambda z, x, i: (z, x, 0, "l", 0, i, 1, [[[10, 10]]], {}, None, None)
    f = spark.createDataFrame([row(0, 0, 1), row(1, 1, 2)], tiles.FEATURES)
    out = tiles.overzoom_climbing(f, 1, 2).collect()
    assert sorted((r.z, r.x, r.y, r.id) for r in out) == [(0, 0, 0, 1), (1, 0, 0, 1), (1, 1, 0, 2), (2, 0, 0, 1), (2, 2, 0, 2)]


def test_layer_bytes(spark):
    t = tiles.encode(spark.createDataFrame([(0, 0, 0, "l", i, i, 1, [[[i, 10]]], {"k": "1"}, 4096, 2) for i in range(5)], tiles.FEATURES))
    r = tiles.layer_bytes(t).collect()[0]
    assert (r.tiles, r.features, r.vertices, r.tags) == (1, 5, 5, 10) and r.encoded == r.geometry + r.tags + r["keys"] + r.vals + r.ids + r.other


def test_convert_and_probe(spark, tmp_path):
    from tesselon.convert import convert, open_source, probe

    convert(spark, "vpl:from_debug level_max=3", str(tmp_path / "a.pmtiles"), max_zoom=2, flip_y=True, compress="gzip")
    source = open_source(spark, str(tmp_path / "a.pmtiles"))
    report = probe(source, 3)
    assert report["pyramid"].count() == 3 and report["issues"].count() == 0 and report["layers"].count() == 9
    assert source.format == "mvt" and source.tile(2, 3, 3) is not None and source.tile(3, 0, 0) is None
    assert {r.props["char"] for r in tiles.decode(source.tiles.where("z = 1 AND y = 0")).where("layer = 'debug_y'").collect()} == {'"1"'}


@pytest.mark.parametrize("name", ["b.mbtiles", "b.pmtiles", "b.tar", "b"])
def test_descriptions_are_kept(spark, tmp_path, name):
    from tesselon.convert import convert, open_source

    text = "vpl:from_debug level_max=2 | meta_update name=Try attribution='(c) me' description=some bounds=[-10, -20, 30, 40]"
    convert(spark, text, str(tmp_path / name), min_zoom=1, bbox=(-5, -30, 35, 35), compress="gzip")
    for again in (name, "c" + name):
        source = open_source(spark, str(tmp_path / again))
        known = source.tilejson
        assert (known.values["name"], known.values["attribution"], known.values["description"]) == ("Try", "(c) me", "some")
        assert known.bounds == (-5, -20, 30, 35) and known.minzoom == 1 and set(known.vector_layers) == {"debug_x", "debug_y", "debug_z"}
        assert known.vector_layers["debug_x"]["fields"] == {"char": "String", "index": "Number"} and source.format == "mvt"
        if again == name:
            convert(spark, str(tmp_path / name), str(tmp_path / ("c" + name)))


def test_import_defaults(spark, tmp_path):
    """The layer has the file's name; half of the shapes are squares of some 111 km, which span four units at level 1."""
    square = lambda i: {"type": "Feature", "id": i, "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i + 1, 1], [i, 1], [i, 0]]]}, "properties": {"a": i, "b": "x"}}
    (tmp_path / "fields.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [square(i) for i in range(3)]}))
    source = run_vpl(spark, f"from_geo filename='{tmp_path}/fields.geojson' polygon_min_area=0 properties_include=[a] ignore_id=true")
    size = C.WORLD / 360
    assert source.tilejson.maxzoom == max(0, min(14, round(float(np.log2(4 * C.WORLD / (size * 4096))))))
    rows = source.features.collect()
    assert {r.layer for r in rows} == {"fields"} and {r.id for r in rows} == {None} and all(set(r.props) == {"a"} for r in rows)
    (tmp_path / "p.csv").write_text("lon,lat,n\n1,2,3\n")
    points = run_vpl(spark, f"from_csv filename='{tmp_path}/p.csv' lon_column=lon lat_column=lat min_zoom=13")
    assert points.tilejson.maxzoom == 14 and {r.layer for r in points.features.collect()} == {"p"}


def test_look_up_in_an_archive(spark, tmp_path):
    from tesselon.sources import containers

    keys = features.coordinates(spark, range(0, 7))
    data = F.when(F.col("x") % 3 == 0, F.lit("same")).otherwise(F.concat_ws("/", "z", "x", "y")).cast("binary")
    containers.write_container(keys.withColumn("data", data), str(tmp_path / "a.pmtiles"), "mvt")
    for z, x, y in ((0, 0, 0), (6, 1, 63), (6, 62, 3), (5, 31, 31), (4, 3, 2)):
        assert containers.pmtiles_tile(str(tmp_path / "a.pmtiles"), z, x, y) == (b"same" if x % 3 == 0 else f"{z}/{x}/{y}".encode())
        assert containers.tile_key(containers.hilbert_number(z, x, y)) == (z, x, y)
    assert containers.pmtiles_tile(str(tmp_path / "a.pmtiles"), 7, 0, 0) is None


def test_images_pass_through(spark, tmp_path):
    from tesselon.convert import convert, open_source
    from tesselon.sources import containers

    jpg, webp = b"\xff\xd8\xff\xe0 some picture", b"RIFF\0\0\0\0WEBPVP8 more"
    for kind, data in (("jpg", jpg), ("webp", webp)):
        assert containers.sniff(data) == (kind, "none")
        (tmp_path / kind / "0" / "0").mkdir(parents=True)
        (tmp_path / kind / "0" / "0" / f"0.{kind}").write_bytes(data)
        for end in ("mbtiles", "pmtiles", "tar"):
            convert(spark, str(tmp_path / kind), str(tmp_path / f"{kind}.{end}"))
            source = open_source(spark, str(tmp_path / f"{kind}.{end}"))
            assert source.format == kind and bytes(source.tiles.head().data) == data


def test_shared_borders_stay_shared(spark):
    from tesselon.operators.borders import lines_of, simplify_shared

    border = [[6 + 0.3 * (i % 2), i / 4] for i in range(1, 40)]
    left = [[0, 0], [6, 0], *border, [6, 10], [0, 10], [0, 0]]
    right = [[12, 0], [12, 10], [6, 10], *border[::-1], [6, 0], [12, 0]]
    alone = [[20, 0], [20.01, 5], [20, 10], [30, 10], [30, 0], [20, 0]]
    poly = lambda i, ring: (i, json.dumps({"type": "Polygon", "coordinates": [ring]}), {})
    shapes = spark.createDataFrame([poly(1, left), poly(2, right), poly(3, alone)], "id long, geometry string, props map<string,string>")
    out = {r.id: lines_of(json.loads(r.geometry))[0] for r in simplify_shared(shapes, 0.5).collect()}
    edges = {i: {frozenset(map(tuple, e)) for e in zip(r, r[1:], strict=False)} for i, r in out.items()}
    shared = [e for e in edges[1] & edges[2]]
    assert len(shared) >= 1 and len(out[1]) < 12 and len(out[3]) == 5
    assert {p for e in shared for p in e} >= {(6, 0), (6, 10)}
    assert {tuple(p) for p in out[1]} & {tuple(p) for p in out[2]} == {p for e in shared for p in e}


def test_one_tile(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(P.encode_png(np.zeros((2, 2, 3), np.uint8)))
    out = run_vpl(spark, f"from_tile filename='{tmp_path}/a.png' level_max=2 | filter level_min=1 | remap_coords swap_xy=true")
    assert out.tiles.count() == 20 and out.format == "png"
    with pytest.raises(PipelineError, match="needs vector"):
        run_vpl(spark, "from_color | vector_repair")


def test_meta_update(spark):
    out = run_vpl(spark, """from_color level_max=1 | meta_update tilejson_update='{"name": "a", "bounds": [0, 0, 1, 1]}' attribution=me | meta_update name=b""")
    assert out.tilejson.bounds == (0, 0, 1, 1) and out.tilejson.values == {"name": "b", "attribution": "me"}


def test_dem_quantize(spark):
    t = features.color_tiles(features.coordinates(spark, range(0, 1)), "018753", 4)
    out = P.dem_raw(P.decode_png(bytes(raster.dem_quantize(t, 0.001, 0.01).head().data)))[0, 0]
    pixel = np.cos(0.0) * 2 * np.pi * 6378137 / 256
    bits = int(np.log2(min(0.001 * pixel, pixel * np.tan(np.radians(0.01))) / 0.1 + 1))
    assert out == ((0x018753 + (1 << bits >> 1)) >> bits) << bits and bits > 3


def test_laea(spark):
    from tesselon.functions.coords import laea_forward, laea_inverse

    p = spark.createDataFrame([(10.0, 52.0), (5.0, 50.0), (-9.5, 38.7), (31.2, 70.1)], "lon double, lat double")
    there = p.select("*", *[c.alias(n) for c, n in zip(laea_forward("lon", "lat"), ("e", "n"), strict=True)])
    back = there.select("*", *[c.alias(n) for c, n in zip(laea_inverse("e", "n"), ("x", "y"), strict=True)]).collect()
    assert all(abs(r.lon - r.x) < 1e-8 and abs(r.lat - r.y) < 1e-8 for r in back)
    assert [round(v, 2) for v in (back[0].e, back[0].n, back[1].e, back[1].n)] == [4321000.0, 3210000.0, 3962799.45, 2999718.85]


def test_grid_of_3035_is_drawn(spark):
    """The box is in degrees; every tile that it touches is filled."""
    from tesselon.functions.coords import bbox_to_range

    box = (8.5, 50.8, 11.2, 52.8)
    source = run_vpl(spark, f"from_grid epsg=3035 size=100000 bbox={list(box)} offset=[50000, 0] max_zoom=6 x_field=east")
    out = source.features.where("z = 6").collect()
    x0, y0, x1, y1 = bbox_to_range(box, 6)
    assert {(r.x, r.y) for r in out} == {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
    props = {r.props["id"]: (r.props["east"], r.props["y"]) for r in out}
    assert set(props) >= {f'"CRS3035RES100000mN{n}E{e}"' for n in (3100000, 3200000) for e in (4250000, 4350000)}
    assert props['"CRS3035RES100000mN3100000E4250000"'] == ("4250000", "3100000") and len(props) > 8
    assert source.tilejson.bounds == box and source.tilejson.vector_layers["grid"]["fields"] == {"id": "String", "east": "Number", "y": "Number"}


def test_large_tiles_stream(spark):
    """One tile of many features: what a worker holds follows from the tile's bytes, not from its features as objects."""
    import tracemalloc

    writer = mvt.LayerWriter("l")
    tracemalloc.start()
    for i in range(60_000):
        writer.add(i, 1, [[(i % 4096, i * 7 % 4096)]], {"k": i % 100, "t": None, "s": "v"})
    data = writer.done(4096, 2)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 12 * len(data)
    rows = mvt.each_row(data)
    assert next(rows)["props"] == {"k": "0", "s": '"v"'} and sum(1 for _ in rows) == 59_999
    f = spark.range(9000).select(*[F.lit(0).cast("bigint").alias(k) for k in "zxy"], F.when(F.col("id") % 9 > 0, F.concat(F.lit("a"), F.col("id") % 2)).alias("layer"), (-F.col("id")).alias("feat_no"), "id", F.lit(1).alias("kind"), F.array(F.array(F.array("id", F.col("id") * 2))).alias("parts"), F.create_map(F.lit("n"), (F.col("id") % 7).cast("string")).alias("props"))
    out = tiles.decode(tiles.encode(f)).collect()
    assert [(r.layer, r.id, r.parts, r.props) for r in sorted(out, key=lambda r: (r.layer, r.feat_no))] == [(f"a{o}", i, [[[i, 2 * i]]], {"n": str(i % 7)}) for o in (0, 1) for i in range(8999, -1, -1) if i % 9 and i % 2 == o]


def test_overzoom_of_points_stays_in_spark(spark, monkeypatch):
    """Also where nothing comes back from Python."""
    at = [(0, 0), (2047, 2048), (2088, 4095), (2089, 5), (4176, -80)]
    f = spark.createDataFrame([(0, 0, 0, "l", i, i, 1, [[[x, y]]], {}, 4096, 2) for i, (x, y) in enumerate(at)], tiles.FEATURES)
    out = tiles.overzoom(f, 0, 2).where("z > 0").collect()
    want = []
    for z in (1, 2):
        n = 1 << z
        for k, (x, y) in enumerate(at):
            want += [(z, i, j, k, [[[x * n - i * 4096, y * n - j * 4096]]]) for i in range(n) for j in range(n) if i * 4096 - 80 <= x * n <= (i + 1) * 4096 + 80 and j * 4096 - 80 <= y * n <= (j + 1) * 4096 + 80]
    assert sorted((r.z, r.x, r.y, r.id, r.parts) for r in out) == sorted(want)
    monkeypatch.setattr(type(f), "mapInPandas", lambda self, *a, **b: self.limit(0).select(tiles.COLUMNS))
    assert len(tiles.overzoom(f, 0, 2).where("z > 0").collect()) == len(want)
