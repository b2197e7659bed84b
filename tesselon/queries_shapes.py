"""Registered queries of imported shapes, thinning, reads in chunks and outlines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.functions import coords as C
from tesselon.operators import chunks, importer, thinning
from tesselon.queries import ORACLE_SQL, points, query, table, tiled

#: Levels, and the least length and area in units of a tile's extent, of the imports.
LEVELS, LENGTH, AREA = range(4, 10), 20.0, 400.0


# --- points at a least distance ------------------------------------------------------------------


@query()
def min_distance_all(spark, sf_dir):
    """All events as one order, not one for each kind."""
    p = points(spark, sf_dir).select("event_id", C.mercator_x("lon").alias("mx"), C.mercator_y("lat").alias("my"))
    return thinning.thin_by_distance(p, 500_000.0, "event_id").select("event_id", F.round("mx", 2).alias("mx"), F.round("my", 2).alias("my"))


ORACLE_SQL["min_distance_all"] = """WITH RECURSIVE o AS (
  SELECT event_id, lon * pi() / 180 * 6378137.0 AS mx, 6378137.0 * ln(tan(lat * pi() / 360 + pi() / 4)) AS my, row_number() OVER (ORDER BY event_id) AS rn
  FROM (SELECT event_id, -180.0::DOUBLE + 360.0::DOUBLE * ((event_id * 7919) % 100003) / 100003.0::DOUBLE AS lon, -85.0::DOUBLE + 170.0::DOUBLE * ((event_id * 104729) % 99991) / 99991.0::DOUBLE AS lat FROM events)
), r AS (
  SELECT event_id, mx, my, rn, [{'a': mx, 'b': my}] AS held, TRUE AS free FROM o WHERE rn = 1
  UNION ALL
  SELECT event_id, mx, my, rn, CASE WHEN free THEN list_append(held, {'a': mx, 'b': my}) ELSE held END, free FROM (
    SELECT o.*, r.held, len(list_filter(r.held, lambda k: pow(k.a - o.mx, 2) + pow(k.b - o.my, 2) < 500000.0 * 500000.0)) = 0 AS free FROM r JOIN o ON o.rn = r.rn + 1)
)
SELECT event_id, round(mx, 2) AS mx, round(my, 2) AS my FROM r WHERE free"""


# --- reads in chunks -----------------------------------------------------------------------------


@query()
def coalesce_capped(spark, sf_dir):
    """Ranges with gaps around the limit, some that overlap and some longer than a chunk."""
    o = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select((o * 1000 + F.expr("o_orderkey div 3") * 1500).alias("offset"), (F.when(o % 97 == 0, 30_000).when(o % 11 == 0, 2_400).otherwise(F.col("o_custkey") % 1000)).cast("bigint").alias("length"))
    return chunks.read_chunks(r, 20_000, 900)


ORACLE_SQL["coalesce_capped"] = """WITH RECURSIVE r AS (
  SELECT "offset" AS a, "offset" + length AS b, row_number() OVER (ORDER BY "offset", length) AS i FROM (
    SELECT o_orderkey * 1000 + o_orderkey // 3 * 1500 AS "offset", CASE WHEN o_orderkey % 97 = 0 THEN 30000 WHEN o_orderkey % 11 = 0 THEN 2400 ELSE o_custkey % 1000 END AS length FROM orders)
), w AS (
  SELECT i, a, b, i AS opened, a AS start, b AS stop, 1 AS n FROM r WHERE i = 1
  UNION ALL
  SELECT i, a, b, CASE WHEN joins THEN opened ELSE i END, CASE WHEN joins THEN start ELSE a END, CASE WHEN joins THEN greatest(stop, b) ELSE b END, CASE WHEN joins THEN n + 1 ELSE 1 END FROM (
    SELECT r.*, w.opened, w.start, w.stop, w.n, w.start + 20000 > r.b AND w.stop + 900 > r.a AS joins FROM w JOIN r ON r.i = w.i + 1)
)
SELECT start AS "offset", CAST(max(stop) - start AS BIGINT) AS length, count(*) AS ranges FROM w GROUP BY opened, start"""


# --- shapes --------------------------------------------------------------------------------------


def _base(key: str):
    """A place in the Mercator plane for a key."""
    return C.WORLD * ((F.col(key) * 7919) % 100003) / 100003.0 - C.WORLD / 2, 0.9 * (C.WORLD * ((F.col(key) * 104729) % 99991) / 99991.0 - C.WORLD / 2)


def _ring(x0, y0, x1, y1):
    return F.array(F.array(*[F.array(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]))


def _areas(spark, sf_dir):
    """Squares at the orders' places, as large as their price."""
    x, y = _base("o_orderkey")
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2 + 1).alias("index"), F.lit(3).alias("kind"), x.alias("x"), y.alias("y"), (F.col("o_totalprice") / 50).alias("h"), "o_orderstatus", "o_orderkey")
    ring = _ring(F.col("x") - F.col("h"), F.col("y") - F.col("h"), F.col("x") + F.col("h"), F.col("y") + F.col("h"))
    return o.select("index", "kind", ring.alias("parts"), "o_orderstatus", "o_orderkey")


def _lines(spark, sf_dir):
    """A line for each order, through its items."""
    x, y = _base("l_orderkey")
    at = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", (x + F.col("l_quantity") * 100).alias("x"), (y + F.col("l_extendedprice") / 10).alias("y")).alias("v"))
    g = at.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("v")).alias("v")).where("size(v) > 1")
    return g.select((F.col("l_orderkey") * 2).alias("index"), F.lit(2).alias("kind"), F.array(F.transform("v", lambda p: F.array(p["x"], p["y"]))).alias("parts"))


_W = "40075016.68557849::DOUBLE"
_BASE_SQL = "{w} * (({k} * 7919) % 100003) / 100003.0::DOUBLE - {w} / 2 AS {x}, 0.9::DOUBLE * ({w} * (({k} * 104729) % 99991) / 99991.0::DOUBLE - {w} / 2) AS {y}"
_MIX = """list_transform(list_transform(list_transform([(index::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT], lambda a: (xor(a, a // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT),
  lambda b: (xor(b, b // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT), lambda c: xor(c, c // 2147483648::UHUGEINT))[1]"""


@query()
def import_cascade(spark, sf_dir):
    """What is left of lines through lineitem, squares of orders and points of events at each level; half of the points go."""
    x, y = _base("event_id")
    p = table(spark, sf_dir, "events").select((F.col("event_id") + 10**12).alias("index"), F.lit(1).alias("kind"), F.array(F.array(F.array(x, y))).alias("parts"))
    shapes = _areas(spark, sf_dir).select("index", "kind", "parts").unionByName(_lines(spark, sf_dir)).unionByName(p)
    made = importer.cascade(shapes, LEVELS, 0.0, 0.0, AREA, LENGTH, "drop_rate", 0.5)
    out = [t.select(F.lit(z).cast("bigint").alias("z"), "index", "kind") for z, t in made.items()]
    return importer.reduce(lambda a, b: a.unionByName(b), out)


ORACLE_SQL["import_cascade"] = f"""WITH RECURSIVE v AS (
  SELECT l_orderkey, l_linenumber, x + l_quantity * 100 AS x, y + l_extendedprice / 10 AS y FROM (SELECT *, {_BASE_SQL.format(w=_W, k="l_orderkey", x="x", y="y")} FROM lineitem)
), e AS (SELECT l_orderkey, sqrt(pow(x - lag(x) OVER o, 2) + pow(y - lag(y) OVER o, 2)) AS d FROM v WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y)),
shapes AS (
  SELECT l_orderkey * 2 AS index, 2 AS kind, sum(d) AS measure FROM e GROUP BY l_orderkey HAVING count(*) > 1
  UNION ALL SELECT o_orderkey * 2 + 1, 3, pow(o_totalprice / 25, 2) FROM orders
  UNION ALL SELECT event_id + 1000000000000, 1, 0 FROM events
), low AS (
  SELECT 9::BIGINT AS z, index, kind, measure FROM shapes
  WHERE CASE kind WHEN 1 THEN {_MIX} // 2048 < 4503599627370496 WHEN 2 THEN measure >= {LENGTH} * {_W} / 512 / 4096 ELSE measure >= {AREA} * pow({_W} / 512 / 4096, 2) END
  UNION ALL
  SELECT z - 1, index, kind, measure FROM low
  WHERE z > 4 AND CASE kind WHEN 1 THEN TRUE WHEN 2 THEN measure >= {LENGTH} * {_W} / pow(2, z - 1) / 4096 ELSE measure >= {AREA} * pow({_W} / pow(2, z - 1) / 4096, 2) END
)
SELECT z, index, kind FROM low"""


@query(f""", c AS (SELECT event_id, {_BASE_SQL.format(w=_W, k="event_id", x="cx", y="cy")}, CASE WHEN event_id % 1000 = 7 THEN {_W} / 5 ELSE 2000.0::DOUBLE * (1 + event_id % 37) END AS h FROM events),
b AS (SELECT event_id AS index, cx - h AS x0, cx + h AS x1, cy - h / 2 AS y0, cy + h / 2 AS y1 FROM c),
k AS (SELECT DISTINCT x, y, x * {_W} / 4096 - {_W} / 2 AS tx, {_W} / 2 - (y + 1) * {_W} / 4096 AS ty, {_W} / 4096 AS w FROM t WHERE z = 12)
SELECT index, x, y FROM b JOIN k ON x0 < tx + w AND x1 > tx AND y0 < ty + w AND y1 > ty""")
def shape_tiles(spark, sf_dir):
    """Boxes around the events, a few of them as wide as two fifths of the world, and the tiles with events that they meet."""
    x, y = _base("event_id")
    h = F.when(F.col("event_id") % 1000 == 7, C.WORLD / 5).otherwise(2000.0 * (1 + F.col("event_id") % 37))
    b = table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), F.lit(3).alias("kind"), x.alias("x"), y.alias("y"), h.alias("h"))
    shapes = b.select("index", "kind", _ring(F.col("x") - F.col("h"), F.col("y") - F.col("h") / 2, F.col("x") + F.col("h"), F.col("y") + F.col("h") / 2).alias("parts"))
    return importer.tiles_of(shapes, tiled(spark, sf_dir, 12), 12)


@query(f""", c AS (SELECT o_orderkey, o_orderstatus, {_BASE_SQL.format(w=_W, k="o_orderkey", x="cx", y="cy")}, o_totalprice / 50 AS h FROM orders),
l AS (SELECT CAST(range AS BIGINT) AS z, {_W} / pow(2, range) AS w, {_W} / pow(2, range) / 4096 AS u FROM range(7, 10)),
b AS (SELECT o_orderkey, o_orderstatus, cx - h AS x0, cx + h AS x1, cy - h AS y0, cy + h AS y1, l.* FROM c, l WHERE pow(2 * h, 2) >= {AREA} * pow(u, 2)),
sx AS (SELECT *, unnest(range(CAST(greatest(0, floor((x0 - 80 * u + {_W} / 2) / w)) AS BIGINT), CAST(least(pow(2, z) - 1, floor((x1 + 80 * u + {_W} / 2) / w)) AS BIGINT) + 1)) AS x FROM b),
sy AS (SELECT *, unnest(range(CAST(greatest(0, floor(({_W} / 2 - y1 - 80 * u) / w)) AS BIGINT), CAST(least(pow(2, z) - 1, floor(({_W} / 2 - y0 + 80 * u) / w)) AS BIGINT) + 1)) AS y FROM sx),
g AS (SELECT *, floor((greatest(x0, x * w - {_W} / 2 - 80 * u) - (x * w - {_W} / 2)) / u + 0.5) AS px0, floor((least(x1, (x + 1) * w - {_W} / 2 + 80 * u) - (x * w - {_W} / 2)) / u + 0.5) AS px1,
  floor(({_W} / 2 - y * w - least(y1, {_W} / 2 - y * w + 80 * u)) / u + 0.5) AS py0, floor(({_W} / 2 - y * w - greatest(y0, {_W} / 2 - (y + 1) * w - 80 * u)) / u + 0.5) AS py1 FROM sy)
SELECT z, x, y, o_orderkey AS id, '"' || o_orderstatus || '"' AS status, CAST(px0 AS BIGINT) AS x_min, CAST(px1 AS BIGINT) AS x_max, CAST(py0 AS BIGINT) AS y_min, CAST(py1 AS BIGINT) AS y_max
FROM g WHERE px1 > px0 AND py1 > py0""")
def import_features(spark, sf_dir):
    """The squares of orders as features of three levels: the range that each covers in the units of its tiles."""
    areas = _areas(spark, sf_dir)
    made = importer.cascade(areas, range(7, 10), 0.0, 0.0, AREA)
    attributes = areas.select("index", F.col("o_orderkey").alias("id"), F.create_map(F.lit("status"), F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))).alias("props"))
    f = importer.draw_levels(made, attributes)
    end = lambda axis, g: g(F.transform(F.flatten("parts"), lambda p: p[axis]))
    return f.select("z", "x", "y", "id", F.col("props")["status"].alias("status"), end(0, F.array_min).alias("x_min"), end(0, F.array_max).alias("x_max"), end(1, F.array_min).alias("y_min"), end(1, F.array_max).alias("y_max"))


# --- outlines ------------------------------------------------------------------------------------

_EDGES = """, c AS (SELECT DISTINCT x, y FROM t WHERE z = 8),
sd AS (SELECT * FROM (VALUES (0, 1, 0, 0, -1), (1, 0, 1, 1, 0), (2, -1, 0, 0, 1), (3, 0, -1, -1, 0)) AS v(side, ax, ay, ox, oy)),
e AS (SELECT x, y, side, ax, ay, ox, oy, (y * 256 + x) * 4 + side AS edge FROM c, sd WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.x = c.x + ox AND o.y = c.y + oy)),
n AS (SELECT e.*, a.x IS NOT NULL AS ahead, b.x IS NOT NULL AS beyond FROM e LEFT JOIN c AS a ON a.x = e.x + ax AND a.y = e.y + ay LEFT JOIN c AS b ON b.x = e.x + ax + ox AND b.y = e.y + ay + oy),
k AS (SELECT *, CASE WHEN NOT ahead THEN (y * 256 + x) * 4 + (side + 1) % 4 WHEN NOT beyond THEN ((y + ay) * 256 + x + ax) * 4 + side ELSE ((y + ay + oy) * 256 + x + ax + ox) * 4 + (side + 3) % 4 END AS onward FROM n)"""
_WALK = """, w(start, cur) AS (SELECT edge, edge FROM k UNION SELECT w.start, k.onward FROM w JOIN k ON k.edge = w.cur),
m AS (SELECT start AS edge, min(cur) AS ring FROM w GROUP BY start),
g AS (SELECT m.ring, k.*, x + CASE WHEN side IN (1, 2) THEN 1 ELSE 0 END AS px, y + CASE WHEN side IN (2, 3) THEN 1 ELSE 0 END AS py FROM m JOIN k USING (edge)),
r AS (SELECT ring, count(*) FILTER (NOT ahead OR beyond) AS corners, CAST(sum(px * ay - py * ax) / 2 AS BIGINT) AS area FROM g GROUP BY ring),
h AS (SELECT ring, arg_min(x * 256 + y, x * 256 + y) AS place FROM g WHERE side = 1 AND ring IN (SELECT ring FROM r WHERE area < 0) GROUP BY ring),
u(ring, up) AS (
  SELECT h.ring, (SELECT arg_max(l.ring, l.x) FROM g AS l WHERE l.side = 3 AND l.y = place % 256 AND l.x <= place // 256) FROM h
  UNION SELECT u.ring, (SELECT arg_max(l.ring, l.x) FROM g AS l, h WHERE h.ring = u.up AND l.side = 3 AND l.y = place % 256 AND l.x <= place // 256) FROM u WHERE u.up IN (SELECT ring FROM r WHERE area < 0))"""
_RINGS_SQL = _EDGES + _WALK + " SELECT 8::BIGINT AS z, ring, corners, area, (SELECT max(up) FROM u JOIN r AS o ON o.ring = u.up WHERE u.ring = r.ring AND o.area > 0) AS parent FROM r"


@query()
def outline_rings(spark, sf_dir):
    """Rings around the tiles with events, holes with the ring that they lie in."""
    from tesselon.operators.outlines import outline_rings as rings

    return rings(tiled(spark, sf_dir, 8))[0]


def _recursive(sql: str) -> str:
    from tesselon.queries import _PRELUDE

    return _PRELUDE.replace("WITH p AS", "WITH RECURSIVE p AS", 1) + "\n" + sql


ORACLE_SQL["outline_rings"] = _recursive(_RINGS_SQL)


# --- the curve, back and in boxes ----------------------------------------------------------------


@query("SELECT DISTINCT event_id, z, x, y, z AS level, x AS back_x, y AS back_y FROM t WHERE z IN (0, 1, 7, 14)")
def hilbert_inverse(spark, sf_dir):
    """Tiles of the events at four levels, to their Hilbert ids and back."""
    p = points(spark, sf_dir).withColumn("z", F.explode(F.array(*[F.lit(z).cast("bigint") for z in (0, 1, 7, 14)])))
    p = p.withColumns({"x": C.tile_x("lon", "z"), "y": C.tile_y("lat", "z")})
    back = C.hilbert_tile(C.hilbert_id("z", "x", "y"))
    return p.withColumn("b", back).select("event_id", "z", "x", "y", F.col("b.z").alias("level"), F.col("b.x").alias("back_x"), F.col("b.y").alias("back_y"))


@query("SELECT event_id, x, y FROM t WHERE z = 10 AND x BETWEEN 301 AND 577 AND y BETWEEN 250 AND 700")
def hilbert_box(spark, sf_dir):
    """Events in a box of tiles, found by runs of Hilbert ids."""
    t = tiled(spark, sf_dir, 10).withColumn("id", C.hilbert_id("z", "x", "y"))
    return t.where(C.in_hilbert_box(10, (301, 250, 577, 700))).select("event_id", "x", "y")


# --- errors and mosaics --------------------------------------------------------------------------


@query(""", m AS (SELECT event_id, CASE WHEN event_id % 7 = 3 THEN substr(props, 1, length(props) - 1) WHEN event_id % 11 = 4 THEN NULL ELSE props END AS props FROM p)
SELECT event_id AS number, 'rejected' AS what FROM m WHERE props IS NOT NULL AND NOT json_valid(props)
UNION ALL SELECT count(*), 'rows' FROM m UNION ALL SELECT count(*) FILTER (NOT json_valid(props)), 'errors' FROM m UNION ALL SELECT count(*) FILTER (props IS NULL OR json_valid(props)), 'sound' FROM m""")
def rejected_rows(spark, sf_dir):
    """Properties of events, every seventh of them cut short: the events that are rejected, and the counts of the pass."""
    from tesselon.operators.errors import split_errors

    k = F.col("event_id")
    p = points(spark, sf_dir).select("event_id", F.when(k % 7 == 3, F.expr("substr(props, 1, length(props) - 1)")).when(k % 11 == 4, None).otherwise(F.col("props")).alias("props"))
    bad = F.when(F.col("props").isNotNull() & F.try_parse_json("props").isNull(), F.lit("no JSON object"))
    split = split_errors(p, bad, "properties", ["event_id"])
    counts = [(split.total, "rows"), (split.errors, "errors"), (split.rows.count(), "sound")]
    return split.failed.select(F.col("event_id").alias("number"), F.lit("rejected").alias("what")).unionByName(spark.createDataFrame(counts, "number bigint, what string"))


_BLEND = """list_reduce(list(struct_pack(r := r, g := g, b := b, a := a) ORDER BY source), lambda t, u: CASE WHEN t.a + u.a = 0 THEN struct_pack(r := 0, g := 0, b := 0, a := 0) ELSE struct_pack(
  r := CAST(least(255, (u.r * (CASE WHEN t.a + u.a >= 250 THEN 255 ELSE t.a + u.a END - t.a) + t.r * t.a + CASE WHEN t.a + u.a >= 250 THEN 255 ELSE t.a + u.a END // 2) // CASE WHEN t.a + u.a >= 250 THEN 255 ELSE t.a + u.a END) AS INTEGER),
  g := CAST(least(255, (u.g * (CASE WHEN t.a + u.a >= 250 THEN 255 ELSE t.a + u.a END - t.a) + t.g * t.a + CASE WHEN t.a + u.a >= 250 THEN 255 ELSE t.a + u.a END // 2) // CASE WHEN t.a + u.a >= 250 THEN 255 ELSE t.a + u.a END) AS INTEGER),
  b := CAST(least(255, (u.b * (CASE WHEN t.a + u.a >= 250 THEN 255 ELSE t.a + u.a END - t.a) + t.b * t.a + CASE WHEN t.a + u.a >= 250 THEN 255 ELSE t.a + u.a END // 2) // CASE WHEN t.a + u.a >= 250 THEN 255 ELSE t.a + u.a END) AS INTEGER),
  a := CASE WHEN t.a + u.a >= 250 THEN 255 ELSE t.a + u.a END) END)"""


@query(f""", o AS (SELECT o_orderkey % 1024 AS x, o_orderkey // 1024 % 2 AS y, o_custkey % 5 AS source, min(o_orderkey) AS k, max(CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 0 END) AS solid FROM orders GROUP BY ALL),
px AS (SELECT x, y, source, solid, i, CAST(k * 7 % 256 AS INTEGER) AS r, CAST((k * 13 + i * 50) % 256 AS INTEGER) AS g, CAST(k * 29 % 256 AS INTEGER) AS b, CAST(CASE WHEN solid = 1 THEN 255 ELSE k * 31 % 5 * (40 + i * 10) END AS INTEGER) AS a FROM o, (SELECT CAST(range AS INTEGER) AS i FROM range(0, 3))),
done AS (SELECT x, y, min(source) AS source FROM o WHERE solid = 1 GROUP BY x, y),
seen AS (SELECT px.* FROM px JOIN (SELECT x, y, source FROM px GROUP BY ALL HAVING max(a) > 0) AS s USING (x, y, source) WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.x = px.x AND done.y = px.y)),
q AS (SELECT x, y, i, struct_pack(r := r, g := g, b := b, a := a) AS p FROM px JOIN done USING (x, y, source) UNION ALL SELECT x, y, i, {_BLEND} FROM seen GROUP BY x, y, i)
SELECT 10::BIGINT AS z, x, y, CAST(i AS INTEGER) AS i, p.r AS r, p.g AS g, p.b AS b, p.a AS a FROM q""")
def mosaic(spark, sf_dir):
    """Tiles of three pixels of five sources, from orders: opaque, empty and translucent ones."""
    from tesselon.operators.mosaic import assemble

    k = F.col("k")
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 1024).alias("x"), F.expr("o_orderkey div 1024 % 2").alias("y"), (F.col("o_custkey") % 5).alias("source"))
    o = o.agg(F.min("o_orderkey").alias("k"), F.max(F.col("o_orderpriority") == "1-URGENT").alias("solid"))
    pixel = lambda i: F.struct((k * 7 % 256).cast("int").alias("r"), ((k * 13 + i * 50) % 256).cast("int").alias("g"), (k * 29 % 256).cast("int").alias("b"), F.when(F.col("solid"), 255).otherwise(k * 31 % 5 * (40 + i * 10)).cast("int").alias("a"))
    made = assemble(o.select(F.lit(10).cast("bigint").alias("z"), "x", "y", "source", F.array(*[pixel(i) for i in range(3)]).alias("pixels")))
    return made.select("z", "x", "y", F.posexplode("pixels").alias("i", "p")).select("z", "x", "y", "i", "p.*")


# --- masks and change feeds ----------------------------------------------------------------------


@query(f""", sup AS (SELECT s_suppkey, {_BASE_SQL.format(w=_W, k="s_suppkey", x="cx", y="cy")}, 2000000.0::DOUBLE + s_nationkey * 100000 AS r FROM supplier),
v AS (SELECT s_suppkey, k, (cx + r * cos(k * 2.1 + s_suppkey)) / {_W} * 512 + 256 AS x, 256 - (cy + r * sin(k * 2.1 + s_suppkey)) / {_W} * 512 AS y FROM sup, (SELECT CAST(range AS DOUBLE) AS k FROM range(0, 3))),
e AS (SELECT a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM v AS a JOIN v AS b ON a.s_suppkey = b.s_suppkey AND b.k = (a.k + 1) % 3),
k AS (SELECT DISTINCT x, y FROM t WHERE z = 9),
g AS (SELECT k.x, k.y, e.*, CASE WHEN x1 = x0 THEN 0 ELSE least((k.x - x0) / (x1 - x0), (k.x + 1 - x0) / (x1 - x0)) END AS xa, CASE WHEN x1 = x0 THEN 1 ELSE greatest((k.x - x0) / (x1 - x0), (k.x + 1 - x0) / (x1 - x0)) END AS xb,
  CASE WHEN y1 = y0 THEN 0 ELSE least((k.y - y0) / (y1 - y0), (k.y + 1 - y0) / (y1 - y0)) END AS ya, CASE WHEN y1 = y0 THEN 1 ELSE greatest((k.y - y0) / (y1 - y0), (k.y + 1 - y0) / (y1 - y0)) END AS yb FROM k, e)
SELECT x, y, CASE WHEN bool_or(greatest(0, xa, ya) <= least(1, xb, yb)) THEN 'partial'
  WHEN count(*) FILTER ((y0 > y + 0.5) <> (y1 > y + 0.5) AND x0 + (x1 - x0) * (y + 0.5 - y0) / (y1 - y0) < x + 0.5) % 2 = 1 THEN 'inside' ELSE 'outside' END AS class FROM g GROUP BY x, y""")
def mask_classes(spark, sf_dir):
    """Tiles with events against triangles around the suppliers, which overlap: even-odd."""
    from tesselon.operators import masks

    x, y = _base("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", x.alias("cx"), y.alias("cy"), (2_000_000.0 + F.col("s_nationkey") * 100_000).alias("r"))
    corner = lambda k: F.array(F.col("cx") + F.col("r") * F.cos(F.lit(k * 2.1) + F.col("s_suppkey")), F.col("cy") + F.col("r") * F.sin(F.lit(k * 2.1) + F.col("s_suppkey")))
    edges = masks.ring_edges(s.select(F.array(*[corner(k) for k in range(3)]).alias("points")), 9)
    return masks.classify(tiled(spark, sf_dir, 9), edges, 9)


@query(""", c AS (SELECT user_id % 400 AS k, arg_max(event_id, event_id) AS event_id FROM p GROUP BY user_id % 400),
w AS (SELECT t.z, t.x, t.y FROM t JOIN c USING (event_id) WHERE t.z <= 6 AND t.event_type <> 'error')
SELECT z, x, y, count(*) AS n FROM w GROUP BY z, x, y""")
def change_feed(spark, sf_dir):
    """Events as versions of some users' places, an error as a deletion, read as a stream: what is left in each tile."""
    from tesselon.streaming import changes

    stored_schema = table(spark, sf_dir, "events").schema
    feed = spark.readStream.schema(stored_schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    place = lambda a, m, width, low: F.lit(low) + F.lit(width) * ((F.col("event_id") * a) % m) / float(m)
    rows = feed.select((F.col("user_id") % 400).alias("key"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("deleted"), place(7919, 100003, 360.0, -180.0).alias("lon"), place(104729, 99991, 170.0, -85.0).alias("lat"))
    log = changes.new_log(spark)
    changes.follow_counts(rows, 6, log).awaitTermination()
    return changes.counts(spark, log)
