"""Registered queries of the tile engine and the SQL they are checked against.

Points, layers and sizes are derived from the tables, so that both engines see the same tiles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions import coords as C
from tesselon.functions import values as V
from tesselon.operators import general, levels, reports, tiles, vector
from tesselon.sources import features as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["z", "x", "y"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"{_PRELUDE}\n{sql}"
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    place = lambda a, m, width, low: F.lit(low) + F.lit(width) * ((F.col("event_id") * a) % m) / float(m)
    return e.select("event_id", "event_type", "user_id", "props", F.round(F.col("value") * 100).cast("bigint").alias("v"), place(7919, 100003, 360.0, -180.0).alias("lon"), place(104729, 99991, 170.0, -85.0).alias("lat"))


def tiled(spark: SparkSession, sf_dir: str, z: int) -> DataFrame:
    p = points(spark, sf_dir)
    return p.withColumns({"z": F.lit(z).cast("bigint"), "x": C.tile_x("lon", F.lit(z)), "y": C.tile_y("lat", F.lit(z))})


def moved(spark: SparkSession, sf_dir: str, z: int, k: int) -> DataFrame:
    """All events in tiles of a level, in columns that are dealt anew: another coverage of the same size."""
    return tiled(spark, sf_dir, z).withColumn("x", (F.col("x") * (2 * k + 1) + k) % (1 << z))


def sized(spark: SparkSession, sf_dir: str, z: int) -> DataFrame:
    """One row for each tile, its size the number of its events."""
    return tiled(spark, sf_dir, z).groupBy(KEY).agg(F.count(F.lit(1)).alias("size"), F.sum("v").alias("v"))


def pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sized tiles of levels 0 to 6, each event in every level."""
    p = points(spark, sf_dir).withColumn("z", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint"))))
    return p.withColumns({"x": C.tile_x("lon", "z"), "y": C.tile_y("lat", "z")}).groupBy(KEY).agg(F.count(F.lit(1)).alias("size"), F.sum("v").alias("v"))


def features(spark: SparkSession, sf_dir: str, z: int = 4) -> DataFrame:
    """Events as features: layer event_type, properties uid (text), n (number), big (true or false)."""
    t = tiled(spark, sf_dir, z)
    props = F.create_map(F.lit("uid"), F.concat(F.lit('"'), F.pmod("user_id", F.lit(200)).cast("string"), F.lit('"')), F.lit("n"), F.col("v").cast("string"), F.lit("big"), F.when(F.col("v") > 5000, "true").otherwise("false"))
    props = F.map_filter(props, lambda k, v: v.isNotNull() & ((k != "n") | (F.col("event_id") % 5 != 0)))
    return t.select(*KEY, F.col("event_type").alias("layer"), F.col("event_id").alias("feat_no"), F.col("event_id").alias("id"), props.alias("props"))


_PRELUDE = r"""
WITH p AS (
  SELECT event_id, event_type, user_id, props, CAST(round(value * 100) AS BIGINT) AS v,
         -180.0::DOUBLE + 360.0::DOUBLE * ((event_id * 7919) % 100003) / 100003.0::DOUBLE AS lon,
         -85.0::DOUBLE + 170.0::DOUBLE * ((event_id * 104729) % 99991) / 99991.0::DOUBLE AS lat
  FROM events
), t AS (
  SELECT p.*, l.z,
         CAST(greatest(0, least(pow(2, l.z) - 1, floor(pow(2, l.z) * (lon / 360.0 + 0.5)))) AS BIGINT) AS x,
         CAST(greatest(0, least(pow(2, l.z) - 1, floor(pow(2, l.z) * (0.5 - 0.5 * ln(tan(lat * pi() / 360.0 + pi() / 4.0)) / pi())))) AS BIGINT) AS y
  FROM p, (SELECT CAST(range AS BIGINT) AS z FROM range(0, 15)) AS l
), s AS (
  SELECT z, x, y, count(*) AS size, CAST(sum(v) AS BIGINT) AS v FROM t GROUP BY z, x, y
), f AS (
  SELECT z, x, y, event_type AS layer, event_id AS id, CAST(user_id % 200 AS VARCHAR) AS uid,
         CASE WHEN event_id % 5 <> 0 THEN v END AS n, v > 5000 AS big
  FROM t WHERE z = 4
)"""


# --- coordinates ---------------------------------------------------------------------------------


@query("SELECT z, x, y, size AS n FROM s WHERE z IN (4, 8, 14)")
def tile_bin(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("z", F.explode(F.array(*[F.lit(z).cast("bigint") for z in (4, 8, 14)])))
    return p.withColumns({"x": C.tile_x("lon", "z"), "y": C.tile_y("lat", "z")}).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT z, x, y, round(x / pow(2, z) * 360 - 180, 6) AS west, round(degrees(2 * atan(exp(pi() * (1 - 2 * (y + 1) / pow(2, z))))) - 90, 6) AS south,
round((x + 1) / pow(2, z) * 360 - 180, 6) AS east, round(degrees(2 * atan(exp(pi() * (1 - 2 * y / pow(2, z))))) - 90, 6) AS north FROM s WHERE z = 6""")
def tile_geo_bbox(spark, sf_dir):
    box = sized(spark, sf_dir, 6).select(*KEY, C.geo_bbox("z", "x", "y").alias("b"))
    return box.select(*KEY, *[F.round(f"b.{c}", 6).alias(c) for c in ("west", "south", "east", "north")])


@query("""SELECT z, x, y, round((x / pow(2, z) - 0.5) * 2 * pi() * 6378137.0, 2) AS x_min, round((0.5 - (y + 1) / pow(2, z)) * 2 * pi() * 6378137.0, 2) AS y_min,
round(((x + 1) / pow(2, z) - 0.5) * 2 * pi() * 6378137.0, 2) AS x_max, round((0.5 - y / pow(2, z)) * 2 * pi() * 6378137.0, 2) AS y_max FROM s WHERE z = 6""")
def tile_mercator_bbox(spark, sf_dir):
    box = sized(spark, sf_dir, 6).select(*KEY, C.mercator_bbox("z", "x", "y").alias("b"))
    return box.select(*KEY, *[F.round(f"b.{c}", 2).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])


@query("SELECT z, x, y, round(cos(2 * atan(exp(pi() * (1 - 2 * (y + 0.5) / pow(2, z)))) - pi() / 2) * 2 * pi() * 6378137.0 / pow(2, z), 3) AS metres FROM s WHERE z = 6")
def ground_size(spark, sf_dir):
    return sized(spark, sf_dir, 6).select(*KEY, F.round(C.ground_size("z", "y"), 3).alias("metres"))


@query("SELECT event_id, round(lon * pi() / 180 * 6378137.0, 3) AS mx, round(6378137.0 * ln(tan(lat * pi() / 360 + pi() / 4)), 3) AS my FROM p")
def mercator_points(spark, sf_dir):
    return points(spark, sf_dir).select("event_id", F.round(C.mercator_x("lon"), 3).alias("mx"), F.round(C.mercator_y("lat"), 3).alias("my"))


@query("SELECT z, x, y, CAST(floor((pow(4, z) - 1) / 3) AS BIGINT) + CAST(pow(2, z) AS BIGINT) * y + x AS idx FROM s WHERE z <= 6")
def sort_index(spark, sf_dir):
    return pyramid(spark, sf_dir).select(*KEY, C.sort_index("z", "x", "y").alias("idx"))


@query("""SELECT z, x, y, CAST(list_sum(list_transform(range(0, z), lambda i: (((x >> i) & 1) + 2 * ((y >> i) & 1)) * (1::BIGINT << (2 * i)))) AS BIGINT) AS code FROM s WHERE z BETWEEN 1 AND 6""")
def morton(spark, sf_dir):
    return pyramid(spark, sf_dir).where("z >= 1").select(*KEY, C.morton("z", "x", "y").alias("code"))


@query("""SELECT z, x, y, array_to_string(list_transform(range(z - 1, -1, -1), lambda i: CAST(((x >> i) & 1) + 2 * ((y >> i) & 1) AS VARCHAR)), '') || '4' AS k FROM s WHERE z <= 6""")
def depth_first_key(spark, sf_dir):
    return pyramid(spark, sf_dir).select(*KEY, C.depth_first_key("z", "x", "y").alias("k"))


@query("""SELECT z, x, y, (list_reduce(list_prepend({'px': x, 'py': y, 'd': 0::BIGINT}, list_transform(range(z - 1, -1, -1), lambda i: {'px': i, 'py': 0::BIGINT, 'd': 0::BIGINT})),
  lambda a, i: {
    'px': CASE WHEN (a.py >> i.px) & 1 = 0 THEN CASE WHEN (a.px >> i.px) & 1 = 1 THEN (1::BIGINT << i.px) - 1 - a.py ELSE a.py END ELSE a.px END,
    'py': CASE WHEN (a.py >> i.px) & 1 = 0 THEN CASE WHEN (a.px >> i.px) & 1 = 1 THEN (1::BIGINT << i.px) - 1 - a.px ELSE a.px END ELSE a.py END,
    'd': a.d * 4 + xor(3 * ((a.px >> i.px) & 1), (a.py >> i.px) & 1)})).d + CAST(floor((pow(4, z) - 1) / 3) AS BIGINT) AS id FROM s WHERE z BETWEEN 1 AND 6""")
def hilbert_id(spark, sf_dir):
    return pyramid(spark, sf_dir).where("z >= 1").select(*KEY, C.hilbert_id("z", "x", "y").alias("id"))


# --- filters, remapping, stacking ----------------------------------------------------------------


@query("SELECT z, x, y, size FROM s WHERE z BETWEEN 2 AND 4")
def filter_zoom(spark, sf_dir):
    return general.filter_tiles(pyramid(spark, sf_dir), level_min=2, level_max=4).select(*KEY, "size")


def _box_sql(border: int) -> str:
    side = "pow(2, z)"
    column = lambda lon: f"least({side} - 1, greatest(0, floor({side} * (({lon})::DOUBLE / 360 + 0.5))))"
    row = lambda lat: f"least({side} - 1, greatest(0, floor({side} * (0.5 - 0.5 * ln(tan(({lat})::DOUBLE * pi() / 360 + pi() / 4)) / pi()))))"
    return f"""SELECT z, x, y, size FROM s WHERE z <= 6 AND x BETWEEN {column("0 + 1e-10")} - {border} AND {column("40 - 1e-10")} + {border}
AND y BETWEEN {row("20 - 1e-10")} - {border} AND {row("0 + 1e-10")} + {border}"""


@query(_box_sql(0))
def filter_bbox(spark, sf_dir):
    return general.filter_tiles(pyramid(spark, sf_dir), bbox=(0, 0, 40, 20)).select(*KEY, "size")


@query(_box_sql(2))
def filter_bbox_border(spark, sf_dir):
    return general.filter_tiles(pyramid(spark, sf_dir), bbox=(0, 0, 40, 20), bbox_border=2).select(*KEY, "size")


@query("SELECT z, x, y, size FROM s WHERE z = 8 AND EXISTS (SELECT 1 FROM t WHERE t.z = 8 AND (t.x * 3 + 1) % 256 = s.x AND t.y = s.y)")
def filter_mask(spark, sf_dir):
    return general.filter_tiles(sized(spark, sf_dir, 8), mask=moved(spark, sf_dir, 8, 1)).select(*KEY, "size")


for _name, _args, _sql in (
    ("remap_flip_x", {"flip_x": True}, "CAST(pow(2, z) AS BIGINT) - 1 - x AS x, y"),
    ("remap_flip_y", {"flip_y": True}, "x, CAST(pow(2, z) AS BIGINT) - 1 - y AS y"),
    ("remap_swap_xy", {"swap_xy": True}, "y AS x, x AS y"),
    ("remap_all", {"flip_x": True, "flip_y": True, "swap_xy": True}, "CAST(pow(2, z) AS BIGINT) - 1 - y AS x, CAST(pow(2, z) AS BIGINT) - 1 - x AS y"),
):
    QUERIES[_name] = lambda spark, sf_dir, args=_args: general.remap_coords(sized(spark, sf_dir, 6), **args).select(*KEY, "size")
    ORACLE_SQL[_name] = f"{_PRELUDE}\nSELECT z, {_sql}, size FROM s WHERE z = 6"


def _third(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return moved(spark, sf_dir, 8, k).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.lit(k).cast("bigint").alias("src"))


_THIRDS = ", src AS (" + " UNION ALL ".join(f"SELECT z, (x * {2 * k + 1} + {k}) % 256 AS x, y, count(*) AS n, {k}::BIGINT AS src FROM t WHERE z = 8 GROUP BY ALL" for k in range(3)) + ")"


@query(_THIRDS + " SELECT z, x, y, n, src FROM src QUALIFY row_number() OVER (PARTITION BY z, x, y ORDER BY src) = 1")
def stacked(spark, sf_dir):
    return general.stack([_third(spark, sf_dir, k) for k in range(3)])


@query(_THIRDS + " SELECT z, x, y, n, src FROM src QUALIFY row_number() OVER (PARTITION BY z, x, y ORDER BY src) = 1 AND bool_or(n >= 2) OVER (PARTITION BY z, x, y)")
def stacked_native_policy(spark, sf_dir):
    return general.stack_native([_third(spark, sf_dir, k) for k in range(3)], F.col("n") >= 2)


@query("""SELECT z, x, y, layer, row_number() OVER (PARTITION BY z, x, y, layer ORDER BY id % 2, id) - 1 AS feat_no, id FROM f""")
def merged_vector(spark, sf_dir):
    f = features(spark, sf_dir).select(*KEY, "layer", "feat_no", "id")
    return general.merge_features([f.where("id % 2 = 0"), f.where("id % 2 = 1")])


@query("SELECT z, x, y, min(event_id) AS event_id FROM t WHERE z = 7 GROUP BY z, x, y")
def sink_first_wins(spark, sf_dir):
    return general.first_of_each(tiled(spark, sf_dir, 7).select(*KEY, "event_id"), "event_id")


_A, _B = "(SELECT DISTINCT z, x, y FROM t WHERE z = 8)", "(SELECT DISTINCT z, (x * 3 + 1) % 256 AS x, y FROM t WHERE z = 8)"
for _name, _op, _word in (("cover_union", general.cover_union, "UNION"), ("cover_intersection", general.cover_intersection, "INTERSECT"), ("cover_difference", general.cover_difference, "EXCEPT")):
    QUERIES[_name] = lambda spark, sf_dir, op=_op: op(tiled(spark, sf_dir, 8), moved(spark, sf_dir, 8, 1))
    ORACLE_SQL[_name] = f"{_PRELUDE}\nSELECT * FROM {_A} {_word} SELECT * FROM {_B}"


@query("""SELECT DISTINCT z, x + dx AS x, y + dy AS y FROM (SELECT DISTINCT z, x, y FROM t WHERE z = 9),
(SELECT CAST(range AS BIGINT) AS dx FROM range(-2, 3)), (SELECT CAST(range AS BIGINT) AS dy FROM range(-2, 3)) WHERE x + dx BETWEEN 0 AND 511 AND y + dy BETWEEN 0 AND 511""")
def cover_buffer(spark, sf_dir):
    return general.cover_buffer(tiled(spark, sf_dir, 9), 2)


@query("""SELECT z, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(*) AS tiles,
CAST(floor(count(*) * 100 / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1))) AS BIGINT) AS percent FROM s WHERE z <= 6 GROUP BY z""")
def coverage_pyramid(spark, sf_dir):
    return general.pyramid_summary(pyramid(spark, sf_dir))


@query("""SELECT round(sum(n * (a / pow(2, z) * 360 - 180)) / sum(n), 6) AS west, round(sum(n * (degrees(2 * atan(exp(pi() * (1 - 2 * (d + 1) / pow(2, z))))) - 90)) / sum(n), 6) AS south,
round(sum(n * ((b + 1) / pow(2, z) * 360 - 180)) / sum(n), 6) AS east, round(sum(n * (degrees(2 * atan(exp(pi() * (1 - 2 * c / pow(2, z))))) - 90)) / sum(n), 6) AS north
FROM (SELECT z, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, count(*) AS n FROM s WHERE z <= 6 GROUP BY z)""")
def weighted_bbox(spark, sf_dir):
    return general.weighted_bbox(pyramid(spark, sf_dir))


@query("""SELECT round((bw + be) / 2, 6) AS center_lon, round((bs + bn) / 2, 6) AS center_lat, least(z0 + 2, z1) AS center_zoom,
round(w * 360 - 180, 6) AS west, round(degrees(2 * atan(exp(pi() * (1 - 2 * s)))) - 90, 6) AS south, round(e * 360 - 180, 6) AS east, round(degrees(2 * atan(exp(pi() * (1 - 2 * n)))) - 90, 6) AS north
FROM (SELECT min(z) AS z0, max(z) AS z1, greatest(0, min((a + 1) / pow(2, z)) - 0.5 / pow(2, max(z))) AS w, least(1, max(b / pow(2, z)) + 0.5 / pow(2, max(z))) AS e,
greatest(0, min((c + 1) / pow(2, z)) - 0.5 / pow(2, max(z))) AS n, least(1, max(d / pow(2, z)) + 0.5 / pow(2, max(z))) AS s,
arg_max(a / pow(2, z) * 360 - 180, z) AS bw, arg_max((b + 1) / pow(2, z) * 360 - 180, z) AS be,
arg_max(degrees(2 * atan(exp(pi() * (1 - 2 * c / pow(2, z))))) - 90, z) AS bn, arg_max(degrees(2 * atan(exp(pi() * (1 - 2 * (d + 1) / pow(2, z))))) - 90, z) AS bs
FROM (SELECT z, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM s WHERE z <= 6 GROUP BY z))""")
def center_and_touching_bbox(spark, sf_dir):
    row = general.center_and_touching_bbox(pyramid(spark, sf_dir))
    return row.select("center_zoom", *[F.round(c, 6).alias(c) for c in ("center_lon", "center_lat", "west", "south", "east", "north")])


@query("""SELECT z, axis, line, min(along) AS first, max(along) + 1 AS last FROM (
SELECT *, along - row_number() OVER (PARTITION BY z, axis, line ORDER BY along) AS run FROM (
SELECT z, axis, line, along FROM (
SELECT z, 'v' AS axis, x AS line, y AS along FROM c UNION ALL SELECT z, 'v', x + 1, y FROM c UNION ALL SELECT z, 'h', y, x FROM c UNION ALL SELECT z, 'h', y + 1, x FROM c)
GROUP BY ALL HAVING count(*) = 1)) GROUP BY z, axis, line, run""".replace("FROM c", "FROM (SELECT DISTINCT z, x, y FROM t WHERE z = 8)"))
def cover_outline(spark, sf_dir):
    return general.outline(tiled(spark, sf_dir, 8))


@query("""SELECT layer, attribute, count(*) AS features, count(DISTINCT value) AS distinct_values, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM (
SELECT layer, 'uid' AS attribute, '"' || uid || '"' AS value FROM f UNION ALL SELECT layer, 'n', CAST(n AS VARCHAR) FROM f WHERE n IS NOT NULL UNION ALL SELECT layer, 'big', CASE WHEN big THEN 'true' ELSE 'false' END FROM f) GROUP BY ALL""")
def attribute_use(spark, sf_dir):
    return tiles.attribute_use(features(spark, sf_dir))


# --- features ------------------------------------------------------------------------------------

_FLAT = "z, x, y, layer, id, uid, n, big"


def flat(f: DataFrame, *more: str) -> DataFrame:
    prop = lambda k: F.try_element_at("props", F.lit(k))
    return f.select(*KEY, "layer", "id", vector.plain(prop("uid")).alias("uid"), prop("n").try_cast("bigint").alias("n"), prop("big").try_cast("boolean").alias("big"), *[vector.plain(prop(k)).alias(k) for k in more])


@query(f"SELECT {_FLAT} FROM f WHERE layer NOT IN ('click', 'view')")
def filter_layers(spark, sf_dir):
    return flat(vector.filter_layers(features(spark, sf_dir), ["click", "view"]))


@query(f"SELECT {_FLAT} FROM f WHERE layer IN ('click', 'view')")
def filter_layers_invert(spark, sf_dir):
    return flat(vector.filter_layers(features(spark, sf_dir), ["click", "view"], invert=True))


@query("SELECT z, x, y, layer, id, CASE WHEN layer <> 'click' THEN uid END AS uid, CAST(NULL AS BIGINT) AS n, big FROM f")
def filter_properties(spark, sf_dir):
    return flat(vector.filter_properties(features(spark, sf_dir), "^click/uid$|/n$"))


@query("SELECT z, x, y, layer, id, CASE WHEN layer = 'click' THEN uid END AS uid, n, CAST(NULL AS BOOLEAN) AS big FROM f")
def filter_properties_invert(spark, sf_dir):
    return flat(vector.filter_properties(features(spark, sf_dir), "^click/uid$|/n$", invert=True))


for _name, _expr, _sql in (
    ("eq", 'uid == "7"', "uid = '7'"),
    ("range_and", "n >= 1000 && n < 6000 && !big", "n >= 1000 AND n < 6000 AND NOT big"),
    ("in_list", 'uid in ["1", "2", "33"] || big', "uid IN ('1', '2', '33') OR big"),
    ("regex", 'uid.matches("^1.*9$")', "regexp_matches(uid, '^1.*9$')"),
    ("null", "n == null", "n IS NULL"),
    ("has", 'has(props.n) && props["n"] != 0', "n IS NOT NULL AND n <> 0"),
    ("error_drops", "uid > 5", "FALSE"),
    ("not_boolean_drops", "n", "FALSE"),
    ("json_null", "missing == null && n != null", "n IS NOT NULL"),
    ("text_parts", "uid.startsWith('1') && !uid.endsWith('7') || uid.contains('42')", "uid LIKE '1%' AND NOT uid LIKE '%7' OR uid LIKE '%42%'"),
    ("sizes", "size(uid) == 2 || uid.size() > size(['a', 'b']) && big || size(n) > 0", "length(uid) = 2 OR length(uid) > 2 AND big"),
    ("whole_numbers", "n >= 9007199254740993 || n == 4611 || n < 100", "n >= 9007199254740993 OR n = 4611 OR n < 100"),
):
    QUERIES[f"filter_features_{_name}"] = lambda spark, sf_dir, e=_expr: flat(vector.filter_features(features(spark, sf_dir), ["click", "purchase", "view", "signup", "error"], e))
    ORACLE_SQL[f"filter_features_{_name}"] = f"{_PRELUDE}\nSELECT {_FLAT} FROM f WHERE layer NOT IN ('click', 'purchase', 'view', 'signup', 'error') OR coalesce({_sql}, FALSE)"


def _dim(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select((F.col("c_custkey") * 2).cast("string").alias("key_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("n"), F.col("c_custkey").alias("line"))


_DIM = ", d AS (SELECT CAST(c_custkey * 2 AS VARCHAR) AS key_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS dn FROM customer)"


@query(_DIM + " SELECT z, x, y, layer, id, uid, coalesce(dn, n) AS n, big, name FROM f LEFT JOIN d ON layer = 'click' AND uid = key_id")
def update_properties_left(spark, sf_dir):
    return flat(vector.update_properties(features(spark, sf_dir), _dim(spark, sf_dir), "click", "uid", "key_id", line="line"), "name")


@query(_DIM + " SELECT z, x, y, layer, id, uid, coalesce(dn, n) AS n, big, name FROM f LEFT JOIN d ON layer = 'click' AND uid = key_id WHERE layer <> 'click' OR key_id IS NOT NULL")
def update_properties_inner(spark, sf_dir):
    return flat(vector.update_properties(features(spark, sf_dir), _dim(spark, sf_dir), "click", "uid", "key_id", remove_non_matching=True, line="line"), "name")


@query(_DIM + """ SELECT z, x, y, layer, id, CASE WHEN key_id IS NULL THEN uid END AS uid, CASE WHEN key_id IS NULL THEN n ELSE dn END AS n,
CASE WHEN key_id IS NULL THEN big END AS big, name, key_id FROM f LEFT JOIN d ON layer = 'click' AND uid = key_id""")
def update_properties_replace(spark, sf_dir):
    return flat(vector.update_properties(features(spark, sf_dir), _dim(spark, sf_dir), "click", "uid", "key_id", replace_properties=True, include_id=True, line="line"), "name", "key_id")


@query("""SELECT layer, field, CASE field WHEN 'uid' THEN 'String' WHEN 'n' THEN 'Number' ELSE 'Boolean' END AS type, 4::BIGINT AS minzoom, 4::BIGINT AS maxzoom
FROM (SELECT DISTINCT layer, unnest(CASE WHEN n IS NULL THEN ['uid', 'big'] ELSE ['uid', 'n', 'big'] END) AS field FROM f)""")
def field_schema_rank(spark, sf_dir):
    return vector.field_types(features(spark, sf_dir))


@query("""SELECT layer, 'any' AS field, CASE layer WHEN 'click' THEN 'Boolean' WHEN 'view' THEN 'Number' ELSE 'String' END AS type,
4::BIGINT AS minzoom, 4::BIGINT AS maxzoom FROM f GROUP BY layer HAVING layer IN ('click', 'view') OR (bool_or(id % 2 = 0) AND bool_or(id % 2 = 1))""")
def field_schema_conflict(spark, sf_dir):
    value = F.when(F.col("layer") == "click", "true").when(F.col("layer") == "view", "12").when(F.col("id") % 2 == 0, "true").otherwise("12")
    f = features(spark, sf_dir).withColumn("props", F.create_map(F.lit("any"), value))
    return vector.field_types(f, "conflict")


@query("""SELECT layer, attribute, problem, count(*) AS features FROM (
  SELECT layer, 'n' AS attribute, CASE WHEN n IS NULL THEN 'missing' END AS problem FROM f WHERE layer = 'click'
  UNION ALL SELECT layer, 'uid', 'type' FROM f WHERE layer = 'view'
  UNION ALL SELECT layer, 'big', 'zoom' FROM f WHERE layer = 'view') WHERE problem IS NOT NULL GROUP BY ALL""")
def schema_rules(spark, sf_dir):
    rules = spark.createDataFrame([("click", "n", "Number", True, 0), ("view", "uid", "Number", True, 0), ("view", "big", "Boolean", True, 9)], "layer string, attribute string, type string, required boolean, minzoom int")
    return reports.schema_violations(features(spark, sf_dir), rules)


@query("""SELECT severity, rule, layer, attribute, CAST(count(*) AS BIGINT) AS occurrences, min([z, x, y])[1] AS first_z, min([z, x, y])[2] AS first_x, min([z, x, y])[3] AS first_y FROM (
  SELECT DISTINCT 'warn' AS severity, 'unknown_layer' AS rule, layer, NULL AS attribute, z, x, y FROM f WHERE layer NOT IN ('click', 'view', 'purchase')
  UNION ALL (SELECT DISTINCT 'warn', 'below_minzoom', layer, NULL, z, x, y FROM f WHERE layer = 'view')
  UNION ALL SELECT 'error', 'missing_required', layer, 'n', z, x, y FROM f WHERE layer IN ('click', 'purchase') AND n IS NULL
  UNION ALL SELECT 'error', 'wrong_type', layer, 'n', z, x, y FROM f WHERE layer = 'purchase' AND n IS NOT NULL
  UNION ALL SELECT 'error', 'wrong_type', layer, 'uid', z, x, y FROM f WHERE layer = 'view'
  UNION ALL SELECT 'warn', 'bad_enum_value', layer, 'big', z, x, y FROM f WHERE layer = 'view' AND NOT big
  UNION ALL SELECT 'hint', 'bad_enum_value', layer, 'uid', z, x, y FROM f WHERE layer = 'click' AND uid NOT IN ('1', '2', '3')
  UNION ALL SELECT 'warn', 'unknown_attribute', layer, 'big', z, x, y FROM f WHERE layer = 'click'
  UNION ALL SELECT 'warn', 'unknown_attribute', layer, 'uid', z, x, y FROM f WHERE layer = 'purchase')
GROUP BY severity, rule, layer, attribute""")
def schema_issues(spark, sf_dir):
    layers = spark.createDataFrame([("click", 0), ("view", 9), ("purchase", 0)], "layer string, minzoom int")
    rules = [
        ("click", "n", "Number", True, None, None), ("click", "uid", "String", True, ["1", "2", "3"], "hint"), ("view", "uid", "Number", True, None, None), ("view", "n", "Number", False, None, None),
        ("view", "big", "Boolean", True, ["true"], None), ("purchase", "n", "String", True, None, None), ("purchase", "big", "Boolean", False, None, None),
    ]
    attributes = spark.createDataFrame(rules, "layer string, attribute string, type string, required boolean, enum array<string>, enum_severity string")
    return reports.schema_issues(features(spark, sf_dir), layers, attributes)


@query("""SELECT z, x, y, layer, pos, coalesce(extent, 4096) AS extent, coalesce(version, 1) AS version
FROM (SELECT z, x, y, layer, id AS pos, CASE WHEN id % 2 = 0 THEN 512 END AS extent, CASE WHEN id % 3 = 0 THEN 2 END AS version FROM f)
QUALIFY row_number() OVER (PARTITION BY z, x, y, layer ORDER BY pos) = 1""")
def repair_layers(spark, sf_dir):
    f = features(spark, sf_dir).select(*KEY, "layer", F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, 512).alias("extent"), F.when(F.col("id") % 3 == 0, 2).alias("version"))
    return vector.repair_layers(f)


# --- levels --------------------------------------------------------------------------------------


@query("SELECT z, x, y, size, v FROM s WHERE z <= 6")
def overview_sum(spark, sf_dir):
    return levels.overview(sized(spark, sf_dir, 6), 6, {"size": F.sum("size"), "v": F.sum("v")})


@query("SELECT 5::BIGINT AS z, x // 2 AS x, y // 2 AS y, count(*) AS children, min(y * 64 + x) AS first FROM s WHERE z = 6 GROUP BY ALL")
def overview_coords(spark, sf_dir):
    g = levels.group_by_parent(sized(spark, sf_dir, 6))
    return g.select(*KEY, F.size("children").cast("bigint").alias("children"), (F.col("children")[0]["y"] * 64 + F.col("children")[0]["x"]).alias("first"))


_PIXELS = """, px AS (SELECT 3::BIGINT AS z, o_orderkey % 4 AS x, 0::BIGINT AS y, (o_orderkey // 4) % 64 AS px, (o_orderkey // 256) % 64 AS py,
CAST(round(max(o_totalprice * 10)) AS BIGINT) AS raw, CAST(count(*) % 3 * 100 AS BIGINT) AS a FROM orders GROUP BY ALL)"""


def _pixels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    down = lambda k: F.floor(F.col("o_orderkey") / k).cast("bigint") % 64
    cell = o.select(F.lit(3).cast("bigint").alias("z"), (F.col("o_orderkey") % 4).alias("x"), F.lit(0).cast("bigint").alias("y"), down(4).alias("px"), down(256).alias("py"), (F.col("o_totalprice") * 10).alias("r"))
    return cell.groupBy(*KEY, "px", "py").agg(F.round(F.max("r")).cast("bigint").alias("raw"), (F.count(F.lit(1)) % 3 * 100).alias("a"))


@query(_PIXELS + " SELECT z, x, y, px // 2 AS px, py // 2 AS py, CAST((sum(raw) + 2) // 4 AS BIGINT) AS raw FROM px GROUP BY ALL")
def dem_overview_rgb(spark, sf_dir):
    return levels.dem_overview(_pixels(spark, sf_dir))


@query(_PIXELS + """ SELECT z, x, y, px // 2 AS px, py // 2 AS py, CAST(CASE WHEN count(*) FILTER (a > 0) > 0 THEN (sum(raw) FILTER (a > 0) + count(*) FILTER (a > 0) // 2) // count(*) FILTER (a > 0) ELSE 0 END AS BIGINT) AS raw,
CAST((sum(a) + 2) // 4 AS BIGINT) AS a FROM px GROUP BY ALL""")
def dem_overview_rgba(spark, sf_dir):
    return levels.dem_overview(_pixels(spark, sf_dir), alpha=True)


@query("""SELECT o_orderkey, bits, CAST(q - q % CAST(pow(2, bits) AS BIGINT) AS BIGINT) AS quantized FROM (
SELECT o_orderkey, bits, least(raw + CAST(floor(pow(2, bits) / 2) AS BIGINT), 16777215) AS q FROM (
SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) % 16777216 AS raw, CAST(CASE WHEN (o_orderkey % 50) * 0.7::DOUBLE >= 1 THEN least(24, floor(log2((o_orderkey % 50) * 0.7::DOUBLE + 1))) ELSE 0 END AS INTEGER) AS bits FROM orders))""")
def dem_quantize(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.round("o_totalprice").cast("bigint") % (1 << 24)).alias("raw"), V.quantize_bits((F.col("o_orderkey") % 50) * F.lit(0.7)).alias("bits"))
    return o.select("o_orderkey", "bits", V.quantize("raw", F.col("bits")).alias("quantized"))


@query("""SELECT c_custkey, CAST(greatest(0, least(16777215, floor((c_acctbal + 10000.0::DOUBLE) * 10.0::DOUBLE + 0.5::DOUBLE))) AS BIGINT) AS mapbox,
CAST(greatest(0, least(16777215, floor((c_acctbal + 32768.0::DOUBLE) * 256.0::DOUBLE + 0.5::DOUBLE))) AS BIGINT) AS terrarium,
round(floor((c_acctbal + 32768.0::DOUBLE) * 256.0::DOUBLE + 0.5::DOUBLE) / 256 - 32768, 4) AS metres FROM customer""")
def dem_codec(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    t = V.elevation_raw("c_acctbal", "terrarium")
    return c.select("c_custkey", V.elevation_raw("c_acctbal").alias("mapbox"), t.alias("terrarium"), F.round(V.elevation(t, "terrarium"), 4).alias("metres"))


_WANTED = ", want AS (SELECT DISTINCT z, x, y FROM t WHERE z IN (4, 6, 7)), src AS (SELECT z, x, y, size FROM s WHERE z = 5 AND size > 3 OR z = 4 AND size > 20 OR z = 3)"


def _wanted(spark, sf_dir):
    src = pyramid(spark, sf_dir).where("z = 5 AND size > 3 OR z = 4 AND size > 20 OR z = 3").select(*KEY, "size")
    want = points(spark, sf_dir).withColumn("z", F.explode(F.array(*[F.lit(z).cast("bigint") for z in (4, 6, 7)])))
    return want.withColumns({"x": C.tile_x("lon", "z"), "y": C.tile_y("lat", "z")}).select(KEY).distinct(), src


@query(_WANTED + """ SELECT w.z, w.x, w.y, least(w.z, 5) AS source_z, w.x % CAST(pow(2, greatest(w.z - 5, 0)) AS BIGINT) AS sub_x, w.y % CAST(pow(2, greatest(w.z - 5, 0)) AS BIGINT) AS sub_y, src.size
FROM want w JOIN src ON src.z = least(w.z, 5) AND src.x = CAST(floor(w.x / pow(2, greatest(w.z - 5, 0))) AS BIGINT) AND src.y = CAST(floor(w.y / pow(2, greatest(w.z - 5, 0))) AS BIGINT)""")
def overscale_parent(spark, sf_dir):
    want, src = _wanted(spark, sf_dir)
    return levels.overscale(want, src, 5)


@query(_WANTED + """ SELECT w.z, w.x, w.y, src.z AS source_z, src.size FROM want w JOIN src ON src.z BETWEEN 3 AND least(w.z, 5)
AND src.x = CAST(floor(w.x / pow(2, w.z - src.z)) AS BIGINT) AND src.y = CAST(floor(w.y / pow(2, w.z - src.z)) AS BIGINT) QUALIFY row_number() OVER (PARTITION BY w.z, w.x, w.y ORDER BY src.z DESC) = 1""")
def climbing_asof(spark, sf_dir):
    want, src = _wanted(spark, sf_dir)
    return levels.climb(want, src, 5, 3)


@query("""SELECT z + 1 AS z, x * 2 + q % 2 AS x, y * 2 + q // 2 AS y, size, q AS quadrant FROM s, (SELECT CAST(range AS BIGINT) AS q FROM range(0, 4)) WHERE z <= 3
UNION ALL SELECT z, x, y, size, NULL FROM s WHERE z = 0""")
def resize_split(spark, sf_dir):
    return levels.split_tiles(pyramid(spark, sf_dir).where("z <= 3").select(*KEY, "size"))


@query("SELECT z - 1 AS z, x // 2 AS x, y // 2 AS y, CAST(sum(size) AS BIGINT) AS size FROM s WHERE z = 6 GROUP BY ALL")
def resize_merge(spark, sf_dir):
    return levels.merge_tiles(sized(spark, sf_dir, 6), {"size": F.sum("size")})


@query("""SELECT 5::BIGINT AS z, x * 2 + i AS x, y * 2 + j AS y, id, CAST(floor((px - i * 2048) * 2 + 0.5) AS BIGINT) AS px, CAST(floor((py - j * 2048) * 2 + 0.5) AS BIGINT) AS py
FROM (SELECT z, x, y, event_id AS id, event_id * 31 % 4096 AS px, event_id * 57 % 4096 AS py FROM t WHERE z = 4), (SELECT CAST(range AS BIGINT) AS i FROM range(0, 2)), (SELECT CAST(range AS BIGINT) AS j FROM range(0, 2))
WHERE px BETWEEN i * 2048 - 40 AND (i + 1) * 2048 + 40 AND py BETWEEN j * 2048 - 40 AND (j + 1) * 2048 + 40
UNION ALL SELECT z, x, y, event_id, event_id * 31 % 4096, event_id * 57 % 4096 FROM t WHERE z = 4""")
def overzoom_points(spark, sf_dir):
    p = tiled(spark, sf_dir, 4).select(*KEY, F.col("event_id").alias("id"), (F.col("event_id") * 31 % 4096).alias("px"), (F.col("event_id") * 57 % 4096).alias("py"))
    return levels.overzoom_points(p, 4, 5)


# --- reports -------------------------------------------------------------------------------------


@query("SELECT z, count(*) AS tiles FROM s WHERE z <= 6 GROUP BY ROLLUP (z)")
def count_tiles_rollup(spark, sf_dir):
    return reports.count_tiles(pyramid(spark, sf_dir))


@query("SELECT z, count(*) AS tiles, CAST(sum(size) AS BIGINT) AS bytes, CAST(floor(sum(size) / count(*)) AS BIGINT) AS average FROM s WHERE z <= 6 GROUP BY z")
def size_stats(spark, sf_dir):
    return reports.size_stats(pyramid(spark, sf_dir))


@query("SELECT z, x, y, size FROM s WHERE z = 6 ORDER BY size DESC, z, x, y LIMIT 10")
def top10_tiles(spark, sf_dir):
    return reports.biggest_tiles(sized(spark, sf_dir, 6))


@query("SELECT z, x, y, size FROM s WHERE z = 4 AND size <= 40")
def size_cap(spark, sf_dir):
    return reports.within_cap(sized(spark, sf_dir, 4), 40).select(*KEY, "size")


@query("SELECT z, layer, count(DISTINCT x * 1000 + y) AS tiles, count(*) AS features FROM f GROUP BY z, layer")
def layer_stats(spark, sf_dir):
    return reports.layer_stats(features(spark, sf_dir))


@query("SELECT z, x // 8 AS x, y // 8 AS y, CAST(least(255, floor(10 * log2(greatest(sum(size * 1000) / 64.0::DOUBLE, 1.0::DOUBLE)))) AS BIGINT) AS level FROM s WHERE z = 6 GROUP BY ALL")
def size_raster(spark, sf_dir):
    return reports.size_raster(sized(spark, sf_dir, 6).withColumn("size", F.col("size") * 1000), 8)


def _mix_sql(x: str) -> str:
    """The finaliser of splitmix64 in wide integers."""
    step = lambda v, shift, factor: f"(xor({v}, {v} // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT"
    return f"list_transform(list_transform(list_transform([{x}], lambda a: {step('a', 30, 0xBF58476D1CE4E5B9)}), lambda b: {step('b', 27, 0x94D049BB133111EB)}), lambda c: xor(c, c // 2147483648::UHUGEINT))[1]"


@query(f""", b AS (SELECT z, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM s WHERE z IN (6, 8, 10) GROUP BY z),
k AS (SELECT b.*, least(64, w) AS sw, least(64, h) AS sh, greatest(1, CAST(ceil(ceil(0.02::DOUBLE * (SELECT max(w * h) FROM b)) / 4096) AS BIGINT)) AS k FROM b),
i AS (SELECT k.*, CAST(range AS BIGINT) AS i, xor(z::UHUGEINT * 1099511627776::UHUGEINT, range::UHUGEINT * 2) AS seed FROM k, range(0, 4096) WHERE range < 8 * k),
c AS (SELECT *, x0 + CAST({_mix_sql("seed")} % (w - sw + 1)::UHUGEINT AS BIGINT) AS cx, y0 + CAST({_mix_sql("xor(seed, 1::UHUGEINT)")} % (h - sh + 1)::UHUGEINT AS BIGINT) AS cy FROM i),
d AS (SELECT z, cx, cy, any_value(sw) AS sw, any_value(sh) AS sh, any_value(k) AS k, min(i) AS i FROM c GROUP BY z, cx, cy),
p2 AS (SELECT z, cx, cy, sw, sh FROM d QUALIFY row_number() OVER (PARTITION BY z ORDER BY i) <= k)
SELECT z, x, y, size FROM s WHERE EXISTS (SELECT 1 FROM k WHERE k.z = s.z AND k.k * sw * sh >= w * h)
OR EXISTS (SELECT 1 FROM p2 JOIN k USING (z) WHERE p2.z = s.z AND k.k * k.sw * k.sh < w * h AND x BETWEEN cx AND cx + p2.sw - 1 AND y BETWEEN cy AND cy + p2.sh - 1)""")
def sample_windows(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("z", F.explode(F.array(*[F.lit(z).cast("bigint") for z in (6, 8, 10)])))
    tiles = p.withColumns({"x": C.tile_x("lon", "z"), "y": C.tile_y("lat", "z")}).groupBy(KEY).agg(F.count(F.lit(1)).alias("size"))
    return reports.sample_tiles(tiles, 0.02)


@query("SELECT z, x, y, size FROM s WHERE z = 5 AND x BETWEEN 3 AND 8 AND y = 10")
def select_tiles(spark, sf_dir):
    return reports.select_tiles(sized(spark, sf_dir, 5), "5/3-8/10").select(*KEY, "size")


@query("""SELECT size AS median, CAST(greatest(0, least(14, round(log2(4 * 2 * pi() * 6378137.0 / (size * 4096))))) AS BIGINT) AS zoom
FROM (SELECT CAST(l_quantity * 10 AS BIGINT) AS size, row_number() OVER (ORDER BY l_quantity) - 1 AS i, count(*) OVER () AS n FROM lineitem) WHERE i = n // 2""")
def auto_max_zoom(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 10).cast("bigint").alias("size"))
    return reports.auto_max_zoom(sizes, C.WORLD)


@query(""", e AS (SELECT y * 64 + x AS id, size % 3 AS hash FROM s WHERE z = 6), n AS (
SELECT id, hash, CASE WHEN lag(id) OVER w = id - 1 AND lag(hash) OVER w = hash THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (ORDER BY id)),
g AS (SELECT id, hash, sum(fresh) OVER (ORDER BY id) AS run FROM n) SELECT min(id) AS first, count(*) AS run, any_value(hash) AS hash FROM g GROUP BY g.run""")
def run_merge(spark, sf_dir):
    return reports.merge_runs(sized(spark, sf_dir, 6).select((F.col("y") * 64 + F.col("x")).alias("id"), (F.col("size") % 3).alias("hash")))


@query("SELECT size, min(y * 64 + x) AS first_id, count(*) AS uses FROM s WHERE z = 6 GROUP BY size")
def dedup_blobs(spark, sf_dir):
    return reports.dedup_blobs(sized(spark, sf_dir, 6).withColumn("id", F.col("y") * 64 + F.col("x")), "size")


@query(""", r AS (SELECT o_orderkey * 1000 + o_orderkey // 3 * 1500 AS "offset", o_custkey AS length FROM orders), n AS (
SELECT *, CASE WHEN "offset" - max("offset" + length) OVER (ORDER BY "offset", length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 900 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT *, sum(fresh) OVER (ORDER BY "offset", length ROWS UNBOUNDED PRECEDING) AS chunk FROM n)
SELECT min("offset") AS "offset", max("offset" + length) - min("offset") AS length, count(*) AS ranges FROM g GROUP BY chunk""")
def coalesce_ranges(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 1000 + F.expr("o_orderkey div 3") * 1500).alias("offset"), F.col("o_custkey").alias("length"))
    return reports.coalesce_ranges(r, 900)


@query("""SELECT CAST(max(open) AS BIGINT) AS peak FROM (SELECT sum(d) OVER (ORDER BY t) AS open FROM (SELECT t, sum(d) AS d FROM (
SELECT o_orderkey AS t, 1 AS d FROM orders UNION ALL SELECT o_orderkey + o_custkey % 100 + 1, -1 FROM orders) GROUP BY t))""")
def peak_in_flight(spark, sf_dir):
    return reports.peak_in_flight(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 100).alias("stop")))


@query("""SELECT layer, value, uses, row_number() OVER (PARTITION BY layer ORDER BY uses, value) - 1 AS number FROM (
SELECT layer, value, count(*) AS uses FROM (SELECT layer, '"' || uid || '"' AS value FROM f UNION ALL SELECT layer, CAST(n AS VARCHAR) FROM f WHERE n IS NOT NULL UNION ALL SELECT layer, CASE WHEN big THEN 'true' ELSE 'false' END FROM f) GROUP BY ALL)""")
def value_dictionary(spark, sf_dir):
    return reports.value_dictionary(features(spark, sf_dir))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(v AS VARCHAR) WHEN 1 THEN '-' || event_id WHEN 2 THEN '0' || event_id WHEN 3 THEN event_id || '.5' WHEN 4 THEN 'true' WHEN 5 THEN '-0' WHEN 6 THEN '-0' || event_id ELSE event_type END AS text,
CASE event_id % 8 WHEN 0 THEN CASE WHEN v < 0 THEN 'Int' ELSE 'UInt' END WHEN 1 THEN 'Int' WHEN 3 THEN 'Double' WHEN 4 THEN 'Bool' WHEN 5 THEN 'Int' ELSE 'String' END AS kind FROM p""")
def parse_value(spark, sf_dir):
    i = F.col("event_id").cast("string")
    k = F.col("event_id") % 8
    text = F.when(k == 0, F.col("v").cast("string")).when(k == 1, F.concat(F.lit("-"), i)).when(k == 2, F.concat(F.lit("0"), i)).when(k == 3, F.concat(i, F.lit(".5"))).when(k == 4, "true").when(k == 5, "-0").when(k == 6, F.concat(F.lit("-0"), i)).otherwise(F.col("event_type"))
    return points(spark, sf_dir).select("event_id", text.alias("text")).select("event_id", "text", V.value_type("text").alias("kind"))


@query("SELECT event_id, CAST(greatest(1, ceil(length(bin(event_id * event_id)) / 7.0)) AS INTEGER) AS bytes FROM p")
def varint_length(spark, sf_dir):
    return points(spark, sf_dir).select("event_id", V.varint_length(F.col("event_id") * F.col("event_id")).alias("bytes"))


@query("""SELECT event_id, 'CRS3035RES1000mN' || (event_id * 1000) || 'E' || (user_id * 1000) AS inspire, '1kmN' || CASE WHEN event_id < 1000 THEN lpad(CAST(event_id AS VARCHAR), 4, '0') ELSE CAST(event_id AS VARCHAR) END AS geostat FROM p""")
def grid_ids(spark, sf_dir):
    p = points(spark, sf_dir)
    fields = {"epsg": F.lit("3035"), "size": F.lit("1000"), "size_km": F.lit("1km"), "y": F.col("event_id") * 1000, "x": F.col("user_id") * 1000}
    return p.select("event_id", V.format_template(V.ID_PRESETS["inspire"], fields).alias("inspire"), V.format_template("{size_km}N{y/1000:04}", fields).alias("geostat"))


# EPSG:3035 by its definition: GRS 1980, centre 52 N 10 E, false easting 4321000 and northing 3210000.
_LAEA_SQL = """, g AS (SELECT 6378137.0::DOUBLE AS a, sqrt(f * (2 - f)) AS e, f * (2 - f) AS e2 FROM (SELECT 1 / 298.257222101::DOUBLE AS f)),
q AS (SELECT *, (1 - e2) * (1 / (1 - e2) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp, (1 - e2) * (sin(radians(52)) / (1 - e2 * pow(sin(radians(52)), 2)) - ln((1 - e * sin(radians(52))) / (1 + e * sin(radians(52)))) / (2 * e)) AS q0 FROM g),
h AS (SELECT *, asin(q0 / qp) AS b0, a * sqrt(qp / 2) AS rq FROM q),
i AS (SELECT *, a * cos(radians(52)) / (sqrt(1 - e2 * pow(sin(radians(52)), 2)) * rq * cos(b0)) AS d FROM h),
u AS (SELECT event_id, 15 + lon / 7.2::DOUBLE AS lon, 51 + lat / 4.0::DOUBLE AS lat FROM p),
v AS (SELECT u.event_id, i.*, radians(lon - 10) AS turn, asin((1 - e2) * (sin(radians(lat)) / (1 - e2 * pow(sin(radians(lat)), 2)) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) / qp) AS beta FROM u, i),
w AS (SELECT *, rq * sqrt(2 / (1 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(turn))) AS b FROM v)
SELECT event_id, round(b * d * cos(beta) * sin(turn) + 4321000, 2) AS east, round(b / d * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(turn)) + 3210000, 2) AS north FROM w"""


@query(_LAEA_SQL)
def laea_points(spark, sf_dir):
    p = points(spark, sf_dir).select("event_id", (15 + F.col("lon") / 7.2).alias("lon"), (51 + F.col("lat") / 4.0).alias("lat"))
    east, north = C.laea_forward("lon", "lat")
    return p.select("event_id", F.round(east, 2).alias("east"), F.round(north, 2).alias("north"))


def _grid_events(spark, sf_dir, epsg: int, size: float) -> DataFrame:
    """Events by the cell of a grid in which they lie."""
    p = points(spark, sf_dir)
    if epsg == 3035:
        p = p.select((15 + F.col("lon") / 7.2).alias("lon"), (51 + F.col("lat") / 4.0).alias("lat"))
    x, y = C.laea_forward("lon", "lat") if epsg == 3035 else (F.col("lon"), F.col("lat")) if epsg == 4326 else (C.mercator_x("lon"), C.mercator_y("lat"))
    cell = [F.floor(v / size).cast("bigint").alias(c) for v, c in ((x, "cx"), (y, "cy"))]
    return p.groupBy(*cell).agg(F.count(F.lit(1)).alias("events"))


def _grid_query(spark, sf_dir, epsg: int, size: float, bbox: tuple) -> DataFrame:
    cells = sources.grid_cells(spark, epsg, size, bbox).select("id_text", "cx", "cy", F.col("west").cast("double").alias("west"), F.col("north").cast("double").alias("north"))
    return cells.join(_grid_events(spark, sf_dir, epsg, size), ["cx", "cy"], "left").withColumn("events", F.coalesce("events", F.lit(0)).cast("bigint"))


_GRID_EVENTS_SQL = {
    3035: _LAEA_SQL.replace("round(b * d * cos(beta) * sin(turn) + 4321000, 2) AS east, round(b / d * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(turn)) + 3210000, 2) AS north", "b * d * cos(beta) * sin(turn) + 4321000 AS gx, b / d * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(turn)) + 3210000 AS gy").replace("SELECT event_id, b * d", "SELECT b * d"),
    3857: " SELECT lon * pi() / 180 * 6378137.0 AS gx, 6378137.0 * ln(tan(lat * pi() / 360 + pi() / 4)) AS gy FROM p",
    4326: " SELECT lon AS gx, lat AS gy FROM p",
}
for _name, _epsg, _size, _bbox in (("grid_cells_3035", 3035, 50_000, (4_000_000, 2_990_000, 4_600_000, 3_500_000)), ("grid_cells_3857", 3857, 250_000, (-1_000_000, 0, 2_000_001, 3_000_000)), ("grid_cells_4326", 4326, 5, (-10, 30, 41, 60))):
    QUERIES[_name] = lambda spark, sf_dir, a=(_epsg, _size, _bbox): _grid_query(spark, sf_dir, *a)
    _x, _y = (f"range(CAST(floor({_bbox[i]} / {_size}.0) AS BIGINT), CAST(ceil({_bbox[i + 2]} / {_size}.0) AS BIGINT))" for i in (0, 1))
    ORACLE_SQL[_name] = f"""SELECT 'CRS{_epsg}RES{_size}mN' || (cy * {_size}) || 'E' || (cx * {_size}) AS id_text, cx, cy, CAST(cx * {_size} AS DOUBLE) AS west, CAST((cy + 1) * {_size} AS DOUBLE) AS north, coalesce(events, 0) AS events
FROM (SELECT * FROM (SELECT CAST(range AS BIGINT) AS cx FROM {_x}), (SELECT CAST(range AS BIGINT) AS cy FROM {_y})) LEFT JOIN (
SELECT CAST(floor(gx / {_size}) AS BIGINT) AS cx, CAST(floor(gy / {_size}) AS BIGINT) AS cy, count(*) AS events FROM ({_PRELUDE}{_GRID_EVENTS_SQL[_epsg]}) GROUP BY ALL) USING (cx, cy)"""


# --- blobs: some have no SQL and are tested in tests/test_engine.py -------------------------------------------------


def _with_events(spark, sf_dir, tiles_: DataFrame, deepest: int) -> DataFrame:
    """The tiles, of levels up to one, in which events lie."""
    p = points(spark, sf_dir).withColumn("z", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(deepest).cast("bigint"))))
    return general.filter_tiles(tiles_, mask=p.select("z", C.tile_x("lon", "z").alias("x"), C.tile_y("lat", "z").alias("y")).distinct())


def _with_events_sql(sql: str) -> str:
    return f"SELECT q.* FROM ({sql}) AS q WHERE EXISTS (SELECT 1 FROM s WHERE s.z = q.z AND s.x = q.x AND s.y = q.y)"


def _point_features(spark, sf_dir, z: int = 3) -> DataFrame:
    f = features(spark, sf_dir, z)
    at = lambda a: (F.col("id") * a % 4096).cast("bigint")
    return f.select(*KEY, "layer", "feat_no", "id", F.lit(1).alias("kind"), F.array(F.array(F.array(at(31), at(57)))).alias("parts"), "props")


@query(f"SELECT {_FLAT} FROM f")
def mvt_roundtrip(spark, sf_dir):
    return flat(tiles.decode(tiles.encode(_point_features(spark, sf_dir, 4))))


@query(f"SELECT {_FLAT}, CAST(512 AS INTEGER) AS extent, CAST(1 AS INTEGER) AS version, id * 31 % 512 AS px FROM f")
def mvt_roundtrip_extent(spark, sf_dir):
    """Extent and version of a layer outlive decoding and encoding."""
    f = _point_features(spark, sf_dir, 4).withColumn("parts", F.transform("parts", lambda part: F.transform(part, lambda p: F.transform(p, lambda v: v % 512))))
    once = tiles.decode(tiles.encode(f, extent=512, version=1))
    out = tiles.decode(tiles.encode(vector.filter_properties(once, "/nothing$")))
    rest = out.select("z", "x", "y", "layer", "id", "extent", "version", F.col("parts")[0][0][0].alias("px"))
    return flat(out).join(rest, ["z", "x", "y", "layer", "id"])


@query("""SELECT z, x, y, CASE WHEN event_id % 3 = 0 THEN 'UnknownGeometryType' ELSE 'EmptyGeometryForType' END AS issue, layer, CAST(feature AS INTEGER) AS feature FROM (
SELECT z, x, y, event_id, event_type AS layer, row_number() OVER (PARTITION BY x, y, event_type ORDER BY event_id) - 1 AS feature FROM t WHERE z = 3) WHERE event_id % 3 <> 1""")
def mvt_validate(spark, sf_dir):
    """Of every three features one is of unknown kind, one is a sound point, and one is a line of one vertex."""
    return tiles.validate(tiles.encode(_point_features(spark, sf_dir).withColumn("kind", (F.col("id") % 3).cast("int"))))


@query("""SELECT z + d AS z, x * CAST(pow(2, d) AS BIGINT) + i AS x, y * CAST(pow(2, d) AS BIGINT) + j AS y, layer, id
FROM (SELECT z, x, y, event_type AS layer, event_id AS id, event_id * 31 % 4096 AS px, event_id * 57 % 4096 AS py FROM t WHERE z = 3),
(SELECT CAST(range AS BIGINT) AS d FROM range(0, 3)), (SELECT CAST(range AS BIGINT) AS i FROM range(0, 4)), (SELECT CAST(range AS BIGINT) AS j FROM range(0, 4))
WHERE i < pow(2, d) AND j < pow(2, d) AND (d = 0 OR px * pow(2, d) BETWEEN i * 4096 - 80 AND (i + 1) * 4096 + 80 AND py * pow(2, d) BETWEEN j * 4096 - 80 AND (j + 1) * 4096 + 80)""")
def mvt_overzoom(spark, sf_dir):
    return tiles.overzoom(_point_features(spark, sf_dir), 3, 5).select(*KEY, "layer", "id")


def min_distance(spark, sf_dir):
    p = points(spark, sf_dir).select("event_id", "event_type", C.mercator_x("lon").alias("mx"), C.mercator_y("lat").alias("my"))
    return tiles.thin_min_distance(p, 500_000.0, "event_type", "event_id").select("event_id", "event_type", F.round("mx", 2).alias("mx"), F.round("my", 2).alias("my"))


QUERIES["min_distance"] = min_distance
ORACLE_SQL["min_distance"] = """WITH RECURSIVE o AS (
  SELECT event_id, event_type, lon * pi() / 180 * 6378137.0 AS mx, 6378137.0 * ln(tan(lat * pi() / 360 + pi() / 4)) AS my, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn
  FROM (SELECT event_id, event_type, -180.0::DOUBLE + 360.0::DOUBLE * ((event_id * 7919) % 100003) / 100003.0::DOUBLE AS lon, -85.0::DOUBLE + 170.0::DOUBLE * ((event_id * 104729) % 99991) / 99991.0::DOUBLE AS lat FROM events)
), r AS (
  SELECT event_id, event_type, mx, my, rn, [{'a': mx, 'b': my}] AS held, TRUE AS free FROM o WHERE rn = 1
  UNION ALL
  SELECT event_id, event_type, mx, my, rn, CASE WHEN free THEN list_append(held, {'a': mx, 'b': my}) ELSE held END, free FROM (
    SELECT o.*, r.held, len(list_filter(r.held, lambda k: pow(k.a - o.mx, 2) + pow(k.b - o.my, 2) < 500000.0 * 500000.0)) = 0 AS free FROM r JOIN o ON o.event_type = r.event_type AND o.rn = r.rn + 1)
)
SELECT event_id, event_type, round(mx, 2) AS mx, round(my, 2) AS my FROM r WHERE free"""


@query()
def draw_cells(spark, sf_dir):
    from tesselon.plans.vpl import run_vpl

    made = run_vpl(spark, "from_grid epsg=4326 size=5 bbox=[0, 40, 30, 60] max_zoom=5 | filter level_min=3").tiles
    return _with_events(spark, sf_dir, made, 5).select(*KEY, F.length("data").alias("size"))


@query(_with_events_sql("""SELECT z, x, y, color AS first, color AS last FROM (
SELECT z, CAST(a.range AS BIGINT) AS x, CAST(b.range AS BIGINT) AS y, printf('%02x%02x%02xff', CAST(round(255 * pow(red / 255.0, 1.2)) AS INTEGER), CAST(round(255 * pow(green / 255.0, 1.2)) AS INTEGER), CAST(round(255 * pow(blue / 255.0, 1.2)) AS INTEGER)) AS color
FROM (SELECT CAST(range AS BIGINT) AS z, CASE WHEN range <= 2 THEN 128 ELSE 255 END AS red, CASE WHEN range <= 2 THEN 0 ELSE 255 - 128 END AS green, 255 - 128 AS blue FROM range(0, 4)) AS l,
range(0, 8) AS a, range(0, 8) AS b WHERE a.range < pow(2, z) AND b.range < pow(2, z))"""))
def alpha_blend(spark, sf_dir):
    """Red of opacity 128 in front of blue, which ends at level 2; below that, of white."""
    from tesselon.operators.raster import corner_colors
    from tesselon.plans.vpl import run_vpl

    out = run_vpl(spark, "from_stacked_raster [from_color color=ff000080 size=16 level_max=3, from_color color=0000ff size=16 level_max=2] | raster_flatten | raster_levels gamma=1.2")
    return corner_colors(_with_events(spark, sf_dir, out.tiles, 3))


@query(_with_events_sql("""SELECT z, CAST(a.range AS BIGINT) AS x, CAST(b.range AS BIGINT) AS y, '336699ff' AS first, '336699ff' AS last FROM (SELECT CAST(range AS BIGINT) AS z FROM range(2, 6)) AS l, range(0, 32) AS a, range(0, 32) AS b
WHERE a.range >> (z - 2) IN (1, 2) AND b.range >> (z - 2) IN (1, 2)"""))
def raster_mask(spark, sf_dir):
    """A mask that ends at tile borders keeps the tiles within it."""
    from tesselon.operators import raster
    from tesselon.plans.vpl import run_vpl

    edge = C.WORLD / 4
    square = [(-edge, -edge), (edge, -edge), (edge, edge), (-edge, edge), (-edge, -edge)]
    kept = raster.mask(run_vpl(spark, "from_color color=336699 size=16 level_max=5 | filter level_min=2").tiles, [square])
    return raster.corner_colors(_with_events(spark, sf_dir, kept, 5))


@query(_with_events_sql("""SELECT z, CAST(a.range AS BIGINT) AS x, CAST(b.range AS BIGINT) AS y, '336699ff' AS first, '336699ff' AS last FROM (SELECT CAST(range AS BIGINT) AS z FROM range(0, 4)) AS l, range(0, 8) AS a, range(0, 8) AS b
WHERE a.range < pow(2, z) AND b.range < pow(2, z)"""))
def raster_pyramid(spark, sf_dir):
    from tesselon.operators.raster import corner_colors
    from tesselon.plans.vpl import run_vpl

    made = run_vpl(spark, "from_color color=336699 size=16 level_max=3 | filter level_min=3 | raster_overview level=3").tiles
    return corner_colors(_with_events(spark, sf_dir, made, 3))


@query(_with_events_sql("""SELECT z, x, CAST(pow(2, z) AS BIGINT) - 1 - y AS y, layer, unnest(string_split(digits, '')) AS char FROM (
SELECT z, x, y, 'debug_' || axis AS layer, CAST(CASE axis WHEN 'x' THEN x ELSE y END AS VARCHAR) AS digits FROM (
SELECT z, CAST(a.range AS BIGINT) AS x, CAST(b.range AS BIGINT) AS y FROM (SELECT CAST(range AS BIGINT) AS z FROM range(0, 4)) AS l, range(0, 8) AS a, range(0, 8) AS b WHERE a.range < pow(2, z) AND b.range < pow(2, z)),
(SELECT unnest(['x', 'y']) AS axis))"""))
def debug_pipeline(spark, sf_dir):
    from tesselon.plans.vpl import run_vpl

    out = run_vpl(spark, "from_debug level_max=3 | vector_filter_layers filter=[debug_z] | vector_filter_properties regex='/index$' | remap_coords flip_y=true")
    return _with_events(spark, sf_dir, out.features, 3).select(*KEY, "layer", vector.plain(F.try_element_at("props", F.lit("char"))).alias("char"))


_VARINT = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 ELSE 4 END"


@query(f"""SELECT z, layer, count(DISTINCT x * 1000 + y) AS tiles, count(*) AS features, count(*) AS vertices,
CAST(sum(1 + {_VARINT.format("2 * px")} + {_VARINT.format("2 * py")}) AS BIGINT) AS geometry, CAST(sum({_VARINT.format("id")}) AS BIGINT) AS ids
FROM (SELECT z, x, y, event_type AS layer, event_id AS id, event_id * 31 % 4096 AS px, event_id * 57 % 4096 AS py FROM t WHERE z = 3) GROUP BY z, layer""")
def layer_bytes(spark, sf_dir):
    return tiles.layer_bytes(tiles.encode(_point_features(spark, sf_dir))).select("z", "layer", "tiles", "features", "vertices", "geometry", "ids")


def _deeper_sql(source: str) -> str:
    return f"""SELECT z + 1 AS z, x * 2 + i AS x, y * 2 + j AS y, layer, id, px * 2 - i * 4096 AS px, py * 2 - j * 4096 AS py
FROM {source}, (SELECT CAST(range AS BIGINT) AS i FROM range(0, 2)), (SELECT CAST(range AS BIGINT) AS j FROM range(0, 2))
WHERE px * 2 BETWEEN i * 4096 - 80 AND (i + 1) * 4096 + 80 AND py * 2 BETWEEN j * 4096 - 80 AND (j + 1) * 4096 + 80"""


@query(f""", a AS (SELECT z, x, y, event_type AS layer, event_id AS id, event_id * 31 % 4096 AS px, event_id * 57 % 4096 AS py FROM t),
low AS (SELECT * FROM a WHERE z = 2), own AS (SELECT * FROM a WHERE z = 3 AND x % 2 = 0),
base AS (SELECT * FROM own UNION ALL SELECT * FROM ({_deeper_sql("low")}) AS c WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.x = c.x AND own.y = c.y))
SELECT z, x, y, layer, id FROM low UNION ALL SELECT z, x, y, layer, id FROM base UNION ALL SELECT z, x, y, layer, id FROM ({_deeper_sql("base")})""")
def overzoom_climbing(spark, sf_dir):
    f = _point_features(spark, sf_dir, 2).unionByName(_point_features(spark, sf_dir, 3).where("x % 2 = 0"))
    return tiles.overzoom_climbing(f, 3, 4).select(*KEY, "layer", "id")


@query("""SELECT event_id FROM (SELECT event_id, xor(b, b // 2147483648::UHUGEINT) AS h FROM (
SELECT event_id, (xor(a, a // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS b FROM (
SELECT event_id, (xor(x, x // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS a FROM (SELECT event_id, event_id::UHUGEINT AS x FROM p))))
WHERE h // 2048 < CAST(floor(0.3::DOUBLE * 9007199254740992) + 1 AS UHUGEINT)""")
def drop_rate(spark, sf_dir):
    return tiles.drop_rate(points(spark, sf_dir).select("event_id"), 0.3, "event_id")


@query("""SELECT layer, field, CASE WHEN field IN ('uid', 'kind', 'nothing') THEN 'String' WHEN field = 'n' THEN 'Number' END AS type, min(least(low, 3)) AS minzoom, max(greatest(high, 3)) AS maxzoom FROM (
SELECT layer, min(z) OVER (PARTITION BY layer) AS low, max(z) OVER (PARTITION BY layer) AS high, unnest(CASE WHEN layer = 'view' THEN [NULL] WHEN layer = 'click' THEN ['nothing'] ELSE ['uid', 'kind', 'nothing', 'n'] END) AS field FROM
(SELECT event_type AS layer, z FROM t WHERE z = 3 OR z = 5 AND event_type <> 'signup')) GROUP BY layer, field""")
def vector_layers(spark, sf_dir):
    """Layers of two levels: one without fields, one whose only field is null, one that ends at the upper level."""
    f = features(spark, sf_dir, 3).unionByName(features(spark, sf_dir, 5).where("layer <> 'signup'"))
    kind = F.when(F.col("id") % 2 == 0, "true").otherwise('"a"')
    more = F.create_map(F.lit("uid"), F.lit('"u"'), F.lit("kind"), kind, F.lit("nothing"), F.lit("null"), F.lit("n"), F.when(F.col("id") % 3 == 0, "null").otherwise("1.5"))
    props = F.when(F.col("layer") == "view", F.expr("map()").cast("map<string,string>")).when(F.col("layer") == "click", F.create_map(F.lit("nothing"), F.lit("null"))).otherwise(more)
    return vector.field_types(f.withColumn("props", props), "conflict")


import tesselon.queries_shapes  # noqa: E402,F401  registers the queries of shapes, thinning and chunks
