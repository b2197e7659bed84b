"""Reports over tilesets: counts, sizes, samples, layer statistics, directories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.operators.stored import BROADCAST_BYTES

KEY = ["z", "x", "y"]
M64 = (1 << 64) - 1
#: Tiles along a side of a sample's windows.
WINDOW = 64


def count_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles by level, and a row with level null for all."""
    return tiles.rollup("z").agg(F.count(F.lit(1)).alias("tiles"))


def size_stats(tiles: DataFrame) -> DataFrame:
    """By level: tiles, bytes and the whole average of the sizes."""
    out = tiles.groupBy("z").agg(F.count(F.lit(1)).alias("tiles"), F.sum("size").cast("bigint").alias("bytes"))
    return out.withColumn("average", F.floor(F.col("bytes") / F.col("tiles")).cast("bigint"))


def biggest_tiles(tiles: DataFrame, n: int = 10) -> DataFrame:
    return tiles.orderBy(F.desc("size"), *KEY).limit(n).select(*KEY, "size")


def within_cap(tiles: DataFrame, cap: int | None = 1 << 20) -> DataFrame:
    return tiles if cap is None else tiles.where(F.col("size") <= cap)


def layer_stats(features: DataFrame) -> DataFrame:
    """By level and layer: tiles and features, and bytes of geometry where there is some; largest layers first."""
    sizes = [F.sum(F.length("geom")).cast("bigint").alias("geometry_bytes")] if "geom" in features.columns else []
    out = features.groupBy("z", "layer").agg(F.countDistinct("x", "y").alias("tiles"), F.count(F.lit(1)).alias("features"), *sizes)
    return out.orderBy("z", F.desc("features"), "layer")


def schema_violations(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Breaches of rules (layer, attribute, type, required, minzoom) with the number of features concerned.

    Rules may have enum, the allowed texts of a value (null: any); a breach of it has the problem enum. A rule
    table has one row for each attribute of a schema; Spark broadcasts it if it is as small as that."""
    rule = rules.withColumnRenamed("layer", "_layer").withColumnRenamed("type", "wanted")
    rule = rule if "enum" in rule.columns else rule.withColumn("enum", F.lit(None).cast("array<string>"))
    joined = features.select("layer", "z", "props").join(rule, F.col("layer") == F.col("_layer"))
    value = F.nullif(F.try_element_at("props", F.col("attribute")), F.lit("null"))
    kind = F.when(value.isin("true", "false"), "Boolean").when(value.startswith('"'), "String").otherwise("Number")
    text = F.when(value.startswith('"'), F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]).otherwise(value)
    problem = F.when(value.isNull() & F.col("required"), "missing").when(value.isNotNull() & (kind != F.col("wanted")), "type")
    problem = problem.when(value.isNotNull() & F.col("enum").isNotNull() & ~F.array_contains("enum", text), "enum").when(F.col("z") < F.col("minzoom"), "zoom")
    return joined.select("layer", "attribute", problem.alias("problem")).where("problem IS NOT NULL").groupBy("layer", "attribute", "problem").agg(F.count(F.lit(1)).alias("features"))


#: Severities, least first, and the rules with theirs. An enum may have its own.
SEVERITIES = ("hint", "warn", "error")
RULES = {
    "unknown_layer": "warn",
    "below_minzoom": "warn",
    "wrong_geometry": "error",
    "missing_required": "error",
    "unknown_attribute": "warn",
    "wrong_type": "error",
    "bad_enum_value": "warn",
}


def schema_issues(features: DataFrame, layers: DataFrame, attributes: DataFrame, least: str = "hint") -> DataFrame:
    """Findings of a schema check: (severity, rule, layer, attribute, occurrences, first_z, first_x, first_y).

    layers has (layer, minzoom) and may have geometry; attributes has (layer, attribute, type, required) and may have
    enum, the allowed texts (null: any), and enum_severity (null: warn). An unknown layer and a level below minzoom count once a
    tile; the others once a feature or property. Geometries are checked if features have geometry too, not where either
    is null. Names and their translations (name, name_de, name:de) are never unknown attributes; null properties are
    missing ones. first_* is the smallest tile with the finding. Findings under ``least`` are left out. Layers and attributes
    are tables of one row for each of a schema's; no features give no rows.

    One pass builds each feature's findings inside its row; only their counts by tile are shuffled."""
    if least not in SEVERITIES:
        raise ValueError(f"severity is one of {', '.join(SEVERITIES)}: {least}")
    optional = lambda df, name, kind: df[name] if name in df.columns else F.lit(None).cast(kind)
    known = layers.select("layer", F.lit(True).alias("_known"), F.col("minzoom").alias("_minzoom"), optional(layers, "geometry", "string").alias("_wanted"))
    rule = F.struct("type", F.coalesce("required", F.lit(False)).alias("required"), optional(attributes, "enum", "array<string>").alias("enum"), F.coalesce(optional(attributes, "enum_severity", "string"), F.lit(RULES["bad_enum_value"])).alias("severity"))
    rules = attributes.groupBy("layer").agg(F.map_from_entries(F.collect_list(F.struct("attribute", rule.alias("rule")))).alias("_rules"))
    rows = features.select(*KEY, "layer", "props", optional(features, "geometry", "string").alias("_geometry"))
    rows = rows.join(known, "layer", "left").join(rules, "layer", "left")
    nothing = F.create_map().cast("map<string,struct<type:string,required:boolean,enum:array<string>,severity:string>>")
    rows = rows.withColumns({"_rules": F.coalesce("_rules", nothing), "_props": F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull() & (v != "null"))})

    def finding(name: str, attribute: Column | None = None, severity: Column | None = None) -> Column:
        return F.struct((F.lit(RULES[name]) if severity is None else severity).alias("severity"), F.lit(name).alias("rule"), (F.lit(None).cast("string") if attribute is None else attribute).alias("attribute"))

    def of_property(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        wanted = F.try_element_at("_rules", key)
        quoted = value.startswith('"')
        kind = F.when(quoted, "String").when(value.isin("true", "false"), "Boolean").otherwise("Number")
        text = F.when(quoted, F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)
        named = (key == "name") | key.startswith("name_") | key.startswith("name:")
        known_key = F.when(wanted["type"] != kind, finding("wrong_type", key)).when(~F.array_contains(wanted["enum"], text), finding("bad_enum_value", key, wanted["severity"]))
        return F.when(wanted.isNull(), F.when(~named, finding("unknown_attribute", key))).otherwise(known_key)

    missing = F.filter(F.map_entries("_rules"), lambda e: e["value"]["required"] & ~F.map_contains_key("_props", e["key"]))
    once = F.array(F.when(F.col("_known").isNull(), finding("unknown_layer")), F.when(F.col("z") < F.col("_minzoom"), finding("below_minzoom")))
    each = F.concat(
        F.array(F.when(F.col("_geometry") != F.col("_wanted"), finding("wrong_geometry"))),
        F.transform(missing, lambda e: finding("missing_required", e["key"])),
        F.transform(F.map_entries("_props"), of_property),
    )
    # Of an unknown layer nothing else is said.
    found = F.array_compact(F.concat(once, F.when(F.col("_known"), each).otherwise(F.filter(each, lambda _: F.lit(False)))))
    issues = rows.select(*KEY, "layer", F.explode(found).alias("i")).select(*KEY, "layer", "i.*")
    issues = issues.where(F.col("severity").isin(*SEVERITIES[SEVERITIES.index(least) :]))
    what = ["severity", "rule", "layer", "attribute"]
    by_tile = issues.groupBy(*KEY, *what).agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("rule").isin("unknown_layer", "below_minzoom"), 1).otherwise(F.col("n"))
    out = by_tile.groupBy(what).agg(F.sum(n).cast("bigint").alias("occurrences"), F.min(F.struct(*KEY)).alias("_first"))
    return out.select(*what, "occurrences", *[F.col(f"_first.{c}").alias(f"first_{c}") for c in KEY])


def failing(issues: DataFrame, fail_on: str = "error") -> int:
    """Occurrences of findings that are as severe as ``fail_on`` or more: a check fails if there are any."""
    if fail_on not in SEVERITIES:
        raise ValueError(f"severity is one of {', '.join(SEVERITIES)}: {fail_on}")
    row = issues.where(F.col("severity").isin(*SEVERITIES[SEVERITIES.index(fail_on) :])).agg(F.sum("occurrences")).first()
    return row[0] or 0


def size_raster(tiles: DataFrame, scale: int) -> DataFrame:
    """Cells of scale x scale tiles: ten times the binary logarithm of the mean size, absent tiles 0 bytes, in a byte.

    Logarithms of whole powers come out a little off in some libraries, so the level is set right by the powers."""
    cell = [F.floor(F.col(c) / scale).cast("bigint").alias(c) for c in ("x", "y")]
    means = tiles.groupBy("z", *cell).agg(F.greatest(F.sum("size") / float(scale * scale), F.lit(1.0)).alias("mean"))
    near = F.floor(10 * F.log2("mean") + 0.5)
    level = F.when(F.pow(F.lit(2.0), near / 10) <= F.col("mean"), near).otherwise(near - 1)
    return means.select("z", "x", "y", F.least(level, F.lit(255)).cast("bigint").alias("level"))


# --- sampling ------------------------------------------------------------------------------------


def splitmix64(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def windows_for_sample(fraction: float, deepest: int, window: int = WINDOW) -> int:
    """Windows of a level that hold about a fraction of the largest level's tiles; one at least."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction is above 0 and 1 at most")
    return max(1, -(-math.ceil(fraction * deepest) // (window * window)))


def plan_windows(level: int, box: tuple[int, int, int, int], count: int, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Hash-placed square windows within the covered box of a level, or the whole box if they would cover it."""
    x0, y0, x1, y1 = box
    columns, rows = x1 - x0 + 1, y1 - y0 + 1
    width, height = min(window, columns), min(window, rows)
    if count * width * height >= columns * rows:
        return [box]
    corners: set[tuple[int, int]] = set()
    for i in range(8 * count):
        if len(corners) == count:
            break
        seed = level << 40 ^ i << 1
        corners.add((x0 + splitmix64(seed) % (columns - width + 1), y0 + splitmix64(seed ^ 1) % (rows - height + 1)))
    return [(x, y, x + width - 1, y + height - 1) for x, y in sorted(corners)]


def sample_tiles(tiles: DataFrame, fraction: float, window: int = WINDOW) -> DataFrame:
    """Tiles in the windows of each level's sample; what a level covers is found by an aggregation, one row a level.

    Windows are a table, four rows each at most, with which tiles are joined by blocks of a window's size; a level whose
    windows would cover it stays whole."""
    boxes = [tuple(r) for r in tiles.groupBy("z").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).collect()]
    deepest = max(((x1 - x0 + 1) * (y1 - y0 + 1) for _, x0, y0, x1, y1 in boxes), default=0)
    plans = {level: plan_windows(level, tuple(box), windows_for_sample(fraction, deepest, window), window) for level, *box in boxes}
    whole = [level for level, *box in boxes if plans[level] == [tuple(box)]]
    rows = [(level, *w) for level, plan in plans.items() if level not in whole for w in plan]
    kept = tiles.where(F.col("z").isin(whole))
    if not rows:
        return kept
    dealt = tiles.sparkSession.createDataFrame(rows, "wz bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    for c in ("x", "y"):
        dealt = dealt.withColumn(f"b{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / window), F.floor(F.col(f"{c}1") / window))))
    dealt = F.broadcast(dealt) if len(rows) * 4 * 56 <= BROADCAST_BYTES else dealt
    within = (tiles["z"] == dealt["wz"]) & tiles["x"].between(dealt["x0"], dealt["x1"]) & tiles["y"].between(dealt["y0"], dealt["y1"])
    for c in ("x", "y"):
        within &= F.floor(tiles[c] / window) == dealt[f"b{c}"]
    return kept.unionByName(tiles.where(~F.col("z").isin(whole)).join(dealt, within, "left_semi"))


def select_tiles(tiles: DataFrame, selector: str, most: int = 64) -> DataFrame:
    """Tiles of a selector such as 4/3-5/7."""
    z, x, y = selector.split("/")
    spans = [tuple(int(v) for v in (s.split("-") * 2)[:2]) for s in (x, y)]
    if (spans[0][1] - spans[0][0] + 1) * (spans[1][1] - spans[1][0] + 1) > most:
        raise ValueError(f"a selector may name {most} tiles at most")
    return tiles.where((F.col("z") == int(z)) & F.col("x").between(*spans[0]) & F.col("y").between(*spans[1]))


def auto_max_zoom(sizes: DataFrame, world: float, extent: int = 4096) -> DataFrame:
    """One row: the level at which a feature of the upper median size (column size, points 0) spans four units."""
    order = Window.orderBy("size")
    # Sizes of features that are broken are left out by the caller; counting them needs one pass.
    ranked = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.withColumn("last", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    middle = ranked.where((F.col("last") - F.col("n") <= F.floor(F.col("total") / 2)) & (F.floor(F.col("total") / 2) < F.col("last")))
    level = F.when(F.col("size") <= 0, 14).otherwise(F.greatest(F.lit(0), F.least(F.lit(14), F.round(F.log2(F.lit(4.0 * world) / (F.col("size") * extent))).cast("int"))))
    return middle.select(F.col("size").alias("median"), level.cast("bigint").alias("zoom"))


# --- directories ---------------------------------------------------------------------------------


def merge_runs(entries: DataFrame, partition: list[str] | None = None, span: int = 1 << 20) -> DataFrame:
    """Entries (id, hash) in runs of consecutive ids with equal content: (first, run, hash).

    Runs are found within parts of ``span`` ids; only those that touch a border, two a part at most, are then
    put together across borders, in one order for each partition."""
    keys = list(partition or [])

    def joined(rows: DataFrame, order, follows: Column) -> DataFrame:
        return rows.withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))

    within = Window.partitionBy(*keys, "_part").orderBy("id")
    follows = (F.lag("id").over(within) == F.col("id") - 1) & (F.lag("hash").over(within) == F.col("hash"))
    runs = joined(entries.withColumn("_part", F.floor(F.col("id") / span)), within, follows)
    runs = runs.groupBy(*keys, "_part", "_run").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("run"), F.first("hash").alias("hash"))
    at_border = (F.col("first") == F.col("_part") * span) | (F.col("first") + F.col("run") == (F.col("_part") + 1) * span)
    across = Window.partitionBy(*keys).orderBy("first")
    follows = (F.lag(F.col("first") + F.col("run")).over(across) == F.col("first")) & (F.lag("hash").over(across) == F.col("hash"))
    border = joined(runs.where(at_border).drop("_run"), across, follows).groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.sum("run").alias("run"), F.min_by("hash", "first").alias("hash"))
    names = [*keys, "first", "run", "hash"]
    return runs.where(~at_border).select(names).unionByName(border.select(names))


def find_in_runs(runs: DataFrame, ids: DataFrame, span: int = 1 << 20) -> DataFrame:
    """The rows of ``ids`` (id, ...) with the columns of the run (first, run, ...) that holds them, null where none does.

    An equi-join on parts of ``span`` ids, into which each run is dealt: no order over all rows is needed."""
    part = F.explode(F.sequence(F.floor(F.col("first") / span), F.floor((F.col("first") + F.col("run") - 1) / span)))
    dealt = runs.withColumn("_part", part)
    asked = ids.withColumn("_part", F.floor(F.col("id") / span))
    within = (F.col("id") >= F.col("first")) & (F.col("id") < F.col("first") + F.col("run"))
    return asked.join(dealt, (asked["_part"] == dealt["_part"]) & within, "left").drop("_part")


def dedup_blobs(tiles: DataFrame, content: str = "data") -> DataFrame:
    """Distinct contents with the smallest id that has them and their number of uses."""
    return tiles.groupBy(content).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("uses"))


def coalesce_ranges(ranges: DataFrame, gap: int = 256 * 1024, partition: list[str] | None = None, span: int = 1 << 30) -> DataFrame:
    """Byte ranges (offset, length) read together where less than ``gap`` bytes lie between them; ``chunks.read_chunks``
    limits their size besides.

    Ranges are ordered within parts of ``span`` bytes; what a part must know of those before it, the furthest end
    and the number of chunks, goes through one row for each part."""
    keys = list(partition or [])
    part = [*keys, "_part"]
    rows = ranges.withColumns({"_part": F.floor(F.col("offset") / span), "_stop": F.col("offset") + F.col("length")})
    within = Window.partitionBy(*part).orderBy("offset", "length")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda of, name, f: of.withColumn(name, f(name).over(earlier))
    reach = carried(rows.groupBy(*part).agg(F.max("_stop").alias("_reach")), "_reach", F.max)
    match = lambda a, b: [a[c].eqNullSafe(b[c]) for c in part]

    def with_parts(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        test = match(a, b)[0]
        for t in match(a, b)[1:]:
            test = test & t
        return a.join(b, test).select(a["*"], b[name])

    known = with_parts(rows, reach, "_reach")
    before = F.greatest(F.max("_stop").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    chunks = known.withColumn("_new", F.when(F.col("offset") - before < gap, 0).otherwise(1)).withColumn("_local", F.sum("_new").over(within))
    number = carried(chunks.groupBy(*part).agg(F.sum("_new").alias("_base")), "_base", F.sum)
    chunks = with_parts(chunks, number, "_base").withColumn("_chunk", F.col("_local") + F.coalesce("_base", F.lit(0)))
    return chunks.groupBy(*keys, "_chunk").agg(F.min("offset").alias("offset"), (F.max("_stop") - F.min("offset")).alias("length"), F.count(F.lit(1)).alias("ranges")).drop("_chunk")


def peak_in_flight(intervals: DataFrame, span: int = 1 << 20) -> DataFrame:
    """One row: the largest number of intervals (start, stop) open at once. Sums run within parts of ``span`` moments;
    across parts one row each is added up."""
    events = intervals.select(F.col("start").alias("t"), F.lit(1).alias("d")).union(intervals.select(F.col("stop") + 1, F.lit(-1)))
    steps = events.groupBy("t").agg(F.sum("d").alias("d")).withColumn("_part", F.floor(F.col("t") / span))
    open_ = steps.withColumn("open", F.sum("d").over(Window.partitionBy("_part").orderBy("t")))
    parts = open_.groupBy("_part").agg(F.max("open").alias("top"), F.sum("d").alias("d"))
    before = F.coalesce(F.sum("d").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select((F.col("top") + before).alias("open")).agg(F.max("open").cast("bigint").alias("peak"))


def value_dictionary(features: DataFrame) -> DataFrame:
    """Property values of each layer by frequency ascending, then value, numbered from 0."""
    each = features.select("layer", F.explode(F.map_values("props")).alias("value"))
    counted = each.groupBy("layer", "value").agg(F.count(F.lit(1)).alias("uses"))
    return counted.withColumn("number", (F.row_number().over(Window.partitionBy("layer").orderBy("uses", "value")) - 1).cast("bigint"))
