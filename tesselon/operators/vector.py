"""Operators on feature rows (z, x, y, layer, feat_no, id, props, …); props maps names to JSON literals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.values import value_type
from tesselon.operators.stored import BROADCAST_BYTES
from tesselon.plans.cel import compile_expression

#: What a row of a lookup table takes beside its texts, and a text beside its bytes.
ROW_BYTES, TEXT_BYTES = 64, 48


def literal(value: Column) -> Column:
    """A text as the JSON literal of the value that it stands for."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return F.when(value.isNull(), "null").when(value_type(value) == "String", quoted).otherwise(value)


def plain(json_literal: Column) -> Column:
    """The text of a JSON literal, without quotes."""
    return F.when(json_literal.startswith('"'), F.from_json(F.concat(F.lit("["), json_literal, F.lit("]")), "array<string>")[0]).otherwise(json_literal)


def filter_layers(features: DataFrame, names: Sequence[str], invert: bool = False) -> DataFrame:
    """Drops the named layers; with invert keeps only them."""
    listed = F.col("layer").isin(*names)
    return features.where(listed if invert else ~listed)


def filter_properties(features: DataFrame, regex: str, invert: bool = False) -> DataFrame:
    """Drops properties whose "layer/name" the pattern is found in; with invert keeps only them."""
    found = lambda k: F.concat("layer", F.lit("/"), k).rlike(regex)
    return features.withColumn("props", F.map_filter("props", lambda k, _: found(k) if invert else ~found(k)))


def select_properties(features: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    if include and exclude:
        raise ValueError("include and exclude cannot both be given")
    if include:
        return features.withColumn("props", F.map_filter("props", lambda k, _: k.isin(*include)))
    return features.withColumn("props", F.map_filter("props", lambda k, _: ~k.isin(*exclude))) if exclude else features


def filter_features(features: DataFrame, layers: Sequence[str], expr: str) -> DataFrame:
    """In the listed layers keeps features for which the expression is exactly true; others pass."""
    return features.where(~F.col("layer").isin(*layers) | compile_expression(expr))


def typed_table(rows: DataFrame, id_field: str, decimal_separator: str = ".", line: str | None = None) -> DataFrame:
    """(key, data): a text table as JSON literals by column; the last row of a key wins. The key stays text."""
    value = lambda c: F.replace(F.col(c), F.lit(decimal_separator), F.lit(".")) if decimal_separator != "." else F.col(c)
    pairs = [x for c in rows.columns if c != line for x in (F.lit(c), literal(F.col(c) if c == id_field else value(c)))]
    keyed = rows.select(F.col(id_field).alias("key"), F.create_map(*pairs).alias("data"), (F.col(line) if line else F.monotonically_increasing_id()).alias("_line"))
    return keyed.groupBy("key").agg(F.max_by("data", "_line").alias("data"))


def update_properties(
    features: DataFrame,
    table: DataFrame,
    layer: str,
    id_field_tiles: str,
    id_field_data: str,
    replace_properties: bool = False,
    remove_non_matching: bool = False,
    include_id: bool = False,
    decimal_separator: str = ".",
    line: str | None = None,
) -> DataFrame:
    """Left (or inner) join of one layer's features with a table of texts, on the text of a property.

    The table's values overwrite properties of the same name, or replace all. Features of the layer
    without the property are kept even if those without a match go. The table is broadcast if its
    measured bytes are few, else both sides are shuffled on the key."""
    dim = typed_table(table, id_field_data, decimal_separator, line)
    if not include_id:
        dim = dim.withColumn("data", F.map_filter("data", lambda k, _: k != F.lit(id_field_data)))
    texts = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + F.octet_length(F.lit(c)) + TEXT_BYTES for c in table.columns]
    few = table.agg(F.coalesce(F.sum(reduce(Column.__add__, texts) + ROW_BYTES), F.lit(0))).first()[0] <= BROADCAST_BYTES
    # A merge join else, as Spark would go by the bytes of files, which may be far fewer.
    dim = F.broadcast(dim) if few else dim.hint("merge")
    key = F.when(F.col("layer") == layer, plain(F.try_element_at("props", F.lit(id_field_tiles))))
    # Rows without a key match nothing: a number of their own deals them to all tasks, as nulls would all meet in one.
    spread = F.when(F.col("_key").isNull(), F.xxhash64(*[c for c, kind in features.dtypes if kind in ("bigint", "int", "string")])).otherwise(F.lit(0))
    out = features.withColumn("_key", key).withColumn("_spread", spread)
    # 0 for all of the table, but no constant, which would be no key of the join.
    none = F.least(F.length("key").cast("bigint"), F.lit(0))
    out = out.join(dim.withColumn("_none", none), (F.col("_key") == F.col("key")) & (F.col("_spread") == F.col("_none")), "left")
    if remove_non_matching:
        out = out.where(F.col("_key").isNull() | F.col("key").isNotNull())
    merged = F.map_zip_with("props", "data", lambda _, old, new: F.coalesce(new, old))
    updated = F.col("data") if replace_properties else merged
    return out.withColumn("props", F.when(F.col("key").isNotNull(), updated).otherwise(F.col("props"))).drop("_key", "key", "data", "_spread", "_none")


def repair_layers(layers: DataFrame) -> DataFrame:
    """Layer rows (z, x, y, layer, pos, extent, version, …): the first of each name, with default extent and version."""
    order = Window.partitionBy("z", "x", "y", "layer").orderBy("pos")
    first = layers.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first.withColumns({"extent": F.coalesce("extent", F.lit(4096)), "version": F.coalesce("version", F.lit(1))})


def field_types(features: DataFrame, lattice: str = "rank") -> DataFrame:
    """(layer, field, type, minzoom, maxzoom), the levels being those of the layer.

    rank: the widest of Boolean, Number, String; a null says nothing, so a field that is only null is not
    listed. conflict, as tiles are described: String for every field whose values differ in kind or are only null; a
    layer without fields is one row with a field of null."""
    if lattice not in ("rank", "conflict"):
        raise ValueError("lattice is rank or conflict")
    each = features.select("layer", "z", F.explode_outer("props").alias("field", "value"))
    kind = F.when(F.col("value").isin("true", "false"), 0).when(F.col("value").startswith('"'), 2).when(F.col("value") != "null", 1)
    grouped = each.groupBy("layer", "field").agg(F.max(kind).alias("hi"), F.min(kind).alias("lo"), F.min("z").alias("low"), F.max("z").alias("high"))
    layer = Window.partitionBy("layer")
    grouped = grouped.withColumns({"minzoom": F.min("low").over(layer), "maxzoom": F.max("high").over(layer), "known": F.count("field").over(layer)})
    widest = F.get(F.array(F.lit("Boolean"), F.lit("Number"), F.lit("String")), F.col("hi"))
    if lattice == "rank":
        return grouped.where("hi IS NOT NULL").select("layer", "field", widest.alias("type"), "minzoom", "maxzoom")
    name = F.when((F.col("hi") != F.col("lo")) | F.col("hi").isNull(), "String").otherwise(widest)
    return grouped.where("field IS NOT NULL OR known = 0").select("layer", "field", F.when(F.col("field").isNotNull(), name).alias("type"), "minzoom", "maxzoom")
