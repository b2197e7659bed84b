"""Feature sources: CSV points, GeoJSON and line-delimited GeoJSON, Shapefiles; generated tiles and grids."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions import png as P
from tesselon.functions.coords import WORLD, bbox_to_range, laea_forward, mercator_x, mercator_y
from tesselon.functions.values import ID_PRESETS, format_template
from tesselon.operators.vector import literal

SHAPES = "id long, geometry string, props map<string,string>"


def read_csv(spark: SparkSession, path: str, lon_column: str, lat_column: str, id_column: str | None = None, delimiter: str = ",", include=None, exclude=None) -> DataFrame:
    """Point shapes of a CSV with a header. Rows without numbers for a place are skipped; all other columns
    are text properties."""
    if include and exclude:
        raise ValueError("include and exclude cannot both be given")
    rows = spark.read.csv(path, header=True, sep=delimiter, mode="PERMISSIVE", escape='"')
    for column in filter(None, (lon_column, lat_column, id_column)):
        if column not in rows.columns:
            raise ValueError(f"no column {column} in {path}")
    lon, lat = (F.col(c).try_cast("double") for c in (lon_column, lat_column))
    names = [c for c in rows.columns if c not in (lon_column, lat_column, id_column) and (not include or c in include) and (not exclude or c not in exclude)]
    text = lambda c: F.regexp_replace(F.to_json(F.array(F.coalesce(F.col(c), F.lit("")))), r"^\[|\]$", "")
    props = F.create_map(*[x for c in names for x in (F.lit(c), text(c))]) if names else F.create_map().cast("map<string,string>")
    number = F.col(id_column).try_cast("bigint") if id_column else F.lit(None).cast("bigint")
    geometry = F.concat(F.lit('{"type":"Point","coordinates":['), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("]}"))
    return rows.where(lon.isNotNull() & lat.isNotNull() & lat.between(-90, 90)).select(number.alias("id"), geometry.alias("geometry"), props.alias("props"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Shapes of a FeatureCollection, or of features one to a line (with or without record separators)."""
    if path.lower().endswith((".geojsonl", ".ndjson", ".geojsonseq", ".ndgeojson", ".jsonl")):
        raw = spark.read.text(path).select(F.regexp_replace("value", "^\x1e", "").alias("f")).where(F.length(F.trim("f")) > 0)
    else:
        whole = spark.read.text(path, wholetext=True)
        kind = F.get_json_object("value", "$.type")
        items = F.from_json(F.get_json_object("value", "$.features"), "array<variant>")
        raw = whole.select(F.explode(F.when(kind == "FeatureCollection", F.transform(items, lambda v: F.to_json(v))).otherwise(F.array("value"))).alias("f"))
    props = F.from_json(F.get_json_object("f", "$.properties"), "map<string,variant>")
    scalar = F.map_filter(F.transform_values(props, lambda _, v: F.to_json(v)), lambda _, v: v.isNotNull() & ~v.startswith("{") & ~v.startswith("["))
    return raw.select(F.get_json_object("f", "$.id").try_cast("bigint").alias("id"), F.get_json_object("f", "$.geometry").alias("geometry"), F.coalesce(scalar, F.create_map().cast("map<string,string>")).alias("props")).where("geometry IS NOT NULL")


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Shapes of .shp files and the .dbf beside each; geographic coordinates, further dimensions ignored."""
    import json

    pairs = spark.read.format("binaryFile").load([path, path[:-4] + ".dbf"])
    stem = F.regexp_extract("path", r"(.*)\.\w+$", 1)
    both = pairs.groupBy(stem.alias("stem")).agg(F.max(F.when(F.col("path").endswith(".shp"), F.col("content"))).alias("shp"), F.max(F.when(F.col("path").endswith(".dbf"), F.col("content"))).alias("dbf"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shp, dbf in zip(batch["shp"], batch["dbf"], strict=True):
                table = dbf_rows(bytes(dbf)) if dbf is not None else []
                rows = [(i, json.dumps(g), table[i] if i < len(table) else {}) for i, g in enumerate(shp_geometries(bytes(shp))) if g]
                yield pd.DataFrame(rows, columns=["id", "geometry", "props"])

    return both.mapInPandas(run, SHAPES)


def shp_geometries(data: bytes) -> list[dict | None]:
    out, at = [], 100
    while at + 12 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == 1:
            out.append({"type": "Point", "coordinates": list(struct.unpack("<2d", body[4:20]))})
        elif kind == 8:
            n = struct.unpack("<i", body[36:40])[0]
            out.append({"type": "MultiPoint", "coordinates": np.frombuffer(body, "<f8", 2 * n, 40).reshape(-1, 2).tolist()})
        elif kind in (3, 5):
            parts, n = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
            points = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2).tolist()
            lines = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            out.append({"type": "MultiLineString" if kind == 3 else "Polygon", "coordinates": lines})
        else:
            out.append(None)
    return out


def dbf_rows(data: bytes) -> list[dict[str, str]]:
    """Rows as JSON literals; dates stay texts."""
    import json

    count, header, width = struct.unpack("<IHH", data[4:12])
    columns, at = [], 32
    while data[at] != 0x0D:
        columns.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16]))
        at += 32
    rows = []
    for i in range(count):
        record, at, row = data[header + i * width : header + (i + 1) * width], 1, {}
        for name, kind, size in columns:
            text, at = record[at : at + size].decode("utf-8", "replace").strip(), at + size
            if not text:
                continue
            if kind in "NF":
                row[name] = json.dumps(float(text) if "." in text or "e" in text.lower() else int(text))
            elif kind == "L":
                row[name] = "true" if text in "YyTt" else "false"
            else:
                row[name] = json.dumps(text, ensure_ascii=False)
        rows.append(row)
    return rows


# --- generated -----------------------------------------------------------------------------------


def coordinates(spark: SparkSession, levels: range, bbox=(-180.0, -85.05112877980659, 180.0, 85.05112877980659), most: int = 10**10) -> DataFrame:
    """All tile keys of some levels in a box, made where they are used; refuses more than ``most``."""
    ranges = [(z, *bbox_to_range(bbox, z)) for z in levels]
    total = sum((c - a + 1) * (d - b + 1) for _, a, b, c, d in ranges)
    if total > most:
        raise ValueError(f"{total} tiles are more than {most}")
    out = None
    for z, a, b, c, d in ranges:
        width = c - a + 1
        part = spark.range(0, width * (d - b + 1)).select(F.lit(z).cast("bigint").alias("z"), (F.col("id") % width + a).alias("x"), (F.floor(F.col("id") / width) + b).cast("bigint").alias("y"))
        out = part if out is None else out.unionByName(part)
    return out


def parse_color(text: str) -> tuple[int, ...]:
    """Hexadecimal RGB or RGBA, one or two digits each."""
    digits = text.lstrip("#")
    if len(digits) in (3, 4):
        digits = "".join(c * 2 for c in digits)
    if len(digits) not in (6, 8):
        raise ValueError(f"bad colour {text}")
    return tuple(int(digits[i : i + 2], 16) for i in range(0, len(digits), 2))


def color_tiles(keys: DataFrame, color: str = "000000", size: int = 512) -> DataFrame:
    pixel = np.array(parse_color(color), np.uint8)
    return keys.withColumn("data", F.lit(P.encode_png(np.broadcast_to(pixel, (size, size, len(pixel))).copy())))


def one_tile(keys: DataFrame, path: str) -> DataFrame:
    """The content of one file at every key."""
    content = keys.sparkSession.read.format("binaryFile").load(path).select("content").head()
    if content is None:
        raise ValueError(f"no file {path}")
    return keys.withColumn("data", F.lit(bytes(content[0])))


def debug_features(keys: DataFrame) -> DataFrame:
    """Point features that name each tile's own coordinates, in layers debug_z, debug_x and debug_y."""
    rows = keys.select("*", F.posexplode(F.array(*[F.struct(F.lit(f"debug_{c}").alias("layer"), F.col(c).alias("value")) for c in ("z", "x", "y")])).alias("feat_no", "d"))
    props = F.create_map(F.lit("char"), F.concat(F.lit('"'), F.col("d.value").cast("string"), F.lit('"')), F.lit("index"), F.col("feat_no").cast("string"))
    point = F.array(F.array(F.array(F.lit(2048).cast("bigint"), (F.col("feat_no") * 512 + 1024).cast("bigint"))))
    return rows.select("z", "x", "y", F.col("d.layer").alias("layer"), F.col("feat_no").cast("bigint"), F.lit(None).cast("bigint").alias("id"), F.lit(1).alias("kind"), point.alias("parts"), props.alias("props"))


def grid_zoom(cell: float, max_cells: int) -> int:
    return min(30, max(0, int(np.ceil(np.log2(WORLD / (cell * np.sqrt(max_cells)))))))


def tiles_box(bbox: tuple[float, float, float, float], level: int, margin: float = 80 / 4096) -> tuple[float, float, float, float]:
    """The degrees that the tiles of a level cover which a box touches, with a margin of tiles."""
    x0, y0, x1, y1 = bbox_to_range(bbox, level)
    n = 1 << level
    lon = lambda x: min(180.0, max(-180.0, x / n * 360 - 180))
    lat = lambda y: float(np.degrees(2 * np.arctan(np.exp(np.pi * (1 - 2 * min(1.0, max(0.0, y / n)))))) - 90)
    return lon(x0 - margin), lat(y1 + 1 + margin), lon(x1 + 1 + margin), lat(y0 - margin)


def grid_box(spark: SparkSession, epsg: int, bbox: tuple[float, float, float, float], samples: int = 64) -> tuple[float, float, float, float]:
    """The box in the units of a known system that holds a box in degrees, by places along and within it."""
    step = [F.lit(bbox[k]) + (bbox[k + 2] - bbox[k]) / samples * F.col(c) for k, c in ((0, "i"), (1, "j"))]
    places = spark.range((samples + 1) ** 2).select((F.col("id") % (samples + 1)).alias("i"), F.floor(F.col("id") / (samples + 1)).alias("j")).select(step[0].alias("lon"), step[1].alias("lat"))
    if epsg == 4326:
        return bbox
    x, y = laea_forward("lon", "lat") if epsg == 3035 else (mercator_x("lon"), mercator_y("lat"))
    return tuple(places.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first())


def grid_cells(spark: SparkSession, epsg: int, size: float, bbox: tuple[float, float, float, float], offset: tuple[float, float] = (0.0, 0.0), id_preset: str | None = None, id_template: str | None = None) -> DataFrame:
    """Cells (id_text, cx, cy, west, south, east, north in the grid's units) of a square grid that touch a
    box in those units. Known systems: 3035, 3857 (metres) and 4326 (degrees)."""
    if epsg not in (3035, 3857, 4326):
        raise ValueError(f"EPSG:{epsg} is not built in")
    i0, j0 = (int(np.floor((bbox[k] - offset[k]) / size)) for k in (0, 1))
    i1, j1 = (int(np.ceil((bbox[k + 2] - offset[k]) / size)) - 1 for k in (0, 1))
    width = max(0, i1 - i0 + 1)
    cells = spark.range(0, width * max(0, j1 - j0 + 1)).select((F.col("id") % max(1, width) + i0).alias("cx"), (F.floor(F.col("id") / max(1, width)) + j0).cast("bigint").alias("cy"))
    west, south = F.col("cx") * size + offset[0], F.col("cy") * size + offset[1]
    template = id_template or ID_PRESETS[id_preset or "inspire"]
    whole = lambda v: F.floor(v).cast("bigint")
    fields = {"epsg": F.lit(str(epsg)), "size": F.lit(f"{size:g}"), "size_km": F.lit(f"{size / 1000:g}km"), "x": whole(west), "y": whole(south), "cx": F.col("cx"), "cy": F.col("cy")}
    return cells.select(format_template(template, fields).alias("id_text"), "cx", "cy", west.alias("west"), south.alias("south"), (west + size).alias("east"), (south + size).alias("north"))


def property_map(rows: DataFrame, names: list[str]):
    """Columns of texts as a map of JSON literals."""
    return F.create_map(*[x for n in names for x in (F.lit(n), literal(F.col(n)))])
