"""The pipeline language: ``read-op key=value | transform …``, with sources in brackets.

Text is parsed to nodes, checked against the registered operators, then built into a TileSet; nothing is
read before the result is used, but for what the description of a source needs.
"""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tesselon.functions.coords import MAX_LEVEL, WORLD
from tesselon.operators import general, raster, reports, tiles, vector
from tesselon.plans.tileset import TileJSON, TileSet
from tesselon.sources import containers, features


class PipelineError(ValueError):
    """The text cannot be parsed, or names what does not exist."""


@dataclass
class Node:
    name: str
    args: dict[str, list[str]] = field(default_factory=dict)
    sources: list[list[Node]] = field(default_factory=list)


_WORD = re.compile(r"[A-Za-z_][\w-]*")
_PLAIN = re.compile(r"[^\s\[\]|,\"'#]+")


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def space(self) -> None:
        while m := re.compile(r"\s+|#[^\n]*").match(self.text, self.at):
            self.at = m.end()

    def next(self) -> str:
        self.space()
        return self.text[self.at : self.at + 1]

    def fail(self, what: str):
        line = self.text.count("\n", 0, self.at) + 1
        raise PipelineError(f"line {line}: expected {what} at {self.text[self.at:self.at + 12]!r}")

    def match(self, pattern: re.Pattern, what: str) -> str:
        self.space()
        m = pattern.match(self.text, self.at)
        if not m:
            self.fail(what)
        self.at = m.end()
        return m[0]

    def pipeline(self) -> list[Node]:
        nodes = [self.node()]
        while self.next() == "|":
            self.at += 1
            nodes.append(self.node())
        return nodes

    def node(self) -> Node:
        node = Node(self.match(_WORD, "a name"))
        while (c := self.next()) not in ("", "|", "]", ","):
            if c == "[":
                node.sources += self.many(self.pipeline)
                continue
            key = self.match(_WORD, "a parameter")
            if self.next() != "=":
                self.fail("'='")
            self.at += 1
            if key in node.args:
                raise PipelineError(f"{node.name}: {key} is given twice")
            node.args[key] = self.many(self.value) if self.next() == "[" else [self.value()]
        return node

    def many(self, item: Callable) -> list:
        self.at += 1
        out = []
        while self.next() != "]":
            out.append(item())
            if self.next() == ",":
                self.at += 1
            elif self.next() != "]":
                self.fail("',' or ']'")
        self.at += 1
        return out

    def value(self) -> str:
        quote = self.next()
        if quote not in ("'", '"'):
            return self.match(_PLAIN, "a value")
        out, self.at = "", self.at + 1
        while self.at < len(self.text) and self.text[self.at] != quote:
            if self.text[self.at] == "\\" and self.at + 1 < len(self.text):
                self.at += 1
            out += self.text[self.at]
            self.at += 1
        if self.at >= len(self.text):
            self.fail("a closing quote")
        self.at += 1
        return out


def parse(text: str) -> list[Node]:
    parser = _Parser(text)
    nodes = parser.pipeline()
    if parser.next():
        parser.fail("'|' or the end")
    return nodes


def render(nodes: list[Node]) -> str:
    """The text of a pipeline in one standing form; parsing it gives the same nodes."""

    def value(v: str) -> str:
        if _PLAIN.fullmatch(v):
            return v
        escaped = v.replace("\\", "\\\\").replace('"', '\\"')
        return f'"{escaped}"'

    def one(node: Node) -> str:
        parts = [node.name]
        parts += [f"{k}={value(v[0])}" if len(v) == 1 else f"{k}=[{', '.join(map(value, v))}]" for k, v in node.args.items()]
        if node.sources:
            parts.append(f"[{', '.join(map(render, node.sources))}]")
        return " ".join(parts)

    return " | ".join(map(one, nodes))


# --- registry ------------------------------------------------------------------------------------

READ: dict[str, Callable] = {}
TRANSFORM: dict[str, Callable] = {}


def operator(kind: dict[str, Callable], needs: str | None = None):
    """Registers a function; its keyword parameters are the operator's, converted by their annotations."""

    def register(f: Callable) -> Callable:
        f.needs = needs
        kind[f.__name__.rstrip("_")] = f
        return f

    return register


def _convert(values: list[str], kind, name: str):
    text = str(kind)
    try:
        if text.startswith("list"):
            return [float(v) for v in values] if "float" in text else values
        if len(values) != 1:
            raise PipelineError(f"{name} takes one value")
        value = values[0]
        if "bool" in text:
            if value not in ("true", "false"):
                raise ValueError(value)
            return value == "true"
        return int(value) if "int" in text else float(value) if "float" in text else value
    except ValueError as error:
        raise PipelineError(f"{name}: {error}") from error


def parameters(f: Callable) -> dict[str, inspect.Parameter]:
    return {k: p for k, p in inspect.signature(f).parameters.items() if p.kind == p.KEYWORD_ONLY}


def describe() -> list[tuple[str, str, str, list[str]]]:
    """(kind, operator, what it says of itself, parameters with their kinds and defaults)."""
    return [
        (kind, name, inspect.getdoc(f) or "", [f"{k}: {p.annotation}" + ("" if p.default is p.empty else f" = {p.default}") for k, p in parameters(f).items() if k != "unused"])
        for kind, table in (("read", READ), ("transform", TRANSFORM))
        for name, f in sorted(table.items())
    ]


def check(nodes: list[Node]) -> list[str]:
    """Problems of a pipeline that can be told without reading anything."""
    out = []
    for i, node in enumerate(nodes):
        table, other = (READ, TRANSFORM) if i == 0 else (TRANSFORM, READ)
        if node.name not in table:
            out.append(f"{node.name} {'is no read operator' if i == 0 else 'is no transform'}" if node.name in other else f"unknown operator {node.name}")
            continue
        known = parameters(table[node.name])
        out += [f"{node.name}: unknown parameter {k}" for k in node.args if k not in known]
        out += [f"{node.name}: {k} is missing" for k, p in known.items() if p.default is p.empty and k not in node.args]
        takes = "sources" in inspect.signature(table[node.name]).parameters
        if node.sources and not takes:
            out.append(f"{node.name} takes no sources")
        if takes and len(node.sources) < 2:
            out.append(f"{node.name} needs two sources at least")
        out += [p for s in node.sources for p in check(s)]
    return out


def build(spark: SparkSession, nodes: list[Node]) -> TileSet:
    problems = check(nodes)
    if problems:
        raise PipelineError("; ".join(problems))
    out: TileSet | None = None
    for i, node in enumerate(nodes):
        f = (READ if i == 0 else TRANSFORM)[node.name]
        kinds = parameters(f)
        args = {k: _convert(v, kinds[k].annotation, f"{node.name}: {k}") for k, v in node.args.items()}
        if i == 0:
            more = [[build(spark, s) for s in node.sources]] if "sources" in inspect.signature(f).parameters else []
            out = f(spark, *more, **args)
        else:
            if f.needs and not getattr(out, f"is_{f.needs}"):
                raise PipelineError(f"{node.name} needs {f.needs} tiles, not {out.format}")
            out = f(out, **args)
    return out


def run_vpl(spark: SparkSession, text: str) -> TileSet:
    return build(spark, parse(text))


# --- read operators ------------------------------------------------------------------------------

WHOLE = [-180.0, -85.05112877980659, 180.0, 85.05112877980659]


@operator(READ)
def from_container(spark, *, filename: str) -> TileSet:
    """Tiles with the description that the container has. The format is that of the first blob; where there is none,
    the described one."""
    read, known = containers.read_container(spark, filename), containers.describe(filename)
    head = read.select("data").head()
    kind, packed = containers.sniff(bytes(head.data)) if head else ({"pbf": "mvt"}.get(known.get("format"), known.get("format") or "mvt"), "none")
    known.pop("format", None)
    return TileSet(containers.recompress(read, packed, "none").select("z", "x", "y", "data"), kind, "none", tilejson=TileJSON.from_dict(known), lineage=("from_container",))


@operator(READ)
def from_stacked(spark, sources, *, unused: str = "") -> TileSet:
    if len({s.format for s in sources}) > 1:
        raise PipelineError("from_stacked needs sources of one format")
    return TileSet(general.stack([s.tiles for s in sources]), sources[0].format, tilejson=_merged(sources), lineage=("from_stacked",))


@operator(READ)
def from_merged_vector(spark, sources, *, unused: str = "") -> TileSet:
    if not all(s.is_vector for s in sources):
        raise PipelineError("from_merged_vector needs vector sources")
    return TileSet(general.merge_features([s.features for s in sources]), "mvt", tilejson=_merged(sources), lineage=("from_merged_vector",))


@operator(READ)
def from_stacked_raster(spark, sources, *, format: str = "png", auto_overscale: bool = False) -> TileSet:
    if format != "png" or not all(s.is_raster for s in sources):
        raise PipelineError("from_stacked_raster needs PNG sources and gives PNG")
    draw = raster.stack_overscaled if auto_overscale else raster.stack_images
    return TileSet(draw([s.tiles for s in sources]), "png", tilejson=_merged(sources), lineage=("from_stacked_raster",))


def _merged(sources: list[TileSet]) -> TileJSON:
    out = sources[0].tilejson
    for s in sources[1:]:
        out = out.merge(s.tilejson)
    return out


def _shapes(spark, shapes, layer: str, min_zoom: int, max_zoom: int | None, step: str, **reduce) -> TileSet:
    if max_zoom is None:
        found = reports.auto_max_zoom(tiles.shape_sizes(shapes), WORLD).first()
        max_zoom = 14 if found is None else found.zoom
    drawn = tiles.draw_shapes(shapes, range(min_zoom, max_zoom + 1), layer, **reduce)
    return TileSet(drawn, "mvt", tilejson=TileJSON(minzoom=min_zoom, maxzoom=max_zoom, vector_layers={layer: {"fields": {}}}), lineage=(step,))


def _imported(spark, shapes, layer: str, min_zoom: int, max_zoom: int | None, step: str, max_tile_bytes: str, **options) -> TileSet:
    """Shapes at all levels by the cascade. Tiles above max_tile_bytes, gzipped, are left out; none keeps all."""
    from tesselon.operators import importer

    if max_zoom is None:
        found = reports.auto_max_zoom(tiles.shape_sizes(shapes), WORLD).first()
        max_zoom = 14 if found is None else found.zoom
    if min_zoom > max_zoom:
        raise PipelineError(f"min_zoom {min_zoom} is above max_zoom {max_zoom}")
    try:
        cap = None if max_tile_bytes == "none" else int(max_tile_bytes)
        drawn = importer.import_shapes(shapes, range(min_zoom, max_zoom + 1), layer, **options)
    except ValueError as error:
        raise PipelineError(str(error)) from error
    relation = drawn if cap is None else tiles.within_packed_cap(tiles.encode(drawn), cap)
    return TileSet(relation, "mvt", tilejson=TileJSON(minzoom=min_zoom, maxzoom=max_zoom, vector_layers={layer: {"fields": {}}}), lineage=(step,))


def _stem(filename: str) -> str:
    return filename.rstrip("/").rsplit("/", 1)[-1].split(".")[0]


def _without_ids(shapes, ignore: bool):
    return shapes.withColumn("id", F.lit(None).cast("bigint")) if ignore else shapes


@operator(READ)
def from_csv(spark, *, filename: str, lon_column: str, lat_column: str, id_column: str = None, delimiter: str = ",", has_header: bool = True, layer_name: str = None, min_zoom: int = 0, max_zoom: int = None, properties_include: list = None, properties_exclude: list = None, point_reduction: str = "min_distance", point_reduction_value: float = None, max_tile_bytes: str = "1048576", ignore_id: bool = False) -> TileSet:
    """The layer is named after the file, and the deepest level chosen by the shapes' sizes, unless they are given.
    point_reduction is none, min_distance (16 units of a tile's extent) or drop_rate (keeps 0.5)."""
    if not has_header:
        raise PipelineError("from_csv needs a header")
    shapes = features.read_csv(spark, filename, lon_column, lat_column, id_column, delimiter, properties_include, properties_exclude)
    return _imported(spark, _without_ids(shapes, ignore_id), layer_name or _stem(filename), min_zoom, max_zoom, "from_csv", max_tile_bytes, point_reduction=point_reduction, point_value=point_reduction_value)


@operator(READ)
def from_geo(spark, *, filename: str, layer_name: str = None, min_zoom: int = 0, max_zoom: int = None, properties_include: list = None, properties_exclude: list = None, polygon_min_area: float = 4.0, polygon_simplify: float = 4.0, line_min_length: float = 4.0, line_simplify: float = 4.0, point_reduction: str = "min_distance", point_reduction_value: float = None, max_tile_bytes: str = "1048576", ignore_id: bool = False, shared_borders: float = 0.0) -> TileSet:
    """Borders that shapes share stay shared at every level. shared_borders: tolerance in degrees of a simplification
    before all levels."""
    from tesselon.operators.borders import simplify_shared

    shapes = features.read_shapefile(spark, filename) if filename.lower().endswith(".shp") else features.read_geojson(spark, filename)
    if shared_borders > 0:
        shapes = simplify_shared(shapes, shared_borders)
    shapes = vector.select_properties(_without_ids(shapes, ignore_id), properties_include, properties_exclude)
    limits = {"polygon_simplify": polygon_simplify, "line_simplify": line_simplify, "polygon_min_area": polygon_min_area, "line_min_length": line_min_length}
    return _imported(spark, shapes, layer_name or _stem(filename), min_zoom, max_zoom, "from_geo", max_tile_bytes, point_reduction=point_reduction, point_value=point_reduction_value, **limits)


@operator(READ)
def from_grid(spark, *, epsg: int, size: float, bbox: list[float], offset: list[float] = None, id_preset: str = None, id_template: str = None, id_field: str = "id", x_field: str = "x", y_field: str = "y", layer_name: str = "grid", max_cells_per_tile: int = 1024, max_zoom: int = None) -> TileSet:
    """Cells of EPSG:4326, 3857 or 3035 as polygons, in all tiles that the box, in degrees, touches. Levels go from the
    first whose tiles hold few enough cells to max_zoom, or three further ones."""
    from tesselon.functions.coords import laea_inverse

    metres = size * 111_319.49 if epsg == 4326 else size
    low = features.grid_zoom(metres, max_cells_per_tile)
    top = min(MAX_LEVEL, low + 3) if max_zoom is None else max_zoom
    low = min(low, top)
    box = features.grid_box(spark, epsg, features.tiles_box(tuple(bbox), low))
    cells = features.grid_cells(spark, epsg, size, box, tuple(offset or (0.0, 0.0)), id_preset, id_template)

    def place(a: str, b: str):
        if epsg == 3035:
            return laea_inverse(a, b)
        if epsg == 4326:
            return F.col(a), F.col(b)
        return F.col(a) / 6_378_137.0 * 180 / F.pi(), F.degrees(2 * F.atan(F.exp(F.col(b) / 6_378_137.0)) - F.pi() / 2)

    number = lambda c: F.when(F.floor(c) == F.col(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))
    corner = lambda a, b: F.concat(F.lit("["), F.concat_ws(",", *[v.cast("string") for v in place(a, b)]), F.lit("]"))
    ring = F.concat_ws(",", *[corner(a, b) for a, b in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))])
    shapes = cells.select(F.lit(None).cast("bigint").alias("id"), F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")).alias("geometry"), F.create_map(F.lit(id_field), F.concat(F.lit('"'), "id_text", F.lit('"')), F.lit(x_field), number("west"), F.lit(y_field), number("south")).alias("props"))
    drawn = _shapes(spark, shapes, layer_name, low, top, "from_grid", tolerance=0.0)
    fields = {id_field: "String", x_field: "Number", y_field: "Number"}
    known = TileJSON(bounds=tuple(bbox), minzoom=low, maxzoom=top, values={"name": layer_name}, vector_layers={layer_name: {"fields": fields, "minzoom": low, "maxzoom": top}})
    return TileSet(general.filter_tiles(drawn.relation, tuple(bbox)), "mvt", tilejson=known, lineage=("from_grid",))


@operator(READ)
def from_tilejson(spark, *, url: str, max_retries: int = 3, max_concurrent_requests: int = 4) -> TileSet:
    from tesselon.sources.remote import read_tilejson

    fetched, known = read_tilejson(spark, url, max_retries, max_concurrent_requests)
    kind = "mvt" if known.vector_layers or known.values.get("format") in ("pbf", "mvt") else "png"
    return TileSet(fetched, kind, tilejson=known, lineage=("from_tilejson",))


@operator(READ)
def from_color(spark, *, color: str = "000000", size: int = 512, level_max: int = 4, bbox: list[float] = None) -> TileSet:
    keys = features.coordinates(spark, range(level_max + 1), tuple(bbox or WHOLE))
    return TileSet(features.color_tiles(keys, color, size), "png", lineage=("from_color",))


@operator(READ)
def from_debug(spark, *, level_max: int = 4, bbox: list[float] = None) -> TileSet:
    keys = features.coordinates(spark, range(level_max + 1), tuple(bbox or WHOLE))
    layers = {f"debug_{c}": {"fields": {"char": "String", "index": "Number"}} for c in "zxy"}
    return TileSet(features.debug_features(keys), "mvt", tilejson=TileJSON(vector_layers=layers), lineage=("from_debug",))


@operator(READ)
def from_tile(spark, *, filename: str, level_max: int = 4, bbox: list[float] = None) -> TileSet:
    keys = features.coordinates(spark, range(level_max + 1), tuple(bbox or WHOLE))
    kind = next((k for k in ("png", "jpg", "webp", "avif") if filename.lower().endswith("." + k)), "mvt")
    return TileSet(features.one_tile(keys, filename), kind, lineage=("from_tile",))


# --- transforms ----------------------------------------------------------------------------------


@operator(TRANSFORM)
def filter_(source, *, bbox: list[float] = None, bbox_border: int = None, level_min: int = None, level_max: int = None, filename: str = None) -> TileSet:
    mask = containers.read_container(source.relation.sparkSession, filename) if filename else None
    out = general.filter_tiles(source.relation, tuple(bbox) if bbox else None, bbox_border, level_min, level_max, mask)
    return source.then(out, "filter", tilejson=source.tilejson.update(center=None, bounds=tuple(bbox) if bbox else source.tilejson.bounds))


@operator(TRANSFORM)
def remap_coords(source, *, flip_x: bool = False, flip_y: bool = False, swap_xy: bool = False) -> TileSet:
    return source.then(general.remap_coords(source.relation, flip_x, flip_y, swap_xy), "remap_coords")


@operator(TRANSFORM)
def meta_update(source, *, attribution: str = None, bounds: list[float] = None, center: list[float] = None, description: str = None, fillzoom: int = None, legend: str = None, name: str = None, schema: str = None, tilejson: str = None, tilejson_update: str = None, vector_layers: str = None) -> TileSet:
    if tilejson and tilejson_update:
        raise PipelineError("tilejson and tilejson_update exclude each other")
    now = TileJSON() if tilejson else source.tilejson
    for text in filter(None, (tilejson, tilejson_update)):
        now = now.update(**{k: tuple(v) if k in ("bounds", "center") else {x["id"]: x for x in v} if k == "vector_layers" else v for k, v in json.loads(text).items()})
    scalars = {"attribution": attribution, "description": description, "fillzoom": fillzoom, "legend": legend, "name": name, "tile_schema": schema}
    now = now.update(**scalars, **({"bounds": tuple(bounds)} if bounds else {}), **({"center": tuple(center)} if center else {}), **({"vector_layers": json.loads(vector_layers)} if vector_layers else {}))
    return source.then(source.relation, "meta_update", tilejson=now)


def _deepest(source: TileSet) -> int:
    """The deepest level that has tiles."""
    found = source.relation.agg(F.max("z")).first()[0]
    if found is None:
        raise PipelineError("the source has no tiles")
    return found


def _on_features(source: TileSet, step: str, change: Callable) -> TileSet:
    return source.then(change(source.features), step)


@operator(TRANSFORM, "vector")
def vector_filter_layers(source, *, filter: list, invert: bool = False) -> TileSet:
    """Tiles that lose their last layer stay, empty. Blobs are not decoded for it."""
    if "data" in source.relation.columns:
        return source.then(tiles.drop_layers(source.relation, filter, invert), "vector_filter_layers")
    kept = vector.filter_layers(source.relation, filter, invert)
    emptied = source.relation.select(tiles.KEY).distinct().join(kept.select(tiles.KEY).distinct(), tiles.KEY, "left_anti")
    return source.then(tiles.encode(kept).unionByName(emptied.withColumn("data", F.lit(b""))), "vector_filter_layers")


@operator(TRANSFORM, "vector")
def vector_filter_properties(source, *, regex: str, invert: bool = False) -> TileSet:
    return _on_features(source, "vector_filter_properties", lambda f: vector.filter_properties(f, regex, invert))


@operator(TRANSFORM, "vector")
def vector_filter_features(source, *, layer: list, expr: str) -> TileSet:
    return _on_features(source, "vector_filter_features", lambda f: vector.filter_features(f, layer, expr))


@operator(TRANSFORM, "vector")
def vector_update_properties(source, *, data_source_path: str, layer_name: str, id_field_tiles: str, id_field_data: str, replace_properties: bool = False, remove_non_matching: bool = False, include_id: bool = False, field_separator: str = ",", decimal_separator: str = ".") -> TileSet:
    rows = source.relation.sparkSession.read.csv(data_source_path, header=True, sep=field_separator)
    return _on_features(source, "vector_update_properties", lambda f: vector.update_properties(f, rows, layer_name, id_field_tiles, id_field_data, replace_properties, remove_non_matching, include_id, decimal_separator))


@operator(TRANSFORM, "vector")
def vector_repair(source, *, drop_offenders: bool = False) -> TileSet:
    return source.then(tiles.repair(source.tiles, drop_offenders), "vector_repair")


@operator(TRANSFORM, "vector")
def vector_overzoom(source, *, level_base: int = None, level_max: int = None, enable_climbing: bool = False, buffer: int = 80) -> TileSet:
    level_base = _deepest(source) if level_base is None else level_base
    top = min(MAX_LEVEL, level_base + 4 if level_max is None else level_max)
    zoom = tiles.overzoom_climbing if enable_climbing else tiles.overzoom
    return _on_features(source, "vector_overzoom", lambda f: zoom(f, level_base, top, buffer=buffer))


@operator(TRANSFORM, "raster")
def raster_flatten(source, *, color: str = "ffffff") -> TileSet:
    return source.then(raster.flatten(source.tiles, features.parse_color(color)[:3]), "raster_flatten")


@operator(TRANSFORM, "raster")
def raster_levels(source, *, brightness: float = 0.0, contrast: float = 1.0, gamma: float = 1.0) -> TileSet:
    return source.then(raster.adjust_levels(source.tiles, brightness, contrast, gamma), "raster_levels")


@operator(TRANSFORM, "raster")
def raster_format(source, *, format: str = "png", effort: int = 6) -> TileSet:
    if format != "png":
        raise PipelineError(f"no encoder for {format}")
    return source.then(raster.reencode(source.tiles, effort), "raster_format")


@operator(TRANSFORM, "raster")
def raster_mask(source, *, geojson: str, buffer: float = 0.0, blur: float = 0.0, blur_function: str = "linear") -> TileSet:
    from tesselon.functions.geometry import shape_parts

    shapes = features.read_geojson(source.relation.sparkSession, geojson).select("geometry").collect()
    rings = [ring for s in shapes for kind, parts in [shape_parts(json.loads(s.geometry))] if kind == 3 for ring in parts]
    return source.then(raster.mask(source.tiles, rings, buffer, blur, blur_function), "raster_mask")


@operator(TRANSFORM, "raster")
def raster_overview(source, *, level: int = None) -> TileSet:
    return source.then(raster.overview(source.tiles, _deepest(source) if level is None else level), "raster_overview")


@operator(TRANSFORM, "raster")
def raster_overscale(source, *, level_base: int, level_max: int, enable_climbing: bool = False, bbox: list[float] = None) -> TileSet:
    keys = features.coordinates(source.relation.sparkSession, range(level_max + 1), tuple(bbox or WHOLE))
    return source.then(raster.overscaled(keys, source.tiles, level_base, enable_climbing), "raster_overscale")


@operator(TRANSFORM, "raster")
def raster_tile_resize(source, *, tile_size: int) -> TileSet:
    return source.then(raster.resize(source.tiles, tile_size), "raster_tile_resize")


@operator(TRANSFORM, "raster")
def dem_overview(source, *, level: int = None) -> TileSet:
    return source.then(raster.overview(source.tiles, _deepest(source) if level is None else level, dem=True), "dem_overview")


@operator(TRANSFORM, "raster")
def dem_quantize(source, *, elevation_error: float = 0.1, slope_error: float = 1.0, encoding: str = "mapbox") -> TileSet:
    return source.then(raster.dem_quantize(source.tiles, elevation_error, slope_error, encoding), "dem_quantize")


@operator(TRANSFORM, "raster")
def dem_tile_resize(source, *, tile_size: int) -> TileSet:
    return source.then(raster.resize(source.tiles, tile_size, dem=True), "dem_tile_resize")


