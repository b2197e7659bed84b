"""A tile relation with its description, and the description's own algebra."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RASTER, VECTOR = ("png", "jpg", "webp", "avif"), ("mvt",)


@dataclass(frozen=True)
class TileJSON:
    """What is known of a tileset without reading its tiles."""

    bounds: tuple[float, float, float, float] | None = None
    center: tuple[float, float, int] | None = None
    minzoom: int | None = None
    maxzoom: int | None = None
    values: dict = field(default_factory=dict)
    vector_layers: dict = field(default_factory=dict)

    @staticmethod
    def from_dict(known: dict) -> TileJSON:
        return _described(known)

    def to_dict(self) -> dict:
        """The JSON form, without what is not known."""
        out = {"tilejson": "3.0.0", **self.values, "bounds": self.bounds and list(self.bounds), "center": self.center and list(self.center), "minzoom": self.minzoom, "maxzoom": self.maxzoom}
        if self.vector_layers:
            out["vector_layers"] = [{"id": k, **v} for k, v in self.vector_layers.items()]
        return {k: v for k, v in out.items() if v is not None}

    def merge(self, other: TileJSON) -> TileJSON:
        """Bounds and levels grow; attribution and description are joined without repeats; the rest is overwritten."""
        both = lambda f, a, b: a if b is None else b if a is None else f(a, b)
        values = {**self.values, **other.values}
        for key, joint in (("attribution", " · "), ("description", "\n")):
            parts = [p for v in (self.values.get(key), other.values.get(key)) if v for p in v.split(joint)]
            if parts:
                values[key] = joint.join(dict.fromkeys(parts))
        return TileJSON(
            both(lambda a, b: (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])), self.bounds, other.bounds),
            other.center or self.center,
            both(min, self.minzoom, other.minzoom),
            both(max, self.maxzoom, other.maxzoom),
            values,
            merge_layers(self.vector_layers, other.vector_layers),
        )

    def update(self, **changes) -> TileJSON:
        """Scalars of the description; bounds, center, levels and layers by their names, others as values."""
        known = {k: v for k, v in changes.items() if k in ("bounds", "center", "minzoom", "maxzoom", "vector_layers")}
        return replace(self, **known, values={**self.values, **{k: v for k, v in changes.items() if k not in known and v is not None}})


def _described(known: dict) -> TileJSON:
    """A description from the JSON form that servers and archives have."""
    own = ("bounds", "center", "minzoom", "maxzoom", "vector_layers", "tiles", "tilejson")
    layers = {v["id"]: {k: w for k, w in v.items() if k != "id"} for v in known.get("vector_layers") or []}
    pick = lambda k: tuple(known[k]) if known.get(k) else None
    return TileJSON(pick("bounds"), pick("center"), known.get("minzoom"), known.get("maxzoom"), {k: v for k, v in known.items() if k not in own}, layers)


def merge_layers(a: dict, b: dict) -> dict:
    out = {k: dict(v) for k, v in a.items()}
    for name, layer in b.items():
        if name in out:
            old = out[name]
            out[name] = {**old, **layer, "fields": {**old.get("fields", {}), **layer.get("fields", {})}}
            for key, pick in (("minzoom", min), ("maxzoom", max)):
                known = [v[key] for v in (old, layer) if v.get(key) is not None]
                if known:
                    out[name][key] = pick(known)
        else:
            out[name] = dict(layer)
    return out


@dataclass(frozen=True)
class TileSet:
    """A relation of blobs (z, x, y, data) or of feature rows, whichever its last operator made.

    The other form is derived when it is asked for, so a chain of vector operators decodes once and
    encodes once, and a filter on rows or blobs is the same filter."""

    relation: DataFrame
    format: str
    compression: str = "none"
    tilejson: TileJSON = field(default_factory=TileJSON)
    lineage: tuple[str, ...] = ()

    @property
    def is_raster(self) -> bool:
        return self.format in RASTER

    @property
    def is_vector(self) -> bool:
        return self.format in VECTOR

    @property
    def tiles(self) -> DataFrame:
        from tesselon.operators.tiles import encode

        return self.relation if "data" in self.relation.columns else encode(self.relation)

    @property
    def features(self) -> DataFrame:
        from tesselon.operators.tiles import decode

        return decode(self.relation) if "data" in self.relation.columns else self.relation

    def then(self, relation: DataFrame, step: str, **changes) -> TileSet:
        return replace(self, relation=relation, lineage=(*self.lineage, step), **changes)

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        """One tile, by a point look-up before anything is encoded."""
        own = self.relation.where((F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y))
        row = replace(self, relation=own).tiles.select("data").head()
        return None if row is None else bytes(row.data)

    def explain(self) -> str:
        return " | ".join(self.lineage)
