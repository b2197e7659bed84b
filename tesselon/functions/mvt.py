"""Vector tile codec (protocol buffers wire format), geometry commands, validation and statistics.

Layers and features are plain dicts; the functions run inside Arrow functions, one tile a row.
"""

from __future__ import annotations

import json
import struct
from array import array
from collections.abc import Iterator

#: Geometry types of the format.
UNKNOWN, POINT, LINE, POLYGON = range(4)
#: Rows that are handed on together.
FEW = 4096


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7
        if shift > 63:
            raise ValueError("varint is too long")


def varint(value: int) -> bytes:
    out = bytearray()
    value &= 0xFFFFFFFFFFFFFFFF
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def zigzag(value: int) -> int:
    return (value << 1) ^ (value >> 63)


def unzigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def fields(data: bytes):
    """(number, wire type, value) of a message."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = read_varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = read_varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) != size:
                raise ValueError("message is cut off")
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, kind, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = read_varint(data, at)
        out.append(value)
    return out


def _entry(number: int, payload: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def decode_value(data: bytes):
    for number, _, value in fields(data):
        if number == 1:
            return str(value, "utf-8")
        if number == 2:
            return struct.unpack("<f", value)[0]
        if number == 3:
            return struct.unpack("<d", value)[0]
        if number in (4, 5):
            return value - (1 << 64) if number == 4 and value >= 1 << 63 else value
        if number == 6:
            return unzigzag(value)
        if number == 7:
            return bool(value)
    return None


def encode_value(value) -> bytes:
    if isinstance(value, bool):
        return varint(7 << 3) + varint(int(value))
    if isinstance(value, str):
        return _entry(1, value.encode())
    if isinstance(value, int):
        return varint(5 << 3) + varint(value) if value >= 0 else varint(6 << 3) + varint(zigzag(value))
    if isinstance(value, float):
        return varint(3 << 3 | 1) + struct.pack("<d", value)
    raise ValueError(f"no value of a vector tile: {value!r}")


def decode_geometry(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Parts of absolute points; a closed ring repeats its first point."""
    parts: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        command, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if command == 7:
            if not parts or not parts[-1]:
                raise ValueError("a ring is closed before it began")
            parts[-1].append(parts[-1][0])
            continue
        if command not in (1, 2) or at + 2 * count > len(commands):
            raise ValueError("malformed command stream")
        for _ in range(count):
            x, y = x + unzigzag(commands[at]), y + unzigzag(commands[at + 1])
            at += 2
            if command == 1:
                parts.append([(x, y)])
            elif parts:
                parts[-1].append((x, y))
            else:
                raise ValueError("a line without a start")
    return parts


def encode_geometry(parts: list[list[tuple[int, int]]], kind: int) -> list[int]:
    out: list[int] = []
    x = y = 0

    def move(points: list[tuple[int, int]], command: int) -> None:
        nonlocal x, y
        out.append(len(points) << 3 | command)
        for px, py in points:
            out.extend((zigzag(px - x), zigzag(py - y)))
            x, y = px, py

    if kind == POINT:
        move([p for part in parts for p in part], 1)
        return out
    for part in parts:
        body = part[:-1] if kind == POLYGON and part[0] == part[-1] else part
        move(body[:1], 1)
        if len(body) > 1:
            move(body[1:], 2)
        if kind == POLYGON:
            out.append(1 << 3 | 7)
    return out


def _feature(item, keys: list[str], values: list) -> dict:
    feature: dict = {"id": None, "kind": UNKNOWN, "parts": [], "props": {}, "error": None}
    tags: list[int] = []
    for n, _, value in fields(item):
        if n == 1:
            feature["id"] = value
        elif n == 2:
            tags = packed(value)
        elif n == 3:
            feature["kind"] = value
        elif n == 4:
            try:
                feature["parts"] = decode_geometry(packed(value))
            except (ValueError, IndexError) as error:
                feature["error"] = str(error)
    try:
        feature["props"] = {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}
    except (IndexError, ValueError):
        feature["error"] = "tags"
    return feature


def read_layers(data) -> Iterator[dict]:
    """Layers with name, extent, version (None where absent) and features of id, kind, parts, props, one at a time: features
    are decoded as they are read, before the next layer."""
    for number, _, body in fields(memoryview(data).cast("B")):
        if number != 3:
            continue
        layer: dict = {"name": "", "extent": None, "version": None}
        keys, values, raw = [], [], []
        for n, _, value in fields(body):
            if n == 1:
                layer["name"] = str(value, "utf-8")
            elif n == 2:
                raw.append(value)
            elif n == 3:
                keys.append(str(value, "utf-8"))
            elif n == 4:
                values.append(decode_value(value))
            elif n == 5:
                layer["extent"] = value
            elif n == 15:
                layer["version"] = value
        yield layer | {"features": (_feature(item, k, v) for k, v in ((keys, values),) for item in raw)}


def decode_tile(data: bytes) -> list[dict]:
    """All layers of a tile with all their features in lists."""
    return [layer | {"features": list(layer["features"])} for layer in read_layers(data)]


class LayerWriter:
    """A layer that takes its features one by one and keeps their bytes, not the features. Keys and values are numbered
    by rising frequency, then by value, so tags are kept by the order in which they came until all are known."""

    def __init__(self, name: str):
        self.name, self.keys, self.values = name, {}, {}
        self.key_uses, self.value_uses = array("Q"), array("Q")
        self.kept, self.ends, self.tags, self.tag_ends = bytearray(), array("Q"), array("I"), array("Q")

    @staticmethod
    def _number(known: dict, uses: array, what) -> int:
        at = known.setdefault(what, len(uses))
        if at == len(uses):
            uses.append(0)
        uses[at] += 1
        return at

    def add(self, id_: int | None, kind: int, parts: list, props: dict) -> None:
        for k, v in props.items():
            key = self._number(self.keys, self.key_uses, k)
            if v is not None:
                self.tags.append(key)
                self.tags.append(self._number(self.values, self.value_uses, encode_value(v)))
        self.tag_ends.append(len(self.tags))
        if isinstance(id_, int) and id_ >= 0:
            self.kept += varint(1 << 3) + varint(id_)
        self.ends.append(len(self.kept))
        self.kept += varint(3 << 3) + varint(kind) + _entry(4, b"".join(map(varint, encode_geometry(parts, kind))))
        self.ends.append(len(self.kept))

    @staticmethod
    def _order(known: dict, uses: array) -> tuple[list, list[bytes]]:
        """What is known in its final order, and the final number of each by the order in which it came."""
        listed = sorted(known.items(), key=lambda e: (uses[e[1]], e[0]))
        numbers: list = [b""] * len(listed)
        for i, (_, at) in enumerate(listed):
            numbers[at] = varint(i)
        return [k for k, _ in listed], numbers

    def done(self, extent: int | None, version: int | None) -> bytes:
        keys, key_numbers = self._order(self.keys, self.key_uses)
        values, value_numbers = self._order(self.values, self.value_uses)
        body = bytearray(_entry(1, self.name.encode()))
        at = tag = 0
        for i, tag_end in enumerate(self.tag_ends):
            middle, end = self.ends[2 * i], self.ends[2 * i + 1]
            tags = b"".join([key_numbers[t] if j % 2 == 0 else value_numbers[t] for j, t in enumerate(self.tags[tag:tag_end])])
            body += _entry(2, bytes(self.kept[at:middle]) + (_entry(2, tags) if tags else b"") + bytes(self.kept[middle:end]))
            at, tag = end, tag_end
        for k in keys:
            body += _entry(3, k.encode())
        for v in values:
            body += _entry(4, v)
        body += varint(5 << 3) + varint(extent or 4096) + varint(15 << 3) + varint(version or 1)
        return _entry(3, body)


def encode_tile(layers: list[dict]) -> bytes:
    """Keys and values are numbered by rising frequency, then by value."""
    out = bytearray()
    for layer in layers:
        writer = LayerWriter(layer["name"])
        for f in layer["features"]:
            writer.add(f["id"], f["kind"], f["parts"], f["props"])
        out += writer.done(layer["extent"], layer["version"])
    return bytes(out)


def ring_area(ring: list[tuple[float, float]]) -> float:
    """Twice the signed area of a closed ring."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def issues(layers: list[dict]) -> list[tuple[str, str, int]]:
    """(kind, layer, feature number or -1)."""
    return [i for some in layer_issues(layers) for i in some]


def layer_issues(layers) -> Iterator[list[tuple[str, str, int]]]:
    """The issues a few at a time, of layers and features that may be read only once."""
    out, seen = [], set()
    for layer in layers:
        name = layer["name"]
        out += [(k, name, -1) for k, v in (("MissingExtent", layer["extent"]), ("MissingVersion", layer["version"])) if v is None]
        if name in seen:
            out.append(("DuplicateLayerName", name, -1))
        seen.add(name)
        for i, f in enumerate(layer["features"]):
            if len(out) >= FEW:
                yield out
                out = []
            if f["error"]:
                out.append(("MalformedCommandStream", name, i))
            elif f["kind"] == UNKNOWN:
                out.append(("UnknownGeometryType", name, i))
            elif not any(len(p) >= (1 if f["kind"] == POINT else 2) for p in f["parts"]):
                out.append(("EmptyGeometryForType", name, i))
            elif f["kind"] == POLYGON:
                outer = False
                for ring in f["parts"]:
                    distinct = set(ring)
                    area = ring_area(ring)
                    if len(ring) < 4:
                        out.append(("TooFewVertices", name, i))
                    elif len(distinct) == 1:
                        out.append(("SubPixel", name, i))
                    elif area == 0:
                        out.append(("Collinear", name, i))
                    elif area > 0:
                        outer = True
                    elif not outer:
                        out.append(("OrphanInnerRing", name, i))
    yield out


def repair(layers: list[dict], drop_offenders: bool = False) -> list[dict]:
    """Defaults for extent and version, the first layer of a name, polygons without degenerate rings and
    with an outer ring first; features that cannot be decoded go with drop_offenders."""
    out, seen = [], set()
    for layer in layers:
        if layer["name"] in seen:
            continue
        seen.add(layer["name"])
        kept = []
        for f in layer["features"]:
            if f["error"] or f["kind"] == UNKNOWN:
                if not drop_offenders and not f["error"]:
                    kept.append(f)
                continue
            parts = f["parts"]
            if f["kind"] == POLYGON:
                parts = [r for r in parts if len(r) >= 4 and ring_area(r) != 0]
                if parts and ring_area(parts[0]) < 0:
                    parts = [r[::-1] for r in parts]
            parts = [p for p in parts if len(p) >= (1 if f["kind"] == POINT else 2)]
            if parts:
                kept.append({**f, "parts": parts})
        out.append({**layer, "extent": layer["extent"] or 4096, "version": layer["version"] or 1, "features": kept})
    return out


def each_row(data) -> Iterator[dict]:
    """Feature rows of a tile: layer, feat_no, id, kind, parts, props as JSON literals, extent and version of the layer."""
    for layer in read_layers(data):
        rest = {"extent": layer["extent"] or 4096, "version": layer["version"] or 1}
        for i, f in enumerate(layer["features"]):
            if not f["error"]:
                yield {"layer": layer["name"], "feat_no": i, "id": f["id"], "kind": f["kind"], "parts": [[list(p) for p in part] for part in f["parts"]], "props": {k: json.dumps(v, ensure_ascii=False) for k, v in f["props"].items()}, **rest}


def to_rows(data: bytes) -> list[dict]:
    return list(each_row(data))


def without_layers(data: bytes, names: set[str], invert: bool = False) -> bytes:
    """The tile without the named layers, or with invert without all others; what stays is not touched."""
    kept = []
    for number, _, body in fields(data):
        if number == 3:
            name = next((v.decode() for n, _, v in fields(body) if n == 1), "")
            if (name in names) == invert:
                kept.append(_entry(3, body))
    return b"".join(kept)


def layer_bytes(data: bytes) -> list[dict]:
    """For each layer: features, vertices and encoded bytes by what they hold; other is what is left."""
    out = []
    for number, _, body in fields(memoryview(data).cast("B")):
        if number != 3:
            continue
        s = dict.fromkeys(("features", "vertices", "geometry", "tags", "keys", "vals", "ids"), 0) | {"layer": "", "encoded": len(body)}
        for n, _, value in fields(body):
            if n == 1:
                s["layer"] = str(value, "utf-8")
            elif n == 2:
                s["features"] += 1
                for m, _, part in fields(value):
                    if m == 1:
                        s["ids"] += len(varint(part))
                    elif m == 2:
                        s["tags"] += len(part)
                    elif m == 4:
                        s["geometry"] += len(part)
                        try:
                            s["vertices"] += sum(map(len, decode_geometry(packed(part))))
                        except (ValueError, IndexError):
                            pass
            elif n in (3, 4):
                s["keys" if n == 3 else "vals"] += len(value)
        s["other"] = max(0, s["encoded"] - sum(s[k] for k in ("geometry", "tags", "keys", "vals", "ids")))
        out.append(s)
    return out
