"""Operators on image tiles (z, x, y, data BINARY, PNG). Pixels are worked on in Arrow batches, one tile a row."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.functions import geometry as G
from tesselon.functions import png as P
from tesselon.functions.coords import WORLD, ancestor
from tesselon.operators.levels import overscale, parent_of

KEY = ["z", "x", "y"]


def map_images(tiles: DataFrame, change: Callable[[np.ndarray, tuple[int, int, int]], np.ndarray | None]) -> DataFrame:
    """Applies a function to each image; tiles for which it gives None go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data, z, x, y in zip(batch["data"], batch["z"], batch["x"], batch["y"], strict=True):
                image = change(P.decode_png(bytes(data)), (int(z), int(x), int(y)))
                out.append(None if image is None else P.encode_png(image))
            yield batch.assign(data=out)[[o is not None for o in out]]

    return tiles.mapInPandas(run, tiles.schema)


def flatten(tiles: DataFrame, color=(255, 255, 255)) -> DataFrame:
    return map_images(tiles, lambda image, _: P.flatten(image, color))


def adjust_levels(tiles: DataFrame, brightness: float = 0.0, contrast: float = 1.0, gamma: float = 1.0) -> DataFrame:
    return map_images(tiles, lambda image, _: P.adjust(image, brightness, contrast, gamma))


def dem_quantize(tiles: DataFrame, elevation_error: float = 0.1, slope_error: float = 1.0, encoding: str = "mapbox") -> DataFrame:
    """Clears low bits that neither error bound needs, by the ground size of the tile's pixels."""
    from tesselon.functions.values import raw_unit

    unit = raw_unit(encoding)

    def change(image: np.ndarray, key: tuple[int, int, int]) -> np.ndarray:
        z, _, y = key
        lat = 2 * math.atan(math.exp(math.pi * (1 - 2 * (y + 0.5) / 2**z))) - math.pi / 2
        pixel = math.cos(lat) * WORLD / 2**z / 256
        step = min(elevation_error * pixel, pixel * math.tan(math.radians(slope_error))) / unit
        bits = min(24, int(math.log2(step + 1))) if step >= 1 else 0
        raw = P.dem_raw(image)
        raw = np.minimum(raw + ((1 << bits) >> 1), 0xFFFFFF) & ~((1 << bits) - 1)
        rest = [image[..., 3]] if P.has_alpha(image) else []
        return np.stack([raw >> 16, raw >> 8 & 255, raw & 255, *rest], axis=2).astype(np.uint8)

    return map_images(tiles, change)


def reencode(tiles: DataFrame, effort: int = 6) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(data=[P.encode_png(P.decode_png(bytes(d)), effort) for d in batch["data"]])

    return tiles.mapInPandas(run, tiles.schema)


def mask(tiles: DataFrame, rings: list[list[tuple[float, float]]], buffer: float = 0.0, blur: float = 0.0, blur_function: str = "linear") -> DataFrame:
    """Keeps what lies in a polygon of closed Mercator rings, grown by ``buffer`` metres and fading over
    ``blur`` metres. Tiles wholly inside pass as they are, those wholly outside go."""
    if blur_function not in ("linear", "cosine"):
        raise ValueError("blur_function is linear or cosine")
    edges = np.concatenate([np.hstack([p[:-1], p[1:]]) for p in (np.asarray(r, float) for r in rings)])
    far = abs(buffer) + max(0.0, blur)
    reach = (edges[:, [0, 2]].min() - far, edges[:, [1, 3]].min() - far, edges[:, [0, 2]].max() + far, edges[:, [1, 3]].max() + far)

    def change(image: np.ndarray, key: tuple[int, int, int]) -> np.ndarray | None:
        box = G.tile_box(*key)
        if box[2] < reach[0] or box[0] > reach[2] or box[3] < reach[1] or box[1] > reach[3]:
            return None
        middle, half = ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2), (box[2] - box[0]) / math.sqrt(2)
        if G.edges_distance(*middle, edges) > half + far:  # no edge comes near
            return image if G.inside_rows(np.array(middle[:1]), np.array(middle[1:]), edges)[0, 0] else None
        size = image.shape[0]
        unit = (box[2] - box[0]) / size
        xs, ys = box[0] + (np.arange(size) + 0.5) * unit, box[3] - (np.arange(size) + 0.5) * unit
        inside = G.inside_rows(xs, ys, edges)
        if far > 0:
            edge = G.near_distances(xs, ys, edges, far + unit)
            depth = np.where(inside, edge, -edge)
            t = np.clip((depth + buffer + blur / 2) / blur, 0, 1) if blur > 0 else (depth >= -buffer).astype(float)
        else:
            t = inside.astype(float)
        alpha = t if blur_function == "linear" or blur <= 0 else (1 - np.cos(np.pi * t)) / 2
        out = P.to_rgba(image)
        out[..., 3] = (out[..., 3] * np.round(alpha * 255).astype(np.int64) // 255).astype(np.uint8)
        return None if P.is_empty(out) else out

    return map_images(tiles, change)


def stack_images(sources: list[DataFrame], native: str | None = None) -> DataFrame:
    """Alpha compositing, earlier sources in front. Drawing ends at an opaque image; empty ones are skipped.
    With ``native``, a boolean column, tiles that no source has natively are left out."""
    rows = None
    for i, s in enumerate(sources):
        part = s.select(*KEY, F.lit(i).alias("rank"), "data", (F.col(native) if native else F.lit(True)).alias("native"))
        rows = part if rows is None else rows.unionByName(part)
    # A tile has one row for each source at most: the group is bounded by their number.
    grouped = rows.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "data"))).alias("parts"), F.bool_or("native").alias("native")).where("native")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for parts in batch["parts"]:
                whole = None
                for part in parts:
                    image = P.decode_png(bytes(part["data"]))
                    if P.is_empty(image):
                        continue
                    image = P.to_rgba(image)
                    whole = image if whole is None else P.overlay(whole, image)
                    if P.is_opaque(whole):
                        break
                out.append(None if whole is None else P.encode_png(whole[..., :3] if P.is_opaque(whole) else whole))
            yield batch[KEY].assign(data=out)[[o is not None for o in out]]

    return grouped.mapInPandas(run, "z long, x long, y long, data binary")


def overview(tiles: DataFrame, level: int, dem: bool = False) -> DataFrame:
    """Levels 0 to ``level``: each image is made of the four below it, halved; missing ones are transparent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for parts in batch["parts"]:
                images = {int(p["place"]): P.decode_png(bytes(p["data"])) for p in parts}
                size = next(iter(images.values())).shape[0]
                alpha = len(images) < 4 or any(P.has_alpha(i) for i in images.values())
                whole = np.zeros((2 * size, 2 * size, 4), np.uint8)
                for place, image in images.items():
                    whole[place // 2 * size : (place // 2 + 1) * size, place % 2 * size : (place % 2 + 1) * size] = P.to_rgba(image)
                small = (P.dem_halve if dem else P.halve)(whole if alpha else whole[..., :3])
                out.append(P.encode_png(small))
            yield batch[KEY].assign(data=out)

    now = tiles.where(F.col("z") == level).select(*KEY, "data")
    out = now
    for _ in range(level):
        placed = now.withColumn("place", (F.col("x") % 2 + F.col("y") % 2 * 2).cast("int"))
        now = parent_of(placed).groupBy(KEY).agg(F.collect_list(F.struct("place", "data")).alias("parts")).mapInPandas(run, "z long, x long, y long, data binary")
        out = out.unionByName(now)
    return out


def overscaled(wanted: DataFrame, tiles: DataFrame, level_base: int, climbing: bool = False) -> DataFrame:
    """Images of wanted tiles below level_base, enlarged from their ancestor there; with climbing from the
    nearest ancestor at or above it that there is."""
    from tesselon.operators.levels import climb

    joined = (climb if climbing else overscale)(wanted, tiles.select(*KEY, "data"), level_base)
    size = F.pow(F.lit(2.0), F.col("z") - F.col("source_z")).cast("bigint")
    joined = joined.withColumns({"sub_x": F.pmod("x", size), "sub_y": F.pmod("y", size)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                steps = int(r.z - r.source_z)
                out.append(bytes(r.data) if steps == 0 else P.encode_png(P.enlarge(P.decode_png(bytes(r.data)), steps, int(r.sub_x), int(r.sub_y))))
            yield batch[KEY].assign(data=out)

    return joined.mapInPandas(run, "z long, x long, y long, data binary")


def resize(tiles: DataFrame, tile_size: int, dem: bool = False) -> DataFrame:
    """512 to 256: four tiles one level down, level 0 also halved; 256 to 512: four tiles as one a level up."""
    if tile_size == 256:

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for r in batch.itertuples():
                    image = P.decode_png(bytes(r.data))
                    h = image.shape[0] // 2
                    rows += [(r.z + 1, 2 * r.x + i, 2 * r.y + j, P.encode_png(image[j * h : (j + 1) * h, i * h : (i + 1) * h])) for j in (0, 1) for i in (0, 1)]
                    if r.z == 0:
                        rows.append((0, 0, 0, P.encode_png((P.dem_halve if dem else P.halve)(image))))
                yield pd.DataFrame(rows, columns=[*KEY, "data"])

        return tiles.select(*KEY, "data").mapInPandas(cut, "z long, x long, y long, data binary")
    if tile_size != 512:
        raise ValueError("tile_size is 256 or 512")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for parts in batch["parts"]:
                images = {int(p["place"]): P.to_rgba(P.decode_png(bytes(p["data"]))) for p in parts}
                size = next(iter(images.values())).shape[0]
                whole = np.zeros((2 * size, 2 * size, 4), np.uint8)
                for place, image in images.items():
                    whole[place // 2 * size : (place // 2 + 1) * size, place % 2 * size : (place % 2 + 1) * size] = image
                out.append(P.encode_png(whole[..., :3] if P.is_opaque(whole) else whole))
            yield batch[KEY].assign(data=out)

    placed = tiles.where("z > 0").withColumn("place", (F.col("x") % 2 + F.col("y") % 2 * 2).cast("int"))
    up = placed.withColumns({"x": ancestor("x", F.lit(1)), "y": ancestor("y", F.lit(1)), "z": F.col("z") - 1})
    return up.groupBy(KEY).agg(F.collect_list(F.struct("place", "data")).alias("parts")).mapInPandas(join, "z long, x long, y long, data binary")


def stack_overscaled(sources: list[DataFrame], level_max: int | None = None) -> DataFrame:
    """``stack_images`` of sources of different depth: a source that lacks a tile lends its nearest
    ancestor, enlarged; tiles that no source has natively are left out."""
    from tesselon.operators.levels import climb

    keys = sources[0].select(KEY)
    for s in sources[1:]:
        keys = keys.union(s.select(KEY))
    keys = keys.distinct() if level_max is None else keys.where(F.col("z") <= level_max).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                steps = int(r.z - r.source_z)
                inside = (1 << steps) - 1
                out.append(bytes(r.data) if steps == 0 else P.encode_png(P.enlarge(P.decode_png(bytes(r.data)), steps, int(r.x) & inside, int(r.y) & inside)))
            yield batch[KEY].assign(data=out, native=batch["z"] == batch["source_z"])

    lent = [climb(keys, s.select(*KEY, "data"), 30).mapInPandas(run, "z long, x long, y long, data binary, native boolean") for s in sources]
    return stack_images(lent, native="native")


def corner_colors(tiles: DataFrame) -> DataFrame:
    """(z, x, y, first, last): the first and last pixel of each image as hexadecimal digits, opacity included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = [P.decode_png(bytes(data)) for data in batch["data"]]
            text = lambda v: "".join(f"{int(c):02x}" for c in (list(v) + [255] * (4 - len(v)) if len(v) >= 3 else [v[0]] * 3 + [v[1] if len(v) > 1 else 255]))
            yield batch[["z", "x", "y"]].assign(first=[text(i[0, 0]) for i in images], last=[text(i[-1, -1]) for i in images])

    return tiles.select("z", "x", "y", "data").mapInPandas(run, "z long, x long, y long, first string, last string")
