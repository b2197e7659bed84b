"""Converting and probing tilesets: functions, and a command line for spark-submit."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.operators import general, reports, tiles
from tesselon.plans.tileset import TileSet
from tesselon.plans.vpl import run_vpl
from tesselon.sources import containers


def open_source(spark: SparkSession, source: str) -> TileSet:
    """A container's path, or a pipeline after ``vpl:``."""
    return run_vpl(spark, source[4:]) if source.startswith("vpl:") else run_vpl(spark, f'from_container filename="{source}"')


def convert(
    spark: SparkSession,
    source: str,
    target: str,
    min_zoom: int | None = None,
    max_zoom: int | None = None,
    bbox: tuple[float, float, float, float] | None = None,
    bbox_border: int | None = None,
    flip_y: bool = False,
    swap_xy: bool = False,
    compress: str = "none",
) -> None:
    s = open_source(spark, source)
    kept = general.filter_tiles(s.relation, bbox, bbox_border, min_zoom, max_zoom)
    if flip_y or swap_xy:
        kept = general.remap_coords(kept, flip_y=flip_y, swap_xy=swap_xy)
    known = s.tilejson
    if bbox:
        old = known.bounds or containers.WORLD_BOUNDS
        known = replace(known, center=None, bounds=(max(old[0], bbox[0]), max(old[1], bbox[1]), min(old[2], bbox[2]), min(old[3], bbox[3])))
    limits = {"minzoom": (max, min_zoom), "maxzoom": (min, max_zoom)}
    known = replace(known, **{k: v if getattr(known, k) is None else pick(getattr(known, k), v) for k, (pick, v) in limits.items() if v is not None})
    out = containers.recompress(s.then(kept, "convert").tiles, s.compression, compress)
    containers.write_container(out, target, s.format, compress, {**known.to_dict(), "format": s.format})


def probe(source: TileSet, depth: int = 1) -> dict[str, DataFrame]:
    """Reports of a tileset: its pyramid; from depth 2 the sizes; from depth 3 the layers and what is wrong."""
    sized = source.tiles.select("z", "x", "y", F.octet_length("data").cast("bigint").alias("size"))
    out = {"pyramid": general.pyramid_summary(source.tiles), "count": reports.count_tiles(source.tiles)}
    if depth >= 2:
        out |= {"sizes": reports.size_stats(sized), "biggest": reports.biggest_tiles(sized)}
    if depth >= 3 and source.is_vector:
        found = tiles.validate(source.tiles)
        out |= {"layers": tiles.layer_bytes(source.tiles), "issues": found.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("z", "x", "y").alias("tiles"))}
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    for name, kind in (("--min-zoom", int), ("--max-zoom", int), ("--bbox-border", int)):
        parser.add_argument(name, type=kind)
    parser.add_argument("--bbox", type=lambda s: tuple(float(v) for v in s.split(",")))
    parser.add_argument("--flip-y", action="store_true")
    parser.add_argument("--swap-xy", action="store_true")
    parser.add_argument("--compress", default="none", choices=("none", "gzip", "zstd"))
    given = parser.parse_args(args)
    convert(SparkSession.builder.getOrCreate(), **vars(given))


if __name__ == "__main__":
    main()
