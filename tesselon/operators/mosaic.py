"""Assembly of one tileset from sources that overlap, without a look at pixels that cannot be seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.operators.stored import maybe_broadcast, private_names, store

KEY = ["z", "x", "y"]
#: Sums of two alphas from here on count as opaque: what is missing is rounding.
NEARLY_OPAQUE = 250


def blend_additive(base: Column, top: Column) -> Column:
    """A pixel (r, g, b, a) of whole numbers behind another: alphas add up, colours count by their share of the sum."""
    total = base["a"] + top["a"]
    out = F.when(total >= NEARLY_OPAQUE, 255).otherwise(total)
    share = lambda c: F.least(F.lit(255), F.floor((base[c] * (out - top["a"]) + top[c] * top["a"] + F.floor(out / 2)) / out)).cast("int").alias(c)
    nothing = F.struct(*[F.lit(0).alias(c) for c in "rgba"])
    return F.when(total == 0, nothing).otherwise(F.struct(*[share(c) for c in "rgb"], out.cast("int").alias("a")))


def assemble(tiles: DataFrame) -> DataFrame:
    """(z, x, y, pixels) of tiles (z, x, y, source, pixels): pixels are an array of (r, g, b, a), all of a tile alike long.

    A tile that some source has opaque is that of the first such source, whatever lies before it. Other tiles are
    the sources' translucent ones, one behind the other, the first in front; empty ones say nothing. Of rows that share a tile
    and a source one counts. First the classes of tiles are found where they are, and of the opaque ones only keys are
    shuffled; translucent pixels are shuffled only for tiles that are not settled so, a row for each source of a tile.
    """
    opaque_name, place = private_names(tiles.columns, "opaque", "first")
    shown = tiles.where(F.exists("pixels", lambda p: p["a"] > 0)).withColumn(opaque_name, F.forall("pixels", lambda p: p["a"] == 255))
    solid = shown.where(opaque_name)
    settled = store(solid.groupBy(KEY).agg(F.min("source").alias(place)))
    chosen = maybe_broadcast(settled, 40)
    front = solid.join(chosen, KEY).where(F.col("source") == F.col(place)).groupBy(KEY).agg(F.min("pixels").alias("pixels"))
    rest = shown.where(~F.col(opaque_name)).join(chosen.select(KEY), KEY, "left_anti")
    rest = rest.groupBy(*KEY, "source").agg(F.min("pixels").alias("pixels"))
    layers = rest.groupBy(KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("source", "pixels"))), lambda s: s["pixels"]).alias("layers"))
    plain = lambda pixels: F.transform(pixels, lambda p: F.struct(*[p[c].cast("int").alias(c) for c in "rgba"]))
    behind = F.aggregate(F.slice("layers", 2, 1 << 30), plain(F.element_at("layers", 1)), lambda top, base: F.zip_with(top, plain(base), lambda t, b: blend_additive(b, t)))
    return front.select(*KEY, plain(F.col("pixels")).alias("pixels")).unionByName(layers.select(*KEY, behind.alias("pixels")))
