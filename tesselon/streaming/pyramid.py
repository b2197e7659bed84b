"""Change feeds of points as streaming tile counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesselon.functions.coords import tile_x, tile_y


def tile_counts(points: DataFrame, levels: range, time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of points (lon, lat) by tile; with a time column by window too, with late points up to a watermark."""
    rows = points.withWatermark(time, late) if time else points
    rows = rows.withColumn("z", F.explode(F.sequence(F.lit(levels.start).cast("bigint"), F.lit(levels.stop - 1).cast("bigint"))))
    keys = [F.col("z"), tile_x("lon", "z").alias("x"), tile_y("lat", "z").alias("y")]
    return rows.groupBy(*([F.window(time, window).alias("window")] if time else []), *keys).agg(F.count(F.lit(1)).alias("n"))


def apply_to_feed(feed: DataFrame, change: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs an operator on every batch of a feed of tiles and hands the result on; available data only."""
    return feed.writeStream.foreachBatch(lambda df, n: sink(change(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
