"""Feeds of changed and deleted features as counts of tiles that go down as well as up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesselon.functions.coords import tile_x, tile_y
from tesselon.operators.stored import own_folder

#: How long a deleted key is remembered, so that an older version of it that comes late does not bring it back.
FORGET_MS = 7 * 24 * 3600 * 1000
_STATE = "version bigint, x bigint, y bigint, live boolean"
_DELTA = "x bigint, y bigint, delta int"


def _follow(forget_ms: int | None):
    """Keeps the last version of a key; gives back what it leaves and what it enters."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        last = before
        for batch in batches:
            batch = batch[batch["version"].notna()]
            if batch.empty:
                continue
            # Of versions that are the same the first in the order of tiles counts, a deletion before all.
            top = batch.sort_values(["version", "deleted", "x", "y"], ascending=[False, False, True, True]).iloc[0]
            if last is None or top["version"] > last[0]:
                gone = bool(top["deleted"]) or pd.isna(top["x"]) or pd.isna(top["y"])
                last = (int(top["version"]), 0 if gone else int(top["x"]), 0 if gone else int(top["y"]), not gone)
        if last is before:
            return
        state.update(last)
        if not last[3] and forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        moves = [(before[1], before[2], -1)] if before is not None and before[3] else []
        moves += [(last[1], last[2], 1)] if last[3] else []
        if len(moves) != 2 or moves[0][:2] != moves[1][:2]:
            yield pd.DataFrame(moves, columns=["x", "y", "delta"])

    return run


def tile_deltas(changes: DataFrame, level: int, forget_ms: int | None = FORGET_MS) -> DataFrame:
    """(x, y, delta) of a stream of changes (key, version, deleted, lon, lat): tiles of a level that a key leaves and enters.

    The state is a row for each key: the version that counts, the largest, and where it is. Older versions that come
    later change nothing. A change without a place deletes like ``deleted``; one without a key or version is left
    out. Deleted keys are forgotten after a time, by a timer; with None they never are."""
    at = changes.where("key IS NOT NULL AND version IS NOT NULL")
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    at = at.select("key", "version", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.when(placed, tile_x("lon", F.lit(level))).alias("x"), F.when(placed, tile_y("lat", F.lit(level))).alias("y"))
    timer = GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return at.groupBy("key").applyInPandasWithState(_follow(forget_ms), _DELTA, _STATE, "append", timer)


def follow_counts(changes: DataFrame, level: int, log: str, checkpoint: str | None = None, forget_ms: int | None = FORGET_MS, available_now: bool = True) -> StreamingQuery:
    """Writes what each batch adds to or takes from the tiles of all levels up to ``level`` to a folder of the log. A batch
    that is tried again overwrites its own folder, so each counts once. A run over what is available has no timers, with
    which it would wait for ever; deleted keys are remembered then."""

    def add(batch: DataFrame, number: int) -> None:
        moved = batch.groupBy("x", "y").agg(F.sum("delta").alias("delta")).where("delta <> 0")
        up = moved.select(F.explode(F.sequence(F.lit(0), F.lit(level))).alias("z"), "x", "y", "delta")
        cells = [F.expr(f"shiftright({c}, {level} - z)").alias(c) for c in ("x", "y")]
        each = up.select("z", *cells, "delta").groupBy("z", "x", "y").agg(F.sum("delta").alias("delta")).where("delta <> 0")
        each.withColumn("z", F.col("z").cast("bigint")).write.mode("overwrite").parquet(f"{log}/batch={number}")

    writer = tile_deltas(changes, level, None if available_now else forget_ms).writeStream.foreachBatch(add).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint or f"{log}-state")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counts(spark: SparkSession, log: str) -> DataFrame:
    """(z, x, y, n): the tiles that hold features now."""
    moved = spark.read.schema("z bigint, x bigint, y bigint, delta bigint").parquet(f"{log}/batch=*")
    return moved.groupBy("z", "x", "y").agg(F.sum("delta").alias("n")).where("n <> 0")


def new_log(spark: SparkSession) -> str:
    """A folder for a log, and one within it for the stream's own state, that go when the program ends."""
    return f"{own_folder(spark)}/log"
