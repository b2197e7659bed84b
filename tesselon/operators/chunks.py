"""Reads that are put together under a limit of their size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.operators.stored import forget, maybe_broadcast, store

#: Fixed defaults: the largest chunk, and the gap that still joins two ranges.
MAX_CHUNK, MAX_GAP = 64 << 20, 256 << 10
#: The least part of the file, in largest chunks, and the rows up to which such parts are put together: what one task goes through in order.
PART_CHUNKS, PART_ROWS = 16, 1 << 17


def next_starts(starts: np.ndarray, stops: np.ndarray, most: int, gap: int) -> np.ndarray:
    """For each range, in order, the first one behind it that a chunk which it opens does not take; len(starts) if none."""
    n = len(starts)
    # The first that ends too far from the opening: a range as long as a chunk always, a shorter one never before its own place.
    long = stops - starts >= most
    reach = np.maximum.accumulate(np.where(long, np.iinfo(np.int64).min, stops))
    places = np.append(np.flatnonzero(long), n)
    size = np.minimum(np.searchsorted(reach, starts + most), places[np.searchsorted(places[:-1], np.arange(n), "right")])
    # The first that lies too far behind all before it: what a range reaches itself, carried on by those it reaches.
    alone = np.searchsorted(starts, stops + gap).tolist()
    wide = [n] * n
    for i in range(n - 1, -1, -1):
        at = i + 1
        while at < alone[i]:
            at = wide[at]
        wide[i] = at
    return np.minimum(size, wide)


def read_chunks(ranges: DataFrame, most: int = MAX_CHUNK, gap: int = MAX_GAP, part_chunks: int = PART_CHUNKS, part_rows: int = PART_ROWS) -> DataFrame:
    """(offset, length, ranges): byte ranges (offset, length) in the chunks in which they are read.

    In order of offset and length a range joins the chunk before it if it ends less than ``most`` bytes behind the
    chunk's start and begins less than ``gap`` bytes behind the chunk's end; otherwise it opens one. A longer
    range than that opens one always. Rows with a null go; an empty table gives no rows.

    Where a chunk begins depends on all before it, so parts of the file are followed from every range at which
    one can be entered: those less than ``most`` bytes from its start. These ways from entry to entry are put
    together by doubling, a join a round, until each part's entry from the first range on is known; then all parts
    are cut at once. A part holds at least ``part_chunks`` * ``most`` bytes and, where that is fewer, goes on up to
    ``part_rows`` rows, so that parts grow with the rows and not with the file. Equal ranges are one row with a count.
    """
    span = max(1, part_chunks) * most
    piece = F.expr(f"(offset - pmod(offset, {span})) div {span}")
    each = ranges.where("offset IS NOT NULL AND length IS NOT NULL").groupBy("offset", (F.col("offset") + F.col("length")).alias("stop")).agg(F.count(F.lit(1)).alias("n"))
    rows = store(each.select(piece.alias("piece"), "offset", "stop", "n"))

    def together(batches):
        part, held = None, 0
        for batch in batches:
            parts = []
            for place, n in zip(batch["piece"].tolist(), batch["rows"].tolist(), strict=True):
                if part is None or held + n > part_rows:
                    part, held = place, 0
                held += n
                parts.append(part)
            yield pd.DataFrame({"piece": batch["piece"], "part": parts})

    # A part is named by its first piece. Neighbours are put together within ranges of pieces, each in order.
    pieces = rows.groupBy("piece").agg(F.count(F.lit(1)).alias("rows")).repartitionByRange("piece").sortWithinPartitions("piece")
    pieces = store(pieces.mapInPandas(together, "piece bigint, part bigint"))
    near = F.col("offset") < F.col("part") * span + most
    at = F.struct("offset", "stop")
    parts = rows.join(maybe_broadcast(pieces, 16), "piece").groupBy("part").agg(F.min(at).alias("head"), F.min(F.when(~near, at)).alias("beyond"))
    later = Window.orderBy("part")
    # The first range behind those that a part sees: its own, and of the next part what lies within a chunk's size.
    follows = F.coalesce(F.lead("beyond").over(later), F.lead("head", 2).over(later))
    parts = store(parts.select("part", "beyond", F.lag("part").over(later).alias("before"), follows.alias("after")))
    ends = parts.select("part", F.col("after.offset").alias("after_offset"), F.col("after.stop").alias("after_stop"), F.col("beyond.offset").alias("b_offset"), F.col("beyond.stop").alias("b_stop"))
    pieces = store(pieces.join(parts.select("part", "before"), "part"))
    own = F.struct("part", F.lit(True).alias("own"))
    halo = F.when(near & F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(False).alias("own")))
    seen = rows.join(maybe_broadcast(pieces, 24), "piece").select("offset", "stop", "n", F.explode(F.array_compact(F.array(own, halo))).alias("of")).select("of.part", "of.own", "offset", "stop", "n")

    def in_order(group: pd.DataFrame) -> tuple:
        group = group.sort_values(["offset", "stop"], kind="stable")
        starts, stops = group["offset"].to_numpy(np.int64), group["stop"].to_numpy(np.int64)
        return starts, stops, group["own"].to_numpy(bool), group["n"].to_numpy(np.int64), next_starts(starts, stops, most, gap)

    def ways(key: tuple, group: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        starts, stops, own, _, jump = in_order(group)
        n, end = len(group), {c: ends[c].iloc[0] for c in ends}
        stays, exit_ = np.append(own, False)[jump].tolist(), jump.tolist()
        for i in range(n - 1, -1, -1):
            if stays[i]:
                exit_[i] = exit_[exit_[i]]
        at = np.flatnonzero(own & ((starts < key[0] * span + most) | (np.arange(n) == np.argmax(own)) | (starts == end["b_offset"]) & (stops == end["b_stop"])))
        to = np.array(exit_, np.int64)[at]
        last = pd.isna(end["after_offset"])
        known = to < n
        offset = pd.array(np.where(known, starts[np.minimum(to, n - 1)], 0 if last else int(end["after_offset"])), "Int64")
        stop = pd.array(np.where(known, stops[np.minimum(to, n - 1)], 0 if last else int(end["after_stop"])), "Int64")
        if last:
            offset[~known] = stop[~known] = pd.NA
        return pd.DataFrame({"offset": starts[at], "stop": stops[at], "to_offset": offset, "to_stop": stop})

    way = seen.groupBy("part").cogroup(ends.groupBy("part")).applyInPandas(ways, "offset bigint, stop bigint, to_offset bigint, to_stop bigint")
    way = store(way.where("to_offset IS NOT NULL"))
    entered = store(rows.orderBy("offset", "stop").limit(1).select("offset", "stop"))
    for _ in range(max(1, parts.count()).bit_length()):
        step = way.join(maybe_broadcast(entered, 16), ["offset", "stop"]).select(F.col("to_offset").alias("offset"), F.col("to_stop").alias("stop"))
        more = store(entered.unionByName(step).distinct())
        second = way.select(F.col("offset").alias("to_offset"), F.col("stop").alias("to_stop"), F.col("to_offset").alias("o"), F.col("to_stop").alias("s"))
        twice = store(way.join(second, ["to_offset", "to_stop"]).select("offset", "stop", F.col("o").alias("to_offset"), F.col("s").alias("to_stop")))
        for old in (entered, way):
            forget(old)
        entered, way = more, twice
    entry = entered.withColumn("piece", piece).join(pieces, "piece").select("part", F.col("offset").alias("e_offset"), F.col("stop").alias("e_stop"))

    def cut(group: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        # A part without an entry was taken whole by a chunk of the part before.
        out = {"offset": [], "length": [], "ranges": []}
        if len(entry):
            starts, stops, own, copies, jump = in_order(group)
            (at,) = np.flatnonzero(own & (starts == entry["e_offset"].iloc[0]) & (stops == entry["e_stop"].iloc[0]))
            following, owned, opened = jump.tolist(), own.tolist(), []
            while at < len(owned) and owned[at]:
                opened.append(at)
                at = following[at]
            opened = np.array(opened)
            # A range as long as a chunk is read anew for each of its copies.
            alone = np.where(stops[opened] - starts[opened] >= most, copies[opened] - 1, 0)
            again = np.repeat(opened, alone)
            out["offset"] = np.append(starts[opened], starts[again])
            out["length"] = np.append(np.maximum.reduceat(stops[:at], opened) - starts[opened], stops[again] - starts[again])
            out["ranges"] = np.append(np.add.reduceat(copies[:at], opened) - alone, np.ones(len(again), np.int64))
        return pd.DataFrame(out, dtype=np.int64)

    return seen.groupBy("part").cogroup(entry.groupBy("part")).applyInPandas(cut, "offset bigint, length bigint, ranges bigint")
