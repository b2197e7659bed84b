"""Substring dedup: Rabin-Karp hashes of every word window, counted in Spark, merged into removal intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm._shared import forget, private_names, store
from tesselon.llm._text import Hasher, slices, utf8

#: Windows held at once by a task that matches them.
FLUSH_WINDOWS = 1 << 20
#: Bytes of text within which a map task settles windows that it holds more than once.
SHIP_BYTES = 1 << 21
#: Windows of an anchor beyond which each is dealt by its own hash, at least, and such anchors at most.
HOT_WINDOWS, MOST_HOT = 1 << 20, 1 << 20
#: Words of the short grams whose smallest hash in a window is the window's anchor.
ANCHOR_WORDS = 10
_SCHEMA = "anchor long, doc_id long, text_key long, start int, runs int, hashes binary"


def _runs(flags: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags with consecutive indexes along which ``same`` do not change."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    for x in same:
        new[1:] |= x[at[1:]] != x[at[:-1]]
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1]


def _earlier_copies(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Marks entries whose hash also occurs with a smaller id."""
    if not len(hashes):
        return np.zeros(0, bool)
    order = np.lexsort((ids, hashes))
    h, d = hashes[order], ids[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(h), bool)
    out[order] = d > least
    return out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of values[i : i + width] for each i, with log2(width) passes."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _windows(hasher: Hasher, batch: pa.RecordBatch, window: int, column: str) -> tuple[np.ndarray, ...]:
    """(row, first word, hash, anchor, whether a smaller doc_id of this batch also has it) of each window."""
    words = hasher.words(batch.column(batch.schema.get_field_index(column)), lower=False)
    row, pos, hashes = hasher.windows(words, window)
    if not len(row):
        return row, pos, hashes, row, row.astype(bool)
    # Equal windows have equal grams, hence equal anchors: the smallest gram hash inside.
    gram = min(ANCHOR_WORDS, window)
    grams = hasher.spans(words.hashes, np.arange(len(words.hashes) - gram + 1), np.arange(gram, len(words.hashes) + 1))
    anchors = _sliding_min(grams, window - gram + 1)[words.first[:-1][row] + pos].view(np.int64)
    ids = np.asarray(batch.column(batch.schema.get_field_index("doc_id")))
    return row, pos, hashes, anchors, _earlier_copies(hashes, ids[row])


def _anchor_sizes(window: int, column: str):
    """For each slice how many windows of each anchor it would ship."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, column, SHIP_BYTES):
            _, _, _, anchors, gone = _windows(hasher, batch, window, column)
            keys, n = np.unique(anchors[~gone], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return run


def hot_anchors(docs: DataFrame, window: int, column: str) -> np.ndarray:
    """Sorted anchors whose windows are too many for one task: phrases that many different passages share. There
    are at most MOST_HOT, since each has at least a MOST_HOT-th of all windows, or HOT_WINDOWS."""
    sizes = docs.select("doc_id", column).mapInArrow(_anchor_sizes(window, column), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_WINDOWS)
    sizes = store(sizes)
    least = max(HOT_WINDOWS, int(sizes.select(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // MOST_HOT)
    hot = sizes.where(F.col("n") > least).select("anchor").toArrow().column(0).to_numpy()
    forget(sizes)
    return np.sort(hot)


def _ship_windows(window: int, column: str, hot):
    """For each task: windows with an earlier copy in the same slice become removal runs at once
    (anchor null); one row for each other run of windows that share an anchor goes on, and one for each
    window of a hot anchor, with the window's own hash in the anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, column, SHIP_BYTES):
            row, pos, hashes, anchors, gone = _windows(hasher, batch, window, column)
            if not len(row):
                continue
            if len(hot.value):
                split = hot.value[np.minimum(np.searchsorted(hot.value, anchors), len(hot.value) - 1)] == anchors
                anchors = np.where(split, hashes.view(np.int64), anchors)
            ids = np.asarray(batch.column(batch.schema.get_field_index("doc_id")))
            keys = np.asarray(batch.column(batch.schema.get_field_index("text_key")))
            a0, a1 = _runs(gone, row)
            b0, b1 = _runs(~gone, row, anchors)
            blob = hashes.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.nulls(len(a0), pa.int64()), pa.array(anchors[b0])]),
                    pa.array(np.concatenate([ids[row[a0]], ids[row[b0]]])),
                    pa.array(np.concatenate([keys[row[a0]], keys[row[b0]]])),
                    pa.array(np.concatenate([pos[a0], pos[b0]]).astype(np.int32)),
                    pa.array(np.concatenate([a1 - a0, b1 - b0]).astype(np.int32) + np.int32(1)),
                    pa.array([b""] * len(a0) + [blob[8 * i : 8 * j + 8] for i, j in zip(b0.tolist(), b1.tolist(), strict=True)], pa.binary()),
                ],
                names=["anchor", "doc_id", "text_key", "start", "runs", "hashes"],
            )

    return run


def _match_windows(window: int):
    """Rows arrive sorted by anchor and doc_id: the first copy of a window is the one that stays.
    Emits removal runs. Held at once: FLUSH_WINDOWS, and the distinct windows of the anchor that goes on."""

    def removed(parts: list[pa.RecordBatch], seen: tuple) -> tuple[pa.RecordBatch, tuple]:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, keys, start, n = (np.asarray(table.column(c).combine_chunks()) for c in ("doc_id", "text_key", "start", "runs"))
        local = np.asarray(table.column("anchor").is_null())
        anchors = np.asarray(table.column("anchor").fill_null(0).combine_chunks())
        size = np.where(local, 0, n)
        row = np.repeat(np.arange(len(n)), size)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + start[row]
        _, data = utf8(table.column("hashes").combine_chunks())
        hashes = np.concatenate([seen[1], np.frombuffer(data.tobytes(), np.uint64)])
        owner = np.concatenate([seen[2], ids[row]])
        gone = _earlier_copies(hashes, owner)[len(seen[1]) :]
        a0, a1 = _runs(gone, row)
        first = np.concatenate([start[local], pos[a0]])
        last = np.concatenate([(start + n)[local] - 1, pos[a1]]) + window
        who = np.concatenate([np.flatnonzero(local), row[a0]])
        out = pa.RecordBatch.from_arrays(
            [pa.array(ids[who]), pa.array(keys[who]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
            names=["doc_id", "text_key", "first", "last"],
        )
        if local[-1]:
            return out, seen
        goes_on = np.concatenate([np.full(len(seen[1]), seen[0] == anchors[-1]), (anchors == anchors[-1])[row]])
        order = np.lexsort((owner[goes_on], hashes[goes_on]))
        left, at = np.unique(hashes[goes_on][order], return_index=True)
        return out, (anchors[-1], left, owner[goes_on][order][at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        amount, seen = 0, (None, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            amount += int(np.asarray(batch.column(batch.schema.get_field_index("runs"))).sum())
            if amount >= FLUSH_WINDOWS:
                out, seen = removed(held, seen)
                yield out
                held, amount = [], 0
        if held:
            yield removed(held, seen)[0]

    return run


def removal_runs(docs: DataFrame, window: int, column: str = "text") -> DataFrame:
    """(doc_id, text_key, first, last): words first .. last - 1 lie in windows that a smaller doc_id also has."""
    kinds = "doc_id long, text_key long, first int, last int"
    known = docs.where(F.col("doc_id").isNotNull())
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(known, window, column))
    shipped = known.select("doc_id", "text_key", column).mapInArrow(_ship_windows(window, column, hot), _SCHEMA)
    # Runs settled in their task need no partner: they are dealt out by document.
    dealt = shipped.repartition(F.coalesce("anchor", F.xxhash64("doc_id", "start"))).sortWithinPartitions("anchor", "doc_id")
    return dealt.mapInArrow(_match_windows(window), kinds)


def _cut(column: str, runs: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
            for text, spans in zip(texts, batch.column(batch.schema.get_field_index(runs)).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                n_words.append(len(words))
                if spans:
                    depth = np.zeros(len(words) + 1, np.int32)
                    ends = np.array([(s["first"], s["last"]) for s in spans])
                    np.add.at(depth, ends[:, 0], 1)
                    np.add.at(depth, ends[:, 1], -1)
                    stay = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
                    words = [words[i] for i in stay.tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            names = [n for n in batch.schema.names if n != runs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*names, "n_words", "n_removed", "kept_text"],
            )

    return run


def dedup_substrings(docs: DataFrame, window: int = 50, column: str = "text") -> DataFrame:
    """The documents with n_words, n_removed and kept_text (kept words joined by one space).

    A window is ``window`` consecutive words, split at blanks, of one row. Every word covered by a
    window whose words also stand in a row with a smaller doc_id goes; windows are judged on the
    input. Rows that share a doc_id do not take words from one another. Rows whose doc_id is null
    neither lose words nor make others lose any. Null and empty texts, and texts shorter than the
    window, keep all they have; a text of any length is worked on whole, its windows in one task each
    by their anchor. An empty table gives no rows. Other columns pass through, whatever their names,
    except that columns named n_words, n_removed or kept_text are replaced.

    Windows are compared by 64-bit hashes within 64-bit anchors. A window's anchor is the smallest
    hash of its ten-word grams, so that neighbouring windows travel in one row and equal windows meet
    in one task. Each map task first settles the windows that it holds more than once: a passage that
    a third of all documents share leaves at most one row for each slice of text. The windows of each
    anchor are counted first; an anchor with more than HOT_WINDOWS of them, a phrase that many different
    passages share, is split by the hash of the window. Of these anchors at most MOST_HOT are broadcast.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    key, own_id, own_key, spans = private_names(docs.columns, "text_key", "id", "key", "runs")
    keyed = docs.withColumn(key, F.xxhash64(column))
    runs = removal_runs(keyed.select("doc_id", F.col(key).alias("text_key"), F.col(column).alias("text")), window)
    runs = runs.groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).agg(F.collect_list(F.struct("first", "last")).alias(spans))
    joined = keyed.join(runs, (F.col("doc_id") == F.col(own_id)) & (F.col(key) == F.col(own_key)), "left").drop(own_id, own_key, key)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_words long", "n_removed long", "kept_text string"])
    return joined.mapInArrow(_cut(column, spans), schema)


def digest(docs: DataFrame, **options) -> DataFrame:
    return dedup_substrings(docs.select("doc_id", "text"), **options).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))
