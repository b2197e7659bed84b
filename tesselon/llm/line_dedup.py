"""Line dedup: two Bloom filters find suspected repeats, an exact aggregation confirms them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm._groups import pack, unpack
from tesselon.llm._shared import BROADCAST_BYTES, private_names, store
from tesselon.llm._text import slices

#: Characters stripped at both ends of a line.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
PROBES = 4
BITS_PER_LINE = 16
#: Bytes of text in a group, about, and of the corpus for each segment of the filters, about.
GROUP_BYTES, SEGMENT_BYTES = 8 << 20, 64 << 20


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line its key, or None where that is shorter than ``min_chars`` code points."""
    keys: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(BLANK).lower() if len(line) >= min_chars else b""
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        keys.append(key if long else None)
    return keys


def bit_positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers for each hash, by double hashing; bits is a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(j) * step) & np.uint64(bits - 1) for j in range(PROBES)])


def contains(filter_bytes: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = bit_positions(hashes, bits)
    return ((filter_bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def insert(filter_bytes: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    at = bit_positions(hashes, bits).ravel()
    np.bitwise_or.at(filter_bytes, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _texts(batch: pa.RecordBatch, column: str) -> Iterable[bytes]:
    for value in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()):
        yield value.as_py() or b""


def group_lines(batch: pa.RecordBatch, min_chars: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(key, row, hash) of each row's distinct line keys."""
    keys: list[bytes] = []
    rows: list[int] = []
    for i, text in enumerate(_texts(batch, "text")):
        own = {k for k in line_keys(text, min_chars) if k is not None}
        keys.extend(own)
        rows.extend([i] * len(own))
    return keys, np.array(rows, np.int64), np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def segment_cuts(hashes: np.ndarray, log_segments: int) -> np.ndarray:
    """Where each segment of the sorted hashes begins, and their end: a segment has those with the same first bits."""
    return np.searchsorted((hashes >> np.uint64(64 - log_segments)).astype(np.int64), np.arange((1 << log_segments) + 1))


def _asks(log_segments: int, min_chars: int):
    """For each group and segment the hashes of its lines, and whether two of its rows hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, blob in zip(*batch.columns, strict=True):
                hashes, counts = np.unique(group_lines(unpack(blob), min_chars)[2], return_counts=True)
                cuts = segment_cuts(hashes, log_segments)
                some = np.flatnonzero(np.diff(cuts)).tolist()
                parts = [slice(cuts[s], cuts[s + 1]) for s in some]
                columns = [
                    pa.array(some, pa.int32()),
                    pa.array([grp.as_py()] * len(some), pa.int64()),
                    pa.array([hashes[p].tobytes() for p in parts], pa.binary()),
                    pa.array([np.packbits(counts[p] > 1).tobytes() for p in parts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["segment", "grp", "hashes", "again"])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds each segment's filters of lines seen once and seen twice, and tells each group which of its hashes the second has."""
    at, held = None, []

    def flush() -> pa.RecordBatch:
        bits = 1 << max(10, (BITS_PER_LINE * sum(len(h) for _, h, _ in held) - 1).bit_length())
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for _, hashes, again in held:
            insert(twice, hashes[again | contains(once, hashes, bits)], bits)
            insert(once, hashes, bits)
        columns = [pa.array([at] * len(held), pa.int32()), pa.array([g for g, _, _ in held], pa.int64()), pa.array([np.packbits(contains(twice, h, bits)).tobytes() for _, h, _ in held], pa.binary()), pa.array([len(h) for _, h, _ in held], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["segment", "grp", "suspected", "n"])

    for batch in batches:
        for segment, grp, hashes, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if segment != at and held:
                yield flush()
                held = []
            at, hashes = segment, np.frombuffer(hashes, np.uint64)
            held.append((grp, hashes, np.unpackbits(np.frombuffer(again, np.uint8), count=len(hashes)).astype(bool)))
    if held:
        yield flush()


def _suspects(min_chars: int):
    """The suspected lines of each group; its answers come first, in the order of its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, told = None, []
        for batch in batches:
            for grp, segment, suspected, n, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if grp != at:
                    at, told = grp, []
                if segment is not None:
                    told.append(np.unpackbits(np.frombuffer(suspected, np.uint8), count=n).astype(bool))
                    continue
                rows = unpack(blob)
                keys, row, hashes = group_lines(rows, min_chars)
                if not keys:
                    continue
                hit = np.flatnonzero(np.concatenate(told)[np.unique(hashes, return_inverse=True)[1]])
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit], pa.binary()), rows.column(0).take(pa.array(row[hit]))], names=["key", "keeper"])

    return run


def suspected_lines(docs: DataFrame, min_chars: int, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(key, keeper) for each row and each of its line keys that the filter of twice-seen lines holds: none that
    two rows have is missing."""
    kind = docs.schema[id_column].dataType.simpleString()
    groups = pack(docs.select(F.col(id_column).alias("id"), F.col(column).alias("text")), GROUP_BYTES)
    amount = groups.select(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    log_segments = min(24, max(4, int(amount // SEGMENT_BYTES).bit_length()))
    asked = groups.select("grp", "packed").mapInArrow(_asks(log_segments, min_chars), "segment int, grp long, hashes binary, again binary")
    told = asked.repartition("segment").sortWithinPartitions("segment").mapInArrow(_answers, "segment int, grp long, suspected binary, n int")
    both = groups.select("grp", "packed").unionByName(told, allowMissingColumns=True).repartition("grp").sortWithinPartitions("grp", F.asc_nulls_last("segment"))
    return store(both.select("grp", "segment", "suspected", "n", "packed").mapInArrow(_suspects(min_chars), f"key binary, keeper {kind}"))


def _rewrite(min_chars: int, column: str, known, id_column: str, drop_keys: str):
    """Takes the dropped lines out. known: broadcast {key: keeper}, or None where each row brings its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keepers = known.value if known is not None else {}
        for batch in slices(batches, column, GROUP_BYTES):
            ids = batch.column(batch.schema.get_field_index(id_column)).to_pylist()
            own = batch.column(batch.schema.get_field_index(drop_keys)).to_pylist() if known is None else None
            n_lines, n_dropped, kept = [], [], []
            for i, text in enumerate(_texts(batch, column)):
                lines, keys = text.split(b"\n"), line_keys(text, min_chars)
                if own is None:
                    stay = [k is None or keepers.get(k, ids[i]) == ids[i] for k in keys]
                else:
                    gone = set(own[i] or ())
                    stay = [k not in gone for k in keys]
                kept.append(b"\n".join(x for x, s in zip(lines, stay, strict=True) if s))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - sum(stay))
            names = [n for n in batch.schema.names if n != drop_keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*names, "n_lines", "n_dropped", "kept_text"],
            )

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents with n_lines, n_dropped and kept_text.

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold lose their lines in all but the
    one with the largest id among the holders. Rows of one id are one document, and rows without an id
    are one together, which is never the keeper unless no holder has an id; rows that share the largest
    id all keep the line. A null or empty text is one empty line; a text of any length is split whole.
    Ties cannot arise between ids. An empty table gives no rows. Other columns pass through, whatever
    their names, except that columns named n_lines, n_dropped or kept_text are replaced.

    Scale: rows are dealt into groups of some GROUP_BYTES of text. A group sends the hash of each of its
    lines to the hash's segment, of which there is one for every SEGMENT_BYTES of the corpus; there two
    Bloom filters tell which were seen twice, and one bit for each hash goes back. So the filters grow with
    the corpus, and none is held whole or broadcast. Only suspected repeats are shuffled as text, and
    counted with map-side aggregation. If the confirmed keys are small they are broadcast; beyond
    BROADCAST_BYTES they reach their documents by a shuffle join.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    holder, drop_keys = private_names(docs.columns, "holder", "drop_keys")
    suspects = suspected_lines(docs, min_chars, column, id_column)
    holders = F.count_distinct("keeper") + F.max(F.col("keeper").isNull().cast("int"))
    common = store(suspects.groupBy("key").agg(holders.alias("n"), F.max("keeper").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper"))
    n, size = common.select(F.count(F.lit(1)), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    kind = docs.schema[id_column].dataType.simpleString()
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_lines long", "n_dropped long", "kept_text string"])
    if size + 100 * n <= BROADCAST_BYTES:
        known = spark.sparkContext.broadcast({bytes(r.key): r.keeper for r in common.collect()})
        return docs.mapInArrow(_rewrite(min_chars, column, known, id_column, drop_keys), schema)
    # AQE splits the hot keys of this join; its rows are the suspects only.
    drops = suspects.withColumnRenamed("keeper", holder).join(common, "key").where(~F.col(holder).eqNullSafe(F.col("keeper")))
    drops = drops.groupBy(F.col(holder).cast(kind).alias(holder)).agg(F.collect_set("key").alias(drop_keys))
    joined = docs.join(drops, docs[id_column].eqNullSafe(drops[holder]), "left").drop(holder)
    return joined.mapInArrow(_rewrite(min_chars, column, None, id_column, drop_keys), schema)


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays, one row for each document."""
    return dedup_lines(docs.select("doc_id", "text"), **options).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
