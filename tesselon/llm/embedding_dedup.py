"""Embedding near-dedup: random-hyperplane hashes in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm._components import components
from tesselon.llm._shared import store
from tesselon.llm._text import mix

#: Sign bits of a table's key: at least so many, and about the binary logarithm of the number of vectors,
#: so that buckets of unrelated vectors stay small at every size.
LEAST_BITS, MOST_BITS = 16, 32
#: A pair at the threshold meets in no table with this probability at most.
MISS = 4e-8
#: Vectors of a bucket that are compared with one another at once; larger buckets go block by block.
BLOCK = 2048
_U = np.uint64


def table_shape(vectors: int, threshold: float) -> tuple[int, int]:
    """(tables, bits): a bit agrees with probability 1 - angle / pi."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, vectors)))))
    meet = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return max(1, math.ceil(math.log(MISS) / math.log1p(-min(meet, 1 - 1e-9)))), bits


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; their largest component is made 1 first, so that no square is lost or overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signs(seed: int, kind: str, tables: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(width)).astype(np.int64)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            label = np.asarray(batch.column(batch.schema.get_field_index("label")))
            sizes = np.asarray(column.value_lengths())
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.asarray(column.take(pa.array(at)).flatten(), np.float64).reshape(len(at), size)
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, int(size)]).standard_normal((int(size), tables * width))
                bits = (_unit(x) @ planes[size] > 0).reshape(len(at), tables, width) @ weights
                salt = mix(label[at].astype(np.int64).view(_U)[:, None] * _U(0x9E3779B97F4A7C15) + mix(np.arange(tables, dtype=_U) + _U(int(size) << 8)))
                keys = mix(salt + bits.astype(_U))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                own = [batch.column(batch.schema.get_field_index(c)).take(pa.array(at)) for c in ("rep", "copies")]
                raw = [pa.array([v.tobytes() for v in m], pa.binary()) for m in (x.astype(kind), bits.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([*own, *raw, lists], names=["rep", "copies", "raw", "signs", "keys"])

    return run


def _compare(threshold: float, kind: str):
    """Rows of one bucket's pair of blocks arrive together. Emits, for each vector, how many it is linked
    with that it met in no earlier table, and one other vector of its connected group."""

    def links(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        table, (left, right) = rows[0][3], (np.array([k for k, r in enumerate(rows) if r[4] == side]) for side in rows[0][1:3])
        if not len(left) or not len(right):
            return None
        rep, copies = np.array([r[5] for r in rows]), np.array([r[6] for r in rows], np.int64)
        x = _unit(np.frombuffer(b"".join(r[7] for r in rows), kind).astype(np.float64).reshape(len(rows), -1))
        near = x[left] @ x[right].T >= threshold
        same = rows[0][1] == rows[0][2]
        if same:
            np.fill_diagonal(near, False)
        if not near.any():
            return None
        signs = np.frombuffer(b"".join(r[8] for r in rows), np.uint32).reshape(len(rows), -1)
        new = near.copy()
        for t in range(table):  # counted where they met first
            new &= signs[left, t][:, None] != signs[right, t]
        count = np.zeros(len(rows), np.int64)
        np.add.at(count, left, new @ copies[right])
        if not same:
            np.add.at(count, right, copies[left] @ new)
        # Smallest vector reachable within these blocks.
        group = rep.copy()
        while True:
            least = group.copy()
            top = np.iinfo(np.int64).max
            np.minimum.at(least, left, np.where(near, group[right][None], top).min(axis=1))
            np.minimum.at(least, right, np.where(near, group[left][:, None], top).min(axis=0))
            if (least == group).all():
                break
            group = least
        some = (count > 0) | (group != rep)
        return rep[some], count[some], group[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            found = links(held)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["rep", "n", "other"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != at and held:
                    yield from flush()
                    held = []
                at = r[:3]
                held.append(r)
        if held:
            yield from flush()

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, seed: int = 11, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Vectors with equal, not null labels and a cosine of at least ``threshold`` in double precision are
    linked; n_links counts the other rows linked directly, component_id is the smallest id reachable.
    Vectors that are null, empty, zero or hold null or non-finite components, and those of a null label,
    are linked with nothing and are their own component. Vectors of different lengths are not compared.
    Each row is a vector of its own: rows that share an id are linked by what their own vectors link to,
    and rows that share a vector are linked with one another. A null id is linked with nothing, its component is null and it is kept. An empty table
    gives no rows. Labels of any type are compared as they are, vectors of any size by their directions. Other columns
    are not read.

    Equal vectors of a label are one representative with a count, so copies are never expanded.
    Representatives meet in the buckets of hash tables, whose bits grow with the logarithm of their number; within a bucket all cosines are computed as
    matrix products of at most BLOCK rows a side, larger buckets in several tasks, and pairs that met in
    an earlier table are not counted again. What leaves a task is a count and one link for each vector.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), F.col(label_column).alias("label"))
    element = vectors.schema[vector_column].dataType.elementType
    kind = "f4" if element.simpleString() == "float" else "f8"
    sound = F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("vector") > 0)
    sound &= F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vector", lambda v: v != 0)
    # Minus zero equals zero, but not in a grouping of arrays.
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("vector", F.transform("vector", lambda v: (v + F.lit(0.0)).cast(element)))
    rows = rows.select("id", "label", F.when(F.col("sound"), F.xxhash64("vector")).alias("mark"), F.when(F.col("sound"), F.col("vector")).alias("vector"))
    classes = rows.where("vector IS NOT NULL").groupBy("label", "mark", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = store(classes.withColumn("rep", F.monotonically_increasing_id()))  # fixed by being stored
    hashed = classes.select("rep", "copies", F.xxhash64("label").alias("label"), "vector").mapInArrow(_signs(seed, kind, *table_shape(classes.count(), threshold)), "rep long, copies long, raw binary, signs binary, keys array<long>")
    hashed = store(hashed)
    met = hashed.select("rep", F.posexplode("keys").alias("place", "bucket"))
    large = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    met = met.join(large, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    sides = met.join(hashed.drop("keys"), "rep").withColumn("across", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = sides.select("bucket", F.least("block", "across").alias("i"), F.greatest("block", "across").alias("j"), "place", "block", "rep", "copies", "raw", "signs")
    dealt = sides.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = store(dealt.mapInArrow(_compare(threshold, kind), "rep long, n long, other long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    group = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    named = group.join(classes.select(F.col("rep").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("smallest"))
    group = group.join(named, "component").select(F.col("node").alias("rep"), "smallest")
    about = classes.join(counts, "rep", "left").join(group, "rep", "left")
    about = about.where("copies > 1 OR n > 0 OR smallest IS NOT NULL")
    about = about.select("label", "mark", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component"))
    out = rows.join(about, ["label", "mark", "vector"], "left")
    out = out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
