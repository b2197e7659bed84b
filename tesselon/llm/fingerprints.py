"""Document fingerprints: the most improbable byte windows of a text, in a chain of Bloom filters."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.llm._text import give_back, mix, slices, utf8

#: Bytes of a feature; features among which the rarest is found; how often it must be the rarest to be taken.
WINDOW, NEIGHBOURS, LEAST_WINS = 16, 32, 8
#: Bits of a filter, features in each and bits of each feature.
BITS, CAPACITY, PROBES = 2048, 160, 5
#: Steps of entropy that are told apart. Those in the lowest quarter are taken last, however rare: they are rules and blanks.
STEPS = 1000
#: Share of the way from the overlap that chance gives to the largest one which counts as none.
CHANCE_MARGIN = 0.3
#: Bytes whose windows are looked at together.
BLOCK = 1 << 20
#: Range parts for each shuffle partition, so that parts dealt by hash are even.
PARTS_PER_PARTITION = 4
_U = np.uint64
_PAD = bytes(NEIGHBOURS)
_COUNTS = np.arange(1, WINDOW + 1)
#: c * log2(c) as whole numbers, so that running sums are exact, and what one more equal byte adds.
_PLOGP = np.concatenate([[0], np.round(_COUNTS * np.log2(_COUNTS) * 2**20)]).astype(np.int64)
_GAIN = np.diff(_PLOGP)


class _Padded:
    """Texts one after the other with NEIGHBOURS zero bytes before, between and behind them, and where windows begin."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(_PAD + b"".join(t + _PAD for t in texts), np.uint8)
        self.first = np.cumsum(self.sizes + NEIGHBOURS) - self.sizes
        #: Whether a window that lies in one text begins at a byte.
        self.begins = np.zeros(len(self.data), bool)
        for a, n in zip(self.first.tolist(), self.sizes.tolist(), strict=True):
            self.begins[a : a + max(0, n - WINDOW + 1)] = True

    def blocks(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(from, to, start, steps): entropies for the bytes from .. to - 1 and NEIGHBOURS on both sides, from start on."""
        for a in range(0, len(self.data), BLOCK):
            b, start = min(len(self.data), a + BLOCK), max(0, a - NEIGHBOURS)
            if self.begins[start : b + NEIGHBOURS].any():
                yield a, b, start, entropy_steps(self.data[start : b + NEIGHBOURS + WINDOW])


def entropy_steps(x: np.ndarray) -> np.ndarray:
    """Step of the entropy of each window of some bytes, STEPS being the highest."""
    n = len(x)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, min(WINDOW, n)):
        same = x[d:] == x[:-d]
        before[d:] += same
        after[:-d] += same
    run = np.cumsum(_GAIN[before])
    run[WINDOW:] -= np.cumsum(_GAIN[after[: n - WINDOW]])
    return ((_PLOGP[-1] - run[WINDOW - 1 :]) * STEPS // _PLOGP[-1]).astype(np.int32)


def _slide_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each step of entropy, the rarest first and those in the lowest quarter last, from the windows counted."""
    order = np.lexsort((np.arange(STEPS + 1), counts, np.arange(STEPS + 1) < STEPS // 4))
    out = np.empty(STEPS + 1, np.int64)
    out[order] = np.arange(STEPS + 1)
    return out


def features(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features chosen in each text, in their order and each once a text.

    Among any NEIGHBOURS windows that follow one another, or as many as there are at either end of a text, the
    leftmost of the rarest wins; windows that win LEAST_WINS times are features. A text shorter than a window is one feature."""
    padded = _Padded(texts)
    whole = np.flatnonzero((padded.sizes > 0) & (padded.sizes < WINDOW))
    starts = padded.first[whole]
    none = np.iinfo(np.int64).max
    for a, b, start, steps in padded.blocks():
        place = np.arange(len(steps))
        key = np.where(padded.begins[start : start + len(steps)], rank[steps] << 40 | place, none)
        key = np.concatenate([np.full(NEIGHBOURS - 1, none), key, np.full(NEIGHBOURS - 1, none)])
        best = _slide_min(key, NEIGHBOURS)
        wins = np.bincount(best[best != none] & ((1 << 40) - 1), minlength=len(steps))
        chosen = np.flatnonzero(wins >= LEAST_WINS) + start
        starts = np.concatenate([starts, chosen[(chosen >= a) & (chosen < b)]])
    starts.sort()
    row = np.searchsorted(padded.first, starts, "right") - 1
    bytes_of = padded.data[starts[:, None] + np.arange(WINDOW)].view(_U)
    hashes = mix(np.minimum(padded.sizes[row], WINDOW).astype(_U))
    for k in range(WINDOW // 8):
        hashes = mix(hashes * _U(0x9E3779B97F4A7C15) ^ bytes_of[:, k])
    order = np.lexsort((starts, hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    keep = np.sort(order[new])
    return row[keep], hashes[keep]


def chains(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """For each text its filters, a row of bytes each, of which every one but the last holds CAPACITY features."""
    row, hashes = features(texts, rank)
    counts = np.bincount(row, minlength=len(texts))
    filters = -(-counts // CAPACITY)
    first = np.cumsum(filters) - filters
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    bits = np.zeros((int(filters.sum()), BITS), np.uint8)
    for p in range(PROBES):
        bits[first[row] + number // CAPACITY, ((hashes >> _U(11 * p)) & _U(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[a : a + n] for a, n in zip(first.tolist(), filters.tolist(), strict=True)]


def to_text(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)


def chain_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """For each filter of the shorter chain its best overlap with one of the other, from 0 (what chance gives, and a
    margin) to 1 (all bits that could be common are), weighted by the filters' bits. Two empty chains are alike."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    size_a, size_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    known = {f.tobytes() for f in b}
    best = np.array([float(f.tobytes() in known) for f in a])
    rest = np.flatnonzero(best == 0)
    block = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(rest), block):
        at = rest[i : i + block]
        common = np.bitwise_count(a[at][:, None] & b[None]).sum(axis=2, dtype=np.int64)
        chance = np.multiply.outer(size_a[at], size_b) / BITS
        most = np.minimum(size_a[at][:, None], size_b[None])
        least = chance + CHANCE_MARGIN * (most - chance)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(most > least, (common - least) / (most - least), common >= most)
        best[at] = np.clip(score.max(axis=1), 0.0, 1.0)
    return float((best * size_a).sum() / size_a.sum())


# --- on DataFrames -------------------------------------------------------------------------------


def _text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    at, data = utf8(batch.column(batch.schema.get_field_index(column)))
    whole = data.tobytes()
    return [whole[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _count_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(STEPS + 1, np.int64)
    for batch in slices(batches, "text"):
        padded = _Padded(_text_bytes(batch, "text"))
        for a, b, start, steps in padded.blocks():
            own = steps[a - start : b - start]
            counts += np.bincount(own[padded.begins[a : a + len(own)]], minlength=STEPS + 1)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["step", "n"])


def fit_rarity(docs: DataFrame, column: str = "text") -> np.ndarray:
    """How many windows of all texts have an entropy of each step: STEPS + 1 numbers, whatever the size of the table."""
    counts = np.zeros(STEPS + 1, np.int64)
    each = docs.select(F.col(column).alias("text")).mapInArrow(_count_steps, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))
    for r in each.collect():
        counts[r.step] = r.n
    return counts


def fingerprints(docs: DataFrame, rarity: np.ndarray | None = None, column: str = "text") -> DataFrame:
    """The documents with fingerprint: the filters of the text, one after the other, in base 64.

    ``rarity`` is what ``fit_rarity`` gives, of these documents if None; fingerprints of the same one can be
    compared. Equal texts have equal fingerprints. A null text is empty, and an empty one has an empty
    fingerprint. A text of any length is worked on whole. Other columns pass through, whatever their
    names, except that a column named fingerprint is replaced. Nothing is shuffled.
    """
    rank = ranks(fit_rarity(docs, column) if rarity is None else rarity)
    docs = docs.drop(*[n for n in docs.columns if n.lower() == "fingerprint"])
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema] + ["fingerprint string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            made = [to_text(c) for c in chains(_text_bytes(batch, column), rank)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, schema)


def likeness(a: Column, b: Column) -> Column:
    """Likeness, 0 to 1, of two columns of fingerprints; null where either is."""

    @F.arrow_udf("double")
    def compare(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([None if p is None or q is None else 1.0 if p == q else chain_likeness(from_text(p), from_text(q)) for p, q in pairs], pa.float64())

    return compare(a, b)


def _order(id_column: str, column: str) -> list[Column]:
    """The documents' order: descending id, null last; rows of one id by a hash of their texts."""
    return [F.col(id_column).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(column), F.lit(""))).alias("mark")]


def part_heads(docs: DataFrame, id_column: str, column: str) -> list[tuple]:
    """The first (id, mark) of each part into which the order of all documents is cut: as many as there are parts."""
    parts = PARTS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select(_order(id_column, column)).repartitionByRange(parts, F.col("id").desc_nulls_last(), F.col("mark"))
    # The greatest of these structs is the first key: with an id before without, a larger id, a smaller mark.
    first = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", (-1 - F.col("mark")).alias("turned")))
    heads = keys.groupBy(F.spark_partition_id().alias("part")).agg(first.alias("k")).select("k.id", (-1 - F.col("k.turned")).alias("mark")).collect()
    return sorted(((r.id, r.mark) for r in heads), key=_sort_key)


def _sort_key(key: tuple) -> tuple:
    return (key[0] is None, -(key[0] or 0), key[1])


def _deal(heads: list[tuple]):
    """For (id, mark) the parts that need the row: its own and, if it is the first there, the part before as its tail."""
    keys = [_sort_key(h) for h in heads]
    known = {k: i for i, k in enumerate(keys)}

    @F.arrow_udf("array<struct<part: int, tail: boolean>>")
    def deal(ids: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for key in zip(ids.to_pylist(), marks.to_pylist(), strict=True):
            key = _sort_key(key)
            here = [{"part": bisect_right(keys, key) - 1, "tail": False}]
            if key in known:
                here.append({"part": (known[key] - 1) % len(keys), "tail": True})
            out.append(here)
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("tail", pa.bool_())])))

    return deal


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many code points of the following one, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compare_next(rank: np.ndarray):
    """Rows come in order, those of one part together and a tail at its end. Held back is one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in slices(batches, "text"):
            texts = _text_bytes(batch, "text")
            tails = batch.column(batch.schema.get_field_index("tail")).to_pylist()
            ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
            rows = held + list(zip(ids, tails, texts, chains(texts, rank), strict=True))
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]
            held = rows[-1:]
            words = [a[2].decode("utf-8", "replace") for a, _ in pairs]
            made = [edited(t, b[2].decode("utf-8", "replace")) for t, (_, b) in zip(words, pairs, strict=True)]
            others = chains([m.encode() for m in made], rank)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in pairs], pa.int64()),
                    pa.array([len(t) for t in words], pa.int64()),
                    pa.array(made, pa.string()),
                    pa.array([to_text(a[3]) for a, _ in pairs], pa.string()),
                    pa.array([to_text(c) for c in others], pa.string()),
                    pa.array([chain_likeness(a[3], c) for (a, _), c in zip(pairs, others, strict=True)], pa.float64()),
                    pa.array([chain_likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
                ],
                names=["id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
        give_back()

    return run


def compare_with_next(docs: DataFrame, rarity: np.ndarray | None = None, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document is the one after it by descending id, after the last the first. The edited text is
    the document's with its last third, by code points and rounded down, replaced by as many from the start of the next
    document, or all it has. near_edited and near_next are the likeness of the document's fingerprint to that of
    the edited text and of the next document. A null text is empty; ids are whole numbers, null ones
    come last. Rows that share an id follow one another by a hash of their texts, and repeated rows follow
    one another. A single document is its own next. An empty table gives no rows. Other columns are not read.

    The order is cut into parts by ranges of (id, hash), of which only the first keys are gathered. Each row
    goes to its part once, and the first of a part once more to the end of the part before. Within a part
    rows stream by in order, so that a part of any size takes the memory of a few texts.
    """
    rank = ranks(fit_rarity(docs, column) if rarity is None else rarity)
    rows = docs.select(*_order(id_column, column), F.coalesce(F.col(column), F.lit("")).alias("text"))
    heads = part_heads(docs, id_column, column)
    dealt = rows.withColumn("to", F.explode(_deal(heads)("id", "mark"))).select("to.part", "to.tail", "id", "mark", "text")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "tail", F.col("id").desc_nulls_last(), "mark")
    out = dealt.mapInArrow(_compare_next(rank), "id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_column)


def digest(docs: DataFrame, **options) -> DataFrame:
    out = compare_with_next(docs, **options)
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
