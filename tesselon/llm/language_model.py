"""Language-model scoring: a log-frequency Bloom filter of quantised n-gram counts, probed for smoothed probabilities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm._groups import pack, unpack
from tesselon.llm._shared import store
from tesselon.llm._text import Hasher, mix, slices

#: Level of a count c: 1 + floor(log(c) to this base); an n-gram of level L is entered L times.
QUANTUM = 1.5
LEVELS = 64
PROBES, BITS_PER_ENTRY = 4, 12
#: Bytes of text in a group, about, and of the corpus for each bucket of hashes, about.
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 12_000_000
#: Pseudo-counts of the shorter n-gram's estimate in that of the longer.
PRIOR = 5.0
_U = np.uint64
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)
WORD, PAIR, TRIPLE = KINDS = (0, 1, 2)
#: Bytes of a key: pairs and triples are told apart by 56 bits, far below the filter's own error up to some 10**13 of them.
KEY_BYTES = (8, 7, 7)
_KEY_MASK = np.uint64((1 << 56) - 1)


def levels(counts: np.ndarray) -> np.ndarray:
    """Level of each count, 0 for none."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(QUANTUM) + 1e-9), 0).astype(np.int64)


def expected(level: np.ndarray) -> np.ndarray:
    """Mean of the counts that have a level; 0 for level 0."""
    level = level.astype(float)
    return np.where(level > 0, (QUANTUM ** (level - 1) + QUANTUM**level - 1) / 2, 0.0)


def token_stream(hasher: Hasher, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(tokens of each text, then each token, pair and triple with the tokens before): each text's words and its end, in order."""
    words = hasher.words(texts, lower=True)
    n = words.counts + 1
    last = np.cumsum(n) - 1
    token = np.empty(int(n.sum()), _U)
    inner = np.ones(len(token), bool)
    inner[last] = False
    token[inner] = words.hashes
    token[last] = _END
    first = last - words.counts
    before = np.append(_START, token[:-1])
    before[first] = _START
    pair = mix(before * _U(0x9E3779B97F4A7C15) + token)
    earlier = np.append(_START, pair[:-1])
    earlier[first] = _START
    return n, token, pair & _KEY_MASK, mix(earlier * _U(0x9E3779B97F4A7C15) + token) & _KEY_MASK


def group_stream(hasher: Hasher, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """As token_stream, in slices of bounded size."""
    whole = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts = [token_stream(hasher, part.column(0)) for part in slices(iter([whole]), "text")]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def bucket_cuts(keys: np.ndarray, kind: int, log_buckets: int) -> np.ndarray:
    """Where each bucket of the sorted keys begins, and their end: a bucket holds the keys with the same first bits."""
    top = (keys >> _U(8 * KEY_BYTES[kind] - log_buckets)).astype(np.int64)
    return np.searchsorted(top, np.arange((1 << log_buckets) + 1))


def _planes(values: np.ndarray, size: int) -> bytes:
    """The lowest ``size`` bytes of 64-bit values, the lowest bytes of all first: the highest are mostly 0 and compress away."""
    return values.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _values(blob: bytes, size: int) -> np.ndarray:
    wide = np.zeros((len(blob) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(blob, np.uint8).reshape(size, -1).T
    return wide.view(_U)[:, 0]


def squeezed(blob: bytes) -> bytes:
    """Compressed, after its length."""
    return len(blob).to_bytes(4, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def unsqueezed(blob: bytes) -> bytes:
    return pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True)


def pack_keys(keys: np.ndarray, kind: int) -> bytes:
    """Sorted keys as differences."""
    return _planes(np.diff(keys, prepend=_U(0)), KEY_BYTES[kind])


def unpack_keys(blob: bytes, kind: int) -> np.ndarray:
    return np.cumsum(_values(blob, KEY_BYTES[kind]), dtype=_U)


def entry_bit(keys: np.ndarray, kind: int, level: int, probe: int, bits: int) -> np.ndarray:
    """Place of one bit of the entry (key, level) in a filter of so many bits, a power of two."""
    salt = ((level * 2 + kind) * PROBES + probe + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF
    return mix(keys + _U(salt)) & _U(bits - 1)


class LogFilter:
    """Bloom filter with the entries (key, 1) .. (key, level) of each key of one bucket."""

    def __init__(self, keys: np.ndarray, level: np.ndarray, kind: int):
        self.kind = kind
        self.size = 1 << max(6, (BITS_PER_ENTRY * int(level.sum()) - 1).bit_length())
        bits = np.zeros(self.size, bool)
        for j in range(1, int(level.max(initial=0)) + 1):
            keys, level = keys[level >= j], level[level >= j]
            for probe in range(PROBES):
                bits[entry_bit(keys, kind, j, probe, self.size)] = True
        self.bits = np.packbits(bits, bitorder="little")

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key: the last of an unbroken run of entries; never below the true one."""
        out, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level in range(1, LEVELS):
            for probe in range(PROBES):
                if not len(open_):
                    return out
                place = entry_bit(keys[open_], self.kind, level, probe, self.size)
                open_ = open_[(self.bits[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1]
            out[open_] = level
        return out


def unpacked(blob: pa.BinaryScalar) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(ids, whether held out, texts) of a group."""
    ids, held, texts = unpack(blob).columns
    return ids, np.array(held.to_pylist(), bool), texts


def _partial_counts(log_buckets: int):
    """For each group and bucket the n-grams of its texts, those of held-out texts too, and how often training texts have them."""

    def counted(hasher: Hasher, grp: int, blob: pa.BinaryScalar) -> Iterator[pa.RecordBatch]:
        _, held, texts = unpacked(blob)
        sizes, *streams = group_stream(hasher, texts)
        trains = np.repeat(~held, sizes)
        for kind in KINDS:
            keys, back = np.unique(streams[kind], return_inverse=True)
            counts = np.bincount(back[trains], minlength=len(keys)).astype(_U)
            cuts = bucket_cuts(keys, kind, log_buckets)
            some = np.flatnonzero(np.diff(cuts)).tolist()
            parts = [slice(cuts[b], cuts[b + 1]) for b in some]
            columns = [
                pa.array([kind] * len(some), pa.int32()),
                pa.array(some, pa.int32()),
                pa.array([grp] * len(some), pa.int64()),
                pa.array([pack_keys(keys[p], kind) for p in parts], pa.binary()),
                pa.array([_planes(counts[p], 4) for p in parts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "grp", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for grp, blob in zip(*batch.columns, strict=True):
                yield from counted(hasher, grp.as_py(), blob)

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up each bucket's counts, builds its filter, and tells each group the levels that the filter has for its
    n-grams, and the exact counts of its words."""
    at, held = None, []

    def flush() -> pa.RecordBatch:
        kind, bucket = at
        sizes = [len(k) for _, k, _ in held]
        keys = np.concatenate([k for _, k, _ in held])
        counts = np.concatenate([c for _, _, c in held])
        unique, back = np.unique(keys, return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, back, counts.astype(np.int64))
        level = levels(total)
        known = total > 0
        found = LogFilter(unique[known], level[known], kind).level(unique).astype(np.uint8)
        ends = np.cumsum(sizes)[:-1]
        told = [squeezed(x.tobytes()) for x in np.split(found[back], ends)]
        exact = [squeezed(_planes(x, 8)) for x in np.split(total.astype(_U)[back], ends)] if kind == WORD else [None] * len(sizes)
        rest = [0] * (len(sizes) - 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * len(sizes), pa.int32()),
                pa.array([bucket] * len(sizes), pa.int32()),
                pa.array([g for g, _, _ in held], pa.int64()),
                pa.array(told, pa.binary()),
                pa.array(exact, pa.binary()),
                pa.array([int(total.sum()), *rest], pa.int64()),
                pa.array([int(known.sum()), *rest], pa.int64()),
            ],
            names=["kind", "bucket", "grp", "levels", "exact", "total", "distinct"],
        )

    for batch in batches:
        for i in range(batch.num_rows):
            kind, bucket, grp, keys, counts = (c[i].as_py() for c in batch.columns)
            if (kind, bucket) != at and at is not None:
                yield flush()
                held = []
            at = (kind, bucket)
            held.append((grp, unpack_keys(keys, kind), _values(counts, 4)))
    if at is not None:
        yield flush()


def smoothed(counts: list[np.ndarray], first: np.ndarray, total: int, distinct: int, texts: int) -> np.ndarray:
    """log10 of each token's probability: its triple's count with PRIOR pseudo-counts of its pair's estimate, and that
    with as many of the add-one word estimate."""
    estimate = (counts[WORD] + 1) / (total + distinct + 1)
    for kind in (PAIR, TRIPLE):
        history = np.where(first, float(texts), np.append(0.0, counts[kind - 1][:-1]))
        estimate = (np.minimum(counts[kind], history) + PRIOR * estimate) / (history + PRIOR)
    return np.log10(estimate)


_SCORED = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(total: int, distinct: int, n_texts: int):
    """Scores each group's texts; its answers come first, in the order of its n-grams."""

    def scored(hasher: Hasher, blob: pa.BinaryScalar, told: list[list[np.ndarray]], exact: list[np.ndarray]) -> pa.RecordBatch:
        ids, held, texts = unpacked(blob)
        sizes, *streams = group_stream(hasher, texts)
        n, counts = len(sizes), []
        for kind in KINDS:
            _, back = np.unique(streams[kind], return_inverse=True)
            counts.append(expected(np.concatenate(told[kind]))[back])
            if kind == WORD:
                seen = np.concatenate(exact)[back]
        first = np.zeros(len(seen), bool)
        first[np.cumsum(sizes) - sizes] = True
        owner = np.repeat(np.arange(n), sizes)
        columns = [
            ids,
            pa.array(held),
            pa.array(sizes.astype(np.int64)),
            pa.array(np.bincount(owner, seen > 0, n).astype(np.int64)),
            pa.array(np.bincount(owner, np.log10(seen + 1.0), n) - sizes * math.log10(total + distinct + 1)),
            pa.array(np.bincount(owner, smoothed(counts, first, total, distinct, n_texts), n)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, at = Hasher(), None
        told: list[list[np.ndarray]] = []
        exact: list[np.ndarray] = []
        for batch in batches:
            for grp, kind, levels_, exact_, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                if grp != at:
                    at, told, exact = grp, [[] for _ in KINDS], []
                if kind < 0:
                    yield scored(hasher, blob, told, exact)
                    continue
                told[kind].append(np.frombuffer(unsqueezed(levels_.as_py()), np.uint8))
                if kind == WORD:
                    exact.append(_values(unsqueezed(exact_.as_py()), 8).astype(np.int64))

    return run


def score_texts(docs: DataFrame, held_out: F.Column, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Tokens are the words between blanks, A-Z in lower case, then one end. The model learns from all rows
    whose ``held_out`` is not true. base_score sums log10((c + 1) / (N + V + 1)) with exact counts c of
    the training tokens, N of them in all and V distinct; n_known counts tokens with c > 0. score is the
    model's log10 probability of the text: counts of one, two and three tokens, those of 1 too, quantised to
    powers of 1.5 in log-frequency Bloom filters, probed level by level; the longer estimate is smoothed by
    PRIOR pseudo-counts of the shorter, the shortest by adding one. Null and empty texts are one end token. Repeated rows
    are counted and returned each; a null id is not held out by a test of it. Without training rows c, N
    and V are 0. An empty table gives no rows; a text of any length is read whole, its n-grams being held
    by one task. Only the id, the text and what held_out needs are read; other columns, whatever their
    names, are left out.

    Scale: rows are dealt into groups of some GROUP_BYTES of text. A group sends each of its n-grams once
    to the n-gram's bucket of hashes, of which there is one for every BUCKET_BYTES of the corpus. There the
    counts are added up, the bucket's filter is built and probed for what each group sent, and the levels
    go back to the group in the order of its n-grams, without their keys. So the filter grows with the
    corpus, is nowhere held whole, and nothing is broadcast or brought to the driver but three sums. The
    most frequent word comes once from each group, so no bucket is hot.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    groups = pack(texts, GROUP_BYTES)
    amount, n_texts = groups.select(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0], texts.where(~F.col("held")).count()
    log_buckets = min(24, max(6, int(amount // BUCKET_BYTES).bit_length()))
    sent = groups.select("grp", "packed").mapInArrow(_partial_counts(log_buckets), "kind int, bucket int, grp long, keys binary, counts binary")
    dealt = sent.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    told = store(dealt.mapInArrow(_answers, "kind int, bucket int, grp long, levels binary, exact binary, total long, distinct long"))
    total, distinct = (int(x or 0) for x in told.where(F.col("kind") == WORD).select(F.sum("total"), F.sum("distinct")).first())
    asked = groups.select("grp", F.lit(-1).alias("kind"), "packed")
    # A group's own row comes last: kinds are sorted downwards.
    both = asked.unionByName(told.drop("total", "distinct"), allowMissingColumns=True).repartition("grp").sortWithinPartitions("grp", F.desc("kind"), "bucket")
    out = both.select("grp", "kind", "levels", "exact", "packed").mapInArrow(_score(total, distinct, n_texts), _SCORED)
    return out.select(F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def digest(docs: DataFrame) -> DataFrame:
    """Scores for every document; those with crc32(doc_id) mod 7 of 2 are held out."""
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
