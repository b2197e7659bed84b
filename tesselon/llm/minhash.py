"""MinHash near-dedup: one-permutation signatures, optimal densification, bands and star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm._components import components
from tesselon.llm._shared import maybe_broadcast, store
from tesselon.llm._text import Hasher, Words, mix, slices

#: Bands of rows: a pair at similarity 0.85 shares no band with probability (1 - 0.85**6)**32 = 3e-7; at 0.8, 6e-5.
BANDS, ROWS = 32, 6
#: Members that one group of a star verifies against its centre.
STAR_MEMBERS = 128
#: Rows of a bucket that are compared with one another at once; larger buckets are compared block by block.
BLOCK = 512
#: Bins may agree by so many standard deviations less than the threshold before a pair is given up.
SLACK = 4.0
_U = np.uint64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(hasher: Hasher, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, sorted by row; fewer words than ``size`` are one shingle."""
    row, _, hashes = hasher.windows(words, size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        row = np.concatenate([row, short])
        hashes = np.concatenate([hashes, hasher.spans(words.hashes, words.first[:-1][short], words.first[1:][short])])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[first], hashes[first]


def densified(row: np.ndarray, hashes: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """One-permutation signature of each row: the smallest value of each bin. An empty bin borrows from
    the bin that a hash of (bin, attempt) names, the first attempt that meets a filled one."""
    value = mix(hashes ^ _U(0x5851F42D4C957F2D))
    cell = row * bins + ((value >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
    sketch = np.full(rows * bins, _EMPTY, _U)
    np.minimum.at(sketch, cell, value)
    sketch = sketch.reshape(rows, bins)
    own = sketch.copy()
    some = (own != _EMPTY).any(axis=1)
    names, attempt = np.arange(bins, dtype=_U), 0
    at_row, at_bin = np.nonzero((own == _EMPTY) & some[:, None])
    while len(at_row):
        attempt += 1
        donor = (mix(names * _U(0x2545F4914F6CDD1D) + _U(attempt)) % _U(bins)).astype(np.int64)
        got = own[at_row, donor[at_bin]]
        sketch[at_row, at_bin] = mix(got + _U(attempt))
        again = got == _EMPTY
        at_row, at_bin = at_row[again], at_bin[again]
    return sketch


def _signatures(size: int, column: str, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        salts = mix(np.arange(1, BANDS + 1, dtype=_U))
        for batch in slices(batches, column):
            words = hasher.words(batch.column(batch.schema.get_field_index(column)), lower=True)
            row, hashes = shingle_sets(hasher, words, size)
            n = np.bincount(row, minlength=batch.num_rows)
            bands = np.zeros((batch.num_rows, BANDS), _U)
            short = np.zeros((batch.num_rows, BANDS * ROWS), np.uint8)
            for i in range(0, batch.num_rows, 512):  # bounds the sketches in memory
                here = slice(*np.searchsorted(row, [i, i + 512]))
                cells = densified(row[here] - i, hashes[here], min(512, batch.num_rows - i), BANDS * ROWS).reshape(-1, BANDS, ROWS)
                key = np.tile(salts, (len(cells), 1))
                for r in range(ROWS):
                    key = mix(key * _U(0x9E3779B97F4A7C15) + cells[:, :, r])
                bands[i : i + 512] = key
                short[i : i + 512] = (mix(cells) & _U(255)).reshape(len(cells), -1)
            starts = np.searchsorted(row, np.arange(batch.num_rows))
            full = n > 0
            sums = [np.zeros(batch.num_rows, _U) for _ in range(2)]
            for s, salt in zip(sums, (_U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25)), strict=True):
                if full.any():
                    s[full] = np.add.reduceat(mix(hashes ^ salt), starts[full])
            wide = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
            sketches = pa.array([x.tobytes() for x in short], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(id_column)), pa.array(n.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums), wide, sketches],
                names=["doc", "n_shingles", "sig_a", "sig_b", "bands", "sketch"],
            )

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked: equal neighbours in their merge are shared."""
    merged = np.concatenate([a, b])
    merged.sort(kind="stable")
    shared = int((merged[1:] == merged[:-1]).sum())
    return 100 * shared >= percent * (len(merged) - shared)


def _confirm(size: int, percent: int):
    """Rows of one star arrive together, its centre first; emits the members that are linked with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, at, centre = Hasher(), None, np.zeros(0, _U)
        for batch in slices(batches, "text"):
            words = hasher.words(batch.column(batch.schema.get_field_index("text")), lower=True)
            row, hashes = shingle_sets(hasher, words, size)
            starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            hubs, salts, members, roles = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hub", "salt", "doc", "role"))
            a, b = [], []
            for i in range(batch.num_rows):
                own = hashes[starts[i] : starts[i + 1]]
                if roles[i] == 0:
                    at, centre = (hubs[i], salts[i]), own
                elif at == (hubs[i], salts[i]):
                    if similar(centre, own, percent):
                        a.append(hubs[i])
                        b.append(members[i])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def confirmed(edges: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The edges (hub, doc) whose full shingle sets are similar enough, as (a, b). docs: doc, text.

    A hub with many members is dealt out in groups of STAR_MEMBERS, each with its own copy of the hub's text."""
    degree = edges.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR_MEMBERS).cast("int").alias("parts"))
    salted = edges.join(degree, "hub").select("hub", F.pmod(F.xxhash64("doc"), "parts").cast("int").alias("salt"), "doc", F.lit(1).alias("role"))
    centres = degree.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("hub").alias("doc"), F.lit(0).alias("role"))
    wanted = store(salted.unionByName(centres))
    texts = docs.join(maybe_broadcast(wanted, 24), "doc")
    dealt = texts.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role").select("hub", "salt", "doc", "role", "text")
    return dealt.mapInArrow(_confirm(size, percent), "a long, b long")


_OPEN = ("key", "i", "j", "doc", "component", "n", "block", "place", "sketch", "bands")
_OPEN_SCHEMA = "key long, i int, j int, doc long, component long, n long, block int, place int, sketch binary, bands array<long>"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal (key, i, j)."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            here = tuple(marks[:, a].tolist())
            if here != at and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = here
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs of different components, of fitting sizes, whose sketches agree nearly often
    enough, best first. A pair is taken from the first band whose key it shares, where it met first."""
    component, n, block = (np.asarray(rows.column(c).combine_chunks()) for c in ("component", "n", "block"))
    i, j, place = (rows.column(c)[0].as_py() for c in ("i", "j", "place"))
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    agree = np.zeros((len(left), len(right)), np.uint8)
    for k in range(sketch.shape[1]):
        agree += sketch[left, k][:, None] == sketch[right, k]
    share = percent / 100
    least = (share - SLACK * np.sqrt(share * (1 - share) / (BANDS * ROWS))) * sketch.shape[1]
    most, fewest = np.maximum(n[left][:, None], n[right]), np.minimum(n[left][:, None], n[right])
    fit = (component[left][:, None] != component[right]) & (100 * fewest >= percent * most) & (agree >= least)
    if i == j:
        fit = np.triu(fit)
    x, y = np.nonzero(fit)
    bands = np.asarray(rows.column("bands").combine_chunks().flatten()).reshape(rows.num_rows, -1)
    fresh = ~(bands[left[x], :place] == bands[right[y], :place]).any(axis=1)
    x, y = x[fresh], y[fresh]
    order = np.argsort(-agree[x, y].astype(np.int64), kind="stable")
    return left[x[order]], right[y[order]]


def _promising(percent: int):
    """Of a bucket's pair of blocks, the rows that are in a candidate pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            some = np.unique(np.concatenate(_candidates(rows, percent)))
            if len(some):
                yield from rows.take(pa.array(some)).to_batches()

    return run


def _settle(size: int, percent: int):
    """Confirms the candidate pairs of a bucket's pair of blocks on full sets, but those whose components
    have been joined there already; emits the links found, fewer than there are rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for rows in _grouped(batches):
            first, second = _candidates(rows, percent)
            words = hasher.words(rows.column("text").combine_chunks(), lower=True)
            row, hashes = shingle_sets(hasher, words, size)
            starts = np.searchsorted(row, np.arange(rows.num_rows + 1))
            doc, component = rows.column("doc").to_pylist(), rows.column("component").to_pylist()
            parent = {c: c for c in component}

            def root(c: int, parent=parent) -> int:
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            a, b = [], []
            for x, y in zip(first.tolist(), second.tolist(), strict=True):
                p, q = root(component[x]), root(component[y])
                if p != q and similar(hashes[starts[x] : starts[x + 1]], hashes[starts[y] : starts[y + 1]], percent):
                    parent[p] = q
                    a.append(doc[x])
                    b.append(doc[y])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _open_links(members: DataFrame, classes: DataFrame, label: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join components within buckets that still hold several."""
    rows = members.join(label.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("lo <> hi").select("key", "blocks")
    rows = rows.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    rows = rows.join(classes.select(F.col("rep").alias("doc"), "sketch", "bands"), "doc").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).select(*_OPEN)
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_promising(percent), _OPEN_SCHEMA)
    texts = docs.join(maybe_broadcast(store(rows), 540), "doc").select(*_OPEN, "text")
    return store(texts.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_settle(size, percent), "a long, b long"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row.

    Words are split at blanks, A-Z in lower case; a row's set is its distinct ``size``-word shingles, or
    with fewer words the whole sequence. Sets with 100 * intersection >= percent * union are linked;
    an empty or null text is linked with nothing. component_id is the smallest id reachable. Rows that
    share an id are one node: they are linked, and each is returned. A row with a null id has a null
    component and is kept. An empty table gives no rows. Only the id and the text are read.

    Rows with equal sets become one representative. Representatives that share a band are candidates in
    the shape of a star: the member of a bucket that meets most others over all its buckets, against the
    rest; links are confirmed on full sets. Where a bucket then still holds several components, its rows'
    sketches are compared block by block; pairs of different components that agree nearly often enough
    are confirmed on full sets in the same block, best first, until their components are joined. So pairs
    within a joined group are never expanded, no pair leaves a task unless it is a link, and no link
    that the bands and sketches show is lost.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(column).alias("text"))
    rows = store(texts.mapInArrow(_signatures(size, "text", "doc"), "doc long, n_shingles long, sig_a long, sig_b long, bands array<long>, sketch binary"))
    full = rows.where("n_shingles > 0 AND doc IS NOT NULL")
    classes = full.groupBy("sig_a", "sig_b", "n_shingles").agg(F.min(F.struct("doc", "bands", "sketch")).alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = store(classes.select("sig_a", "sig_b", F.col("n_shingles").alias("n"), F.col("least.doc").alias("rep"), "least.bands", "least.sketch", "copies"))
    keys = classes.select(F.col("rep").alias("doc"), "n", F.posexplode("bands").alias("place", "key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = store(keys.join(buckets, "key"))
    reach = members.groupBy("doc").agg(F.sum("m").alias("reach"))
    hubs = members.join(reach, "doc").groupBy("key").agg(F.max(F.struct("reach", (-F.col("doc")).alias("minus"), "n")).alias("hub"))
    hubs = hubs.select("key", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("hub_n"))
    alike = F.expr(f"100 * least(n, hub_n) >= {int(percent)} * greatest(n, hub_n)")
    tested = store(members.join(hubs, "key").where((F.col("doc") != F.col("hub")) & alike).select("hub", "doc").distinct())
    links = store(confirmed(tested, texts, size, percent))
    label = components(links)
    more = _open_links(members, classes, label, texts, size, percent)
    if more.limit(1).count():
        label = components(links.unionByName(more))
    # Copies follow their class; classes of one row need no join.
    classes = classes.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = classes.select("sig_a", "sig_b", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), F.col("rep"), "copies")
    placed = rows.drop("bands", "sketch").join(found.where("copies > 1 OR component_id <> rep").select("sig_a", "sig_b", "n_shingles", "component_id"), ["sig_a", "sig_b", "n_shingles"], "left")
    placed = placed.select(F.col("doc").alias(id_column), "n_shingles", F.expr("CASE WHEN n_shingles > 0 AND doc IS NOT NULL THEN coalesce(component_id, doc) ELSE doc END").alias("component_id"))
    return placed.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
