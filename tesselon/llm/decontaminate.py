"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm._text import _PUNCT, Hasher, slices

#: Words of a seed, and the seeds that each item keeps of every run of RUN consecutive ones: the rarest. What an edited
#: copy has kept of its item is less rare than what it lost, so few seeds miss copies: with 3 of 8, a third of
#: those in which a word in six was exchanged.
SEED_WORDS, RUN, KEPT = 3, 8, 6
#: Benchmark words held by a worker at once; a larger benchmark is searched in blocks of items.
BLOCK_WORDS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Distinct seeds of an item that a stretch of text must hold to be aligned.
LEAST_SEEDS = 2
#: Words by which an alignment may leave the diagonals of its seeds, at most.
BAND = 64


@dataclass
class Items:
    """A block of benchmark items: their word hashes, and their seeds sorted by hash."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_place: np.ndarray


def _word_hashes(texts: list[str]) -> tuple[list[np.ndarray], Hasher]:
    hasher = Hasher()
    words = hasher.words(pa.array([t or "" for t in texts], pa.large_string()), lower=True, breaks=_PUNCT)
    return [words.hashes[words.first[i] : words.first[i + 1]] for i in range(len(texts))], hasher


def make_items(rows: list[tuple]) -> Items:
    """rows: (id, text). Items of fewer words than a seed have one seed, their whole text."""
    words, hasher = _word_hashes([t for _, t in rows])
    seeds, item, place = [], [], []
    for i, w in enumerate(words):
        if len(w):
            n = min(SEED_WORDS, len(w))
            first = np.arange(len(w) - n + 1)
            seeds.append(hasher.spans(w, first, first + n))
            item.append(np.full(len(first), i))
            place.append(first)
    if not seeds:
        return Items([r[0] for r in rows], words, *(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)))
    seeds, item, place = np.concatenate(seeds), np.concatenate(item), np.concatenate(place)
    order = np.argsort(seeds, kind="stable")
    return Items([r[0] for r in rows], words, seeds[order], item[order], place[order])


def rarest(items: Items, seeds: np.ndarray, counts: np.ndarray) -> Items:
    """Keeps of each item's consecutive seeds the KEPT rarest of every RUN, by their counts in the corpus: counts[i]
    is that of seeds[i], which are sorted; others have none."""
    frequency = np.zeros(len(items.seeds), np.int64)
    if len(seeds):
        at = np.minimum(np.searchsorted(seeds, items.seeds), len(seeds) - 1)
        frequency = np.where(seeds[at] == items.seeds, counts[at], 0)
    run = items.seed_place // RUN
    order = np.lexsort((items.seed_place, frequency, run, items.seed_item))
    item, run = items.seed_item[order], run[order]
    new = np.append(len(order) > 0, (item[1:] != item[:-1]) | (run[1:] != run[:-1]))
    first = np.flatnonzero(new)
    rank = np.arange(len(order)) - first[np.cumsum(new) - 1] if len(order) else order
    keep = np.zeros(len(order), bool)
    keep[order[rank < KEPT]] = True
    return Items(items.ids, items.words, items.seeds[keep], items.seed_item[keep], items.seed_place[keep])


def smith_waterman(a: np.ndarray, b: np.ndarray, low: int | None = None, high: int | None = None) -> tuple[int, int, int]:
    """(best local score, first and last word of b in that alignment), with linear gaps, among the cells whose
    diagonal (place in b less place in a) is low .. high; by default all."""
    low, high = (-len(a) if low is None else low), (len(b) if high is None else high)
    width = high - low + 1
    lanes = np.arange(width)
    # Lane k of row i is the cell (i, i + low + k - 1): its diagonal neighbour is in the same lane of the row before.
    padded = np.zeros(len(a) + width + 1, np.uint64)
    sound = np.zeros(len(padded), bool)
    x, y = max(0, low), min(len(b), len(a) + high)
    if y > x:
        padded[x - low : y - low], sound[x - low : y - low] = b[x:y], True
    value, start = np.zeros(width, np.int64), lanes + low
    best, span = 0, (0, 0)
    for i, word in enumerate(a):
        place = i + low + lanes  # word of b that each lane reads
        inside = sound[i : i + width]
        diagonal = np.where(inside, value + np.where(padded[i : i + width] == word, MATCH, MISMATCH), 0)
        down = np.append(value[1:], 0) + GAP
        cell = np.maximum(np.maximum(diagonal, down), 0)
        origin = np.where(cell == 0, place + 1, np.where(diagonal >= down, start, np.append(start[1:], 0)))
        # A gap in a: the best value further left, less one for each word skipped.
        level = cell - GAP * lanes
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, lanes, 0))
        value, start = top + GAP * lanes, origin[source]
        value = np.where(inside, np.maximum(value, 0), 0)
        j = int(value.argmax())
        if value[j] > best:
            best, span = int(value[j]), (int(start[j]), int(place[j]))
    return best, *span


def passages(places: np.ndarray, offsets: np.ndarray, item_words: int) -> list[tuple[int, int]]:
    """Ranges of diagonals, with a margin, that alignments through the seeds lie in; far apart ones are told apart."""
    margin = min(BAND, item_words // 2 + 4)
    diagonals = np.unique(places - offsets)
    cuts = np.flatnonzero(np.diff(diagonals) > 2 * margin) + 1
    return [(int(part[0]) - margin, int(part[-1]) + margin) for part in np.split(diagonals, cuts)]


def _probe(seeds: np.ndarray, sorted_seeds: np.ndarray) -> np.ndarray:
    """Indexes of the seeds that stand in sorted_seeds."""
    if not len(sorted_seeds) or not len(seeds):
        return np.zeros(0, np.int64)
    # A bitmap of the seeds' low bits spares most of the searches.
    bits = np.uint64((1 << 22) - 1)
    table = np.zeros(1 << 22, bool)
    table[sorted_seeds & bits] = True
    near = np.flatnonzero(table[seeds & bits])
    at = np.searchsorted(sorted_seeds, seeds[near])
    return near[sorted_seeds[np.minimum(at, len(sorted_seeds) - 1)] == seeds[near]]


def _grams(hasher: Hasher, batch: pa.RecordBatch, column: str):
    words = hasher.words(batch.column(batch.schema.get_field_index(column)), lower=True, breaks=_PUNCT)
    row, pos, hashes = hasher.windows(words, SEED_WORDS)
    short = np.flatnonzero((words.counts > 0) & (words.counts < SEED_WORDS))
    if len(short):
        row, pos = np.concatenate([row, short]), np.concatenate([pos, np.zeros(len(short), np.int64)])
        hashes = np.concatenate([hashes, hasher.spans(words.hashes, words.first[:-1][short], words.first[1:][short])])
    return words, row, pos, hashes


def _count_seeds(block, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hasher = block.value, Hasher()
        known, counts = np.unique(items.seeds), None
        for batch in slices(batches, column):
            _, _, _, hashes = _grams(hasher, batch, column)
            hit = hashes[_probe(hashes, known)]
            counts = (0 if counts is None else counts) + np.bincount(np.searchsorted(known, hit), minlength=len(known))
        if counts is not None:
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(counts[some].astype(np.int64))], names=["seed", "n"])

    return run


def copies_found(items: Items, hasher: Hasher, batch: pa.RecordBatch, column: str, least: float) -> list[tuple]:
    """(row, item id, score, first word, last word) for each row and item that align well enough."""
    words, row, pos, hashes = _grams(hasher, batch, column)
    hit = _probe(hashes, items.seeds)
    # A seed may stand in several items.
    lo, hi = np.searchsorted(items.seeds, hashes[hit]), np.searchsorted(items.seeds, hashes[hit], "right")
    many = hi - lo
    which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    r, p, item, place = np.repeat(row[hit], many), np.repeat(pos[hit], many), items.seed_item[which], items.seed_place[which]
    order = np.lexsort((p, item, r))
    r, p, item, place = r[order], p[order], item[order], place[order]
    new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (item[1:] != item[:-1]))) if len(r) else np.zeros(0, np.int64)
    found: list[tuple] = []
    for a, b in zip(new, np.append(new[1:], len(r)), strict=True) if len(r) else ():
        own = items.words[item[a]]
        if len(np.unique(place[a:b])) < min(LEAST_SEEDS, max(1, len(own) - SEED_WORDS + 1)):
            continue
        text = words.hashes[words.first[r[a]] : words.first[r[a] + 1]]
        best = (0.0, 0, 0)
        for low, high in passages(p[a:b], place[a:b], len(own)):
            x, y = max(0, low), min(len(text), len(own) + high)
            score, first, last = smith_waterman(own, text[x:y], low - x, high - x)
            best = max(best, (score / (MATCH * len(own)), x + first, x + last))
        if best[0] >= least:
            found.append((int(r[a]), items.ids[item[a]], *best))
    return found


def _align(block, column: str, id_column: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, column):
            found = copies_found(block.value, hasher, batch, column, least)
            ids = batch.column(batch.schema.get_field_index(id_column)).take(pa.array([f[0] for f in found], pa.int64()))
            rest = [pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, *rest], names=[id_column, "item_id", "score", "first_word", "last_word"])

    return run


def _keep_clean(block, column: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, column):
            clean = np.ones(batch.num_rows, bool)
            clean[[f[0] for f in copies_found(block.value, hasher, batch, column, least)]] = False
            yield batch.filter(pa.array(clean))

    return run


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_WORDS words, read one partition at a time."""
    block, amount = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).where("item_id IS NOT NULL").toLocalIterator():
        size = text.count(" ") + text.count("\n") + 1
        if block and amount + size > BLOCK_WORDS:
            yield block
            block, amount = [], 0
        block.append((item_id, text))
        amount += size
    if block:
        yield block


def rare_blocks(docs: DataFrame, benchmark: DataFrame, column: str) -> Iterator:
    """Broadcast blocks of items with the seeds that are rare in the documents."""
    context = docs.sparkSession.sparkContext
    for rows in item_blocks(benchmark):
        items = make_items(rows)
        counts = docs.select(column).mapInArrow(_count_seeds(context.broadcast(items), column), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
        table = counts.toArrow()  # at most one row of 16 bytes for each of the block's seeds: BLOCK_WORDS bounds it
        seeds, n = (table.column(i).to_numpy() for i in range(2))
        order = np.argsort(seeds.view(np.uint64))
        yield context.broadcast(rarest(items, seeds.view(np.uint64)[order], n[order]))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.4, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, item_id, score, first_word, last_word) for each document and benchmark item that it holds a copy of.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case. Seeds
    are three-word grams of the items; of every eight consecutive ones the six rarest in the corpus
    count (by their frequency in all documents, so that a leaked item keeps seeds however often it
    leaked). A document with two seeds of an item is aligned with it by words, at most BAND words
    off the diagonals of its seeds, matches 2, mismatches and gaps -1; score is the best local score as a share of a full match, 1 for an exact
    copy, and pairs below ``least`` are left out: an edited copy of which four words in five are left
    has about 0.7. first_word and last_word are the aligned words of the document. Null and empty texts
    match nothing, nor do items without words or id; texts and items of any length are searched whole, an
    alignment holding one row of its band at a time. Repeated rows of documents or items give repeated
    rows. Without documents or items there are no rows. Other columns are not read.

    Scale: no shuffle of documents or seeds. The benchmark is the stated query set; it is broadcast in
    blocks of at most BLOCK_WORDS words, each block in one pass for the counts and one for the search.
    A passage shared by a third of all documents makes one alignment in each of them.
    """
    docs = docs.select(id_column, column)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, item_id long, score double, first_word long, last_word long"
    out = None
    for block in rare_blocks(docs, benchmark, column):
        part = docs.mapInArrow(_align(block, column, id_column, least), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.4, column: str = "text") -> DataFrame:
    """The rows that hold no copy of a benchmark item, as ``contaminated`` finds them."""
    clean = docs
    for block in rare_blocks(docs, benchmark, column):
        clean = clean.mapInArrow(_keep_clean(block, column, least), docs.schema)
    return clean
