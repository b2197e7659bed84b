"""Mixing sources to target weights: capped water-filling and seeded sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.llm._shared import maybe_broadcast, private_names, store

#: A source's documents are ordered by so many hexadecimal digits of a seeded hash, in 4096 cells.
CELL_DIGITS = 3


def word_count(text: F.Column) -> F.Column:
    """Number of words between ASCII blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: F.Column, max_epochs: float) -> DataFrame:
    """Adds ``target`` to rows (weight, source_size): the fixed point of clamping sources at their cap
    and sharing what is left by weight.

    The clamped sources are those with the smallest cap for their weight, so one ordered pass finds
    where clamping stops: the level at which the sources behind share what those before leave over.
    There is one row for each source, never for each document.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ordered = Window.orderBy(F.col("_cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    rows = sources.withColumn("_cap", cap).withColumn("_budget", budget)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("_behind", F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = (F.col("_budget") - F.col("_before")) / F.col("_behind")
    # Up to the first source whose cap holds its share, levels rise; behind it they fall. All before it are clamped.
    rows = rows.withColumn("_level", F.max(F.when(F.col("_cap") >= F.col("weight") * level, level)).over(everything))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * F.col("_level")))
    return rows.withColumn("target", target).drop("_cap", "_budget", "_before", "_behind", "_level")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    column: str = "text",
    id_column: str = "doc_id",
    source_column: str = "source",
) -> DataFrame:
    """The documents with size, source_size, target and taken (words the mix takes, repeats counted).

    Sources in order of their code points, null last, weigh ``weights``, repeating. They share
    ``share`` times the words of all rows; no target exceeds ``max_epochs`` times the source's words, and
    the excess goes to the other sources by weight until none is above. Each document of a source is
    taken ``floor(target / source_size)`` times whole. For the rest, documents are ordered by a seeded
    hash of the id; those before a threshold are taken once more, and those in the threshold's
    own cell in part: their first words, in proportion, rounded up or down by the same hash. So a
    source's taken words meet its target but for that rounding, and no document exceeds
    ceil(max_epochs) times its size. Rows with equal or null ids share a cell. A row of no words
    takes none; a source of no words has target 0. An empty table gives no rows. A text of any length
    is counted whole. Other columns pass through, whatever their names; columns named size, source_size,
    target and taken are replaced.

    Scale: words are counted once for each document; everything else works on sums for each source
    and cell, at most 4096 rows a source, combined on the map side, so a source with a third of all
    rows is no hot group. Ranks and levels are an order over all sources, one row each, in one task. The written sums reach the documents by a join on (source, cell), broadcast
    if they are small.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    key, at, words, cell, unit, whole, part = private_names([*docs.columns, "size", "source_size", "target", "taken"], "source", "at", "words", "cell", "unit", "whole", "part")
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    hexed = lambda start, digits: F.conv(F.substring(draw, start, digits), 16, 10)
    sized = docs.withColumns({"size": word_count(F.col(column)), cell: hexed(1, CELL_DIGITS).cast("int"), unit: hexed(9, 8).cast("double") / F.lit(float(1 << 32))})
    cells = sized.groupBy(F.col(source_column).alias(key), F.col(cell).alias(at)).agg(F.sum("size").alias(words))
    per_source = cells.groupBy(key).agg(F.sum(words).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col(key).asc_nulls_last()))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per_source.withColumn("rank", rank).withColumn("weight", F.element_at(table, F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    targets = water_fill(ranked, budget, max_epochs).select(F.col(key).alias("s"), "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = cells.join(targets, F.col(key).eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumns({whole: F.floor(epochs), "end": F.sum(words).over(Window.partitionBy(key).orderBy(at))})
    rest = F.col("target") - F.col(whole) * F.col("source_size")
    # 1 for a cell wholly before the rest is filled, 0 behind it, a fraction for the one in between.
    fraction = F.when(F.col(words) == 0, 0.0).otherwise((rest - (F.col("end") - F.col(words))) / F.col(words))
    plan = plan.select(key, at, "source_size", "target", whole, F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)).alias(part))
    plan = maybe_broadcast(store(plan), 200)
    joined = sized.join(plan, F.col(source_column).eqNullSafe(F.col(key)) & (F.col(cell) == F.col(at)))
    extra = F.least(F.col("size"), F.floor(F.col(part) * F.col("size") + F.col(unit)))
    names = [*(f"`{c}`" for c in docs.columns), "size", "source_size", "target"]
    return joined.select(*names, (F.col(whole) * F.col("size") + extra).cast("long").alias("taken"))


def first_words(text: F.Column, count: F.Column) -> F.Column:
    """The text up to the end of its first ``count`` words."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), count), "")


def mixture(docs: DataFrame, column: str = "text", **options) -> DataFrame:
    """The mix itself: a row for each time that ``mix_sources`` takes a document, with size, source_size, target,
    taken (the words of this row) and epoch (from 0).

    Documents of which no words are taken are left out; whole repetitions have the whole text; the last,
    taken in part, has the text up to the end of its first words. Options, odd rows and scale are those
    of mix_sources, whose counts the rows add up to; a column named epoch is replaced.
    """
    mixed = mix_sources(docs.drop("epoch"), column=column, **options).where("taken > 0")
    repeats = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.withColumn("epoch", F.explode(F.sequence(F.lit(0), repeats - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    rows = rows.withColumn("taken", words)
    return rows.withColumn(column, F.when(F.col("taken") < F.col("size"), first_words(F.col(column), F.col("taken").cast("int"))).otherwise(F.col(column)))


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken for every document."""
    return mix_sources(docs.select("doc_id", "source", "text"), **options).select("doc_id", "size", "source_size", "target", "taken")
