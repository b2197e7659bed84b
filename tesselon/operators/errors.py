"""Rows that cannot be worked on, kept aside in the pass that works on the others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tesselon.operators.stored import private_names, store


class FailedRows(RuntimeError):
    """A run that was asked to stop at errors had some."""


@dataclass(frozen=True)
class Split:
    """What a step made of its rows: the sound ones, those it could not work on with the error, and how many."""

    label: str
    rows: DataFrame
    failed: DataFrame
    total: int
    errors: int

    def or_fail(self) -> DataFrame:
        """The sound rows; an error where there are others."""
        if self.errors:
            raise FailedRows(f"{self.label}: {self.errors} of {self.total} rows failed")
        return self.rows


def split_errors(made: DataFrame, error: Column | str, label: str, keys: list[str] | None = None) -> Split:
    """Rows whose ``error`` (a text) is null, and the others as (keys, error), by default with all columns as keys.

    The step runs once: what it makes is written with its errors, counted on the way by an observation, and
    both sides read that. An empty table has no errors; a column named as ``error`` says is not among the rows.
    """
    own = private_names(made.columns, "error")[0]
    column = F.col(error) if isinstance(error, str) else error
    seen = Observation(label)
    told = made.withColumn(own, column.cast("string"))
    told = told.drop(error) if isinstance(error, str) else told
    kept = store(told.observe(seen, F.count(F.lit(1)).alias("total"), F.count(own).alias("errors")))
    counts = seen.get
    keys = [c for c in told.columns if c != own] if keys is None else keys
    failed = kept.where(F.col(own).isNotNull()).select(*keys, F.col(own).alias("error"))
    return Split(label, kept.where(F.col(own).isNull()).drop(own), failed, counts["total"], counts["errors"])
