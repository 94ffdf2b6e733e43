"""Columns that are computed exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a one-row generator.

    A filter on a projected column is pushed below the projection and repeats its
    expression once per reference; for a regular expression tested against a list of
    tokens that is one evaluation per token. A generator's output is not pushed through,
    and it stays inside the same code-generated stage.
    """
    if not isinstance(df, DataFrame):
        return df.computed(cols)  # the stand-in for a table in a shared scan
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def exploded(df: DataFrame, name: str, values: Column) -> DataFrame:
    """A row for each element of an array column expression, as `name`."""
    if not isinstance(df, DataFrame):
        return df.exploded(name, values)
    return df.withColumn(name, F.explode(values))
