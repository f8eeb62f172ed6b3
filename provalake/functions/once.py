"""Evaluate costly columns once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns through a one-row generator.

    A plain ``withColumn`` is inlined wherever the column is used, in filters too, so a regular expression over a
    whole text would run once per use. The optimizer does not inline the output of a generator.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in cols.items()]))))


def let(value: Column, body) -> Column:
    """``body(value)`` inside an expression, with ``value`` evaluated once; the body must yield an array."""
    return F.element_at(F.transform(F.array(value), body), 1)
