"""Columns that are used often and computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, keep: list[str], *columns: Column, **named: Column) -> DataFrame:
    """The columns to keep and the new ones, computed once per row however often they are used after: two projections are
    collapsed into one, which repeats what is used twice, but not over a generator."""
    return df.select(*keep, F.inline(F.array(F.struct(*columns, *[c.alias(n) for n, c in named.items()]))))
