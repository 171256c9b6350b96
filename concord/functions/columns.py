"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each evaluated once a row.

    A plain projection's expression is copied to wherever a later filter or projection
    takes its column; for expressions as long as a parser's those copies multiply.
    These come out of a generator of one row, which the optimiser never copies.
    """
    named = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[f"`{c}`" for c in df.columns if c not in columns], F.inline(F.array(named)))
