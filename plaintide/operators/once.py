"""Expensive columns that are computed exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` behind a generator of one row.

    The optimizer moves filters below a projection and copies its expressions into
    them, so that a regular expression or a keyword scan would run twice or more.
    It does not look through a generator.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
