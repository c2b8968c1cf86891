"""Counts, shares, cross tables and samples per label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Rows per value, null counted as a value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def distribution(
    df: DataFrame, column: str, count_name: str = "count", share_name: str = "proportion"
) -> DataFrame:
    """Rows per value and their share of all rows; the counts are shuffled once and read by both."""
    counts = value_counts(df, column, count_name)
    return counts.withColumn(share_name, F.col(count_name) / counts.agg(F.sum(count_name)).scalar())


def negative_distribution(df: DataFrame, column: str = "issue_label") -> DataFrame:
    negative = df.filter((F.col("sentiment_label") == "negative") & F.col(column).isNotNull())
    return distribution(negative, column, "negative_count", "negative_proportion")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``row`` by ``column``; the given values are the columns."""
    return (
        df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(row)
        .agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    )


def crosstab_shares(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Cross table with every row divided by its sum."""
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    counts = crosstab(df, row, column, values).withColumn("_total", total)
    return counts.select(row, *[(F.col(v) / F.col("_total")).alias(v) for v in values])


def mean_by(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Mean per group, without nulls and NaN."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.avg(F.nanvl(F.col(value), F.lit(None).cast("double"))).alias(name))
    )


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: missing count and number of rows, in a single pass."""
    names = list(columns or df.columns)
    kinds = dict(df.dtypes)
    gone = [
        F.count_if(F.isnull(c) | F.isnan(c) if kinds[c] in ("double", "float") else F.isnull(c)).alias(c)
        for c in names
    ]
    return df.agg(F.count(F.lit(1)).alias("row_count"), *gone).unpivot(
        "row_count", names, "column_name", "missing_count"
    )


def rating_distribution(df: DataFrame) -> DataFrame:
    return value_counts(df, "rating").orderBy(F.col("rating").asc_nulls_last())


def label_samples(
    df: DataFrame, label: str, order: str, n: int = 3, width: int = 300, text_col: str = "review_text"
) -> DataFrame:
    """The first ``n`` texts of every label, shortened for printing.

    The rank filter is pushed below the shuffle, so each task sends at most ``n``
    rows per label.
    """
    place = Window.partitionBy(label).orderBy(order)
    return (
        df.filter(F.col(label).isNotNull() & F.col(text_col).isNotNull())
        .select(label, order, F.concat(F.substring(text_col, 1, width), F.lit("...")).alias("sample"))
        .withColumn("sample_no", F.row_number().over(place))
        .filter(F.col("sample_no") <= n)
        .select(label, "sample_no", "sample")
    )
