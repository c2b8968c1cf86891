"""Dense ids 1..n in a given order, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

LOW_BITS = 13
MID_BITS = 38


def dense_id(df: DataFrame, order: str, name: str) -> DataFrame:
    """Add ``name`` = 1..n in ascending order of the unique integer ``order``.

    The order is cut into buckets of 2**13 consecutive values.  As the values are
    unique, no bucket holds more rows than that, however the data is distributed; whole
    rows move by bucket, so a bucket of long texts is still a few MB.
    Rows are numbered inside their bucket and shifted by the number of rows in
    lower buckets.  That prefix sum runs over bucket counts in two levels, each
    window limited to 2**25 counts by construction.
    """
    bucketed = df.withColumn("_bucket", F.shiftright(F.col(order).cast("bigint"), LOW_BITS))
    counts = (
        bucketed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_top", F.shiftright("_bucket", MID_BITS - LOW_BITS))
    )
    within = Window.partitionBy("_top").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = counts.groupBy("_top").agg(F.sum("_n").alias("_sum"))
    across = Window.orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_top", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_base"))
    offsets = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(tops, "_top")
        .select("_bucket", (F.col("_base") + F.col("_before")).alias("_offset"))
    )
    place = Window.partitionBy("_bucket").orderBy(order)
    return (
        bucketed.withColumn("_place", F.row_number().over(place))
        .join(offsets, "_bucket")
        .select((F.col("_offset") + F.col("_place")).cast("bigint").alias(name), *df.columns)
    )


def small_rank(df: DataFrame, name: str, *order) -> DataFrame:
    """``row_number`` over a table of clusters or labels, or one already limited."""
    return df.select(F.row_number().over(Window.orderBy(*order)).alias(name), *df.columns)


def top_ids(keys: DataFrame, n: int, *order, fan_in: int = 512) -> DataFrame:
    """The first ``n`` rows of ``keys``, the columns of ``order`` and an id, merged in two steps.

    A plain sort with limit sends ``n`` rows of every task to one task.  Here the
    tasks are merged in ``fan_in`` groups first, so the last step sees at most
    ``n * fan_in`` narrow rows on a cluster of any size.
    """
    group = Window.partitionBy("_group").orderBy(*order)
    merged = (
        keys.withColumn("_group", F.spark_partition_id() % fan_in)
        .withColumn("_nth", F.row_number().over(group))
        .filter(F.col("_nth") <= n)
        .drop("_group", "_nth")
    )
    return merged.orderBy(*order).limit(n)


def top_rows(df: DataFrame, n: int, *order, keys: list[str], ident: str) -> DataFrame:
    """The first ``n`` rows in ``order``: ranked by ``keys`` and the unique ``ident`` alone, then fetched."""
    return df.join(top_ids(df.select(*dict.fromkeys([*keys, ident])), n, *order).select(ident), ident, "left_semi")


def most_frequent(counts: DataFrame, n: int | None, total: str, term: str, prefix: int = 3) -> DataFrame:
    """The ``n`` rows with the largest ``total``, the smaller ``term`` on a tie; all rows without ``n``.

    No rows are sorted to find them.  How many rows have each total tells the lowest
    total that still gets in; of the rows that tie there, counts by the first letters
    tell which get in whole, and only those with the letters in between are ranked.
    """
    if n is None:
        return counts
    down = Window.orderBy(F.desc(total)).rowsBetween(Window.unboundedPreceding, -1)
    levels = counts.groupBy(total).agg(F.count(F.lit(1)).alias("_n"))
    levels = levels.withColumn("_above", F.coalesce(F.sum("_n").over(down), F.lit(0))).filter(F.col("_above") < n)
    cut = levels.agg(F.min(F.struct(F.col(total).alias("total"), (F.lit(n) - F.col("_above")).alias("room"))).alias("c")).scalar()
    marked = counts.withColumn("_cut", cut).filter(F.col(total) >= F.col("_cut.total"))
    above = marked.filter(F.col(total) > F.col("_cut.total")).select(*counts.columns)
    ties = marked.filter(F.col(total) == F.col("_cut.total")).withColumn("_head", F.substring(term, 1, prefix))
    up = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    heads = ties.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"), F.min("_cut.room").alias("_room"))
    heads = heads.withColumn("_before", F.coalesce(F.sum("_n").over(up), F.lit(0))).filter(F.col("_before") < F.col("_room"))
    inside = Window.partitionBy("_head").orderBy(term)
    ranked = ties.join(heads.drop("_n", "_room"), "_head").withColumn("_nth", F.col("_before") + F.row_number().over(inside))
    return above.unionByName(ranked.filter(F.col("_nth") <= F.col("_cut.room")).select(*counts.columns))
