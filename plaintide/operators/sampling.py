"""Reproducible samples and splits.

Rows are drawn in the order of ``md5(seed:id)``, so a sample depends only on the
ids and the seed, not on the partitioning.  The first hex digits of the hash cut a
stratum into a million buckets of nearly equal size.  Counting the buckets (a map-side
aggregate) tells which of them can hold drawn rows; only rows of those are ranked.
No stratum is ever sorted or moved as a whole, however large it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaintide import rules
from plaintide.functions.text import strip
from plaintide.operators.annotate import fill_issue_label
from plaintide.operators.cleaning import usable_reviews
from plaintide.operators.ids import small_rank
from plaintide.schema import ANNOTATION_COLUMNS, require_columns

BUCKET_DIGITS = 5
BUCKETS = 16**BUCKET_DIGITS


def draw_key(ident: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")).cast("binary"))


def _hashed(df: DataFrame, ident: str, seed: int) -> DataFrame:
    return df.withColumn("_hash", draw_key(F.col(ident), seed)).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )


def _bucket_starts(hashed: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows per bucket and rows of the stratum in lower buckets."""
    lower = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        hashed.groupBy(*strata, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
    )


def first_by_hash(
    df: DataFrame, ident: str, n: int, strata: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """Exactly the first ``n`` ids of every stratum, with their ``_hash`` and ``_rank``.

    Strata are not null.
    """
    hashed = _hashed(df.select(*strata, ident), ident, seed)
    wanted = _bucket_starts(hashed, strata).filter(F.col("_before") < n).drop("_n")
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_hash", ident)
    return (
        hashed.join(wanted, [*strata, "_bucket"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(inside))
        .filter(F.col("_rank") <= n)
        .select(*strata, ident, "_hash", "_rank")
    )


def sample_n(df: DataFrame, n: int, ident: str = "review_id", seed: int = 42) -> DataFrame:
    """``n`` random rows, or all rows when there are fewer."""
    drawn = first_by_hash(df, ident, n, seed=seed).select(ident)
    return df.join(drawn, ident, "left_semi")


def cap_per_class(
    df: DataFrame, cap: int, label: str, labels: Sequence[str], ident: str = "review_id", seed: int = 42
) -> DataFrame:
    """At most ``cap`` random rows of every class."""
    rows = df.filter(F.col(label).isin(list(labels)))
    drawn = first_by_hash(rows, ident, cap, [label], seed).select(ident)
    return rows.join(drawn, ident, "left_semi")


def _pick(candidates: DataFrame, target: Column, ident: str, group: str, stratum: str) -> DataFrame:
    """Mark ``_picked`` rows: a quota per stratum, then any others, ``target`` in all.

    Drawing by one hash order, both the fill-up and the trim are the first rows by
    (over quota, hash) of the group.
    """
    present = F.size(F.collect_set(stratum).over(Window.partitionBy(group)))
    quota = F.greatest(F.lit(1), F.floor(target / present))
    order = Window.partitionBy(group).orderBy(F.col("_rank") > F.col("_quota"), "_hash", ident)
    return (
        candidates.withColumn("_quota", quota)
        .withColumn("_picked", F.row_number().over(order) <= target)
        .drop("_quota")
    )


def stratified_sample(
    df: DataFrame,
    target: int,
    stratum: str = "rule_issue_label",
    ident: str = "review_id",
    seed: int = 42,
) -> DataFrame:
    """``target`` rows spread evenly over the strata, filled up from the rest."""
    drawn = first_by_hash(df, ident, target, [stratum], seed).withColumn("_all", F.lit(1))
    picked = _pick(drawn, F.lit(target), ident, "_all", stratum).filter("_picked").select(ident)
    return df.join(picked, ident, "left_semi")


def sentiment_targets(total: int) -> dict[str, int]:
    negative, neutral = int(total * rules.NEGATIVE_SHARE), int(total * rules.NEUTRAL_SHARE)
    return dict(zip(rules.SENTIMENTS, [negative, neutral, total - negative - neutral]))


def annotation_candidates(df: DataFrame, ident: str = "review_id") -> DataFrame:
    """(id, sentiment, issue) of every row that may be annotated; missing issues come from keywords."""
    require_columns(df, [ident, "review_text", "rating", "sentiment_label", "issue_label"])
    usable = fill_issue_label(usable_reviews(df)).withColumnRenamed("issue_label", "rule_issue_label")
    return usable.filter(F.col("sentiment_label").isin(rules.SENTIMENTS)).select(ident, "sentiment_label", "rule_issue_label")


def annotation_sample(
    df: DataFrame, total: int = 2000, seed: int = 42, ident: str = "review_id", candidates: DataFrame | None = None
) -> DataFrame:
    """Sample for annotators: sentiment quotas, issues spread evenly, ids in random order.

    At most ``total`` rows per (sentiment, issue) can be drawn, so the ranking steps see a
    table whose size the parameters fix.  The candidates are read twice, to count and to
    rank: a job gives them as a table, so that texts are searched for keywords once.
    """
    narrow = annotation_candidates(df, ident) if candidates is None else candidates

    groups = ["sentiment_label", "rule_issue_label"]
    drawn = first_by_hash(narrow, ident, total, groups, seed)
    target = F.lit(0)
    for sentiment, share in sentiment_targets(total).items():
        target = F.when(F.col("sentiment_label") == sentiment, share).otherwise(target)
    picked = _pick(drawn, target, ident, *groups)
    # Where the sentiments together miss the total, the lowest hashes of the rest fill up.
    picked = small_rank(picked, "_place", ~F.col("_picked"), "_hash", ident).filter(F.col("_place") <= total)
    numbered = small_rank(picked, "annotation_id", "_hash", ident).select(
        F.col("annotation_id").cast("bigint"), ident, "rule_issue_label"
    )
    return (
        df.select(ident, "review_text", "rating", "sentiment_label")
        .join(numbered, ident)
        .withColumns(
            {
                "review_text": strip(F.col("review_text")),
                "manual_issue_label": F.lit(""),
                "annotation_note": F.lit(""),
            }
        )
        .select(*ANNOTATION_COLUMNS)
    )


def _largest_remainder(df: DataFrame, count: str, draws: Column, name: str, label: str) -> DataFrame:
    """Share ``draws`` out over the classes in proportion to ``count``."""
    everything = Window.partitionBy()
    exact = F.col(count) / F.sum(count).over(everything) * draws
    by_rest = Window.orderBy(F.desc("_rest"), label)
    return (
        df.withColumn("_exact", exact)
        .withColumn("_floor", F.floor("_exact"))
        .withColumn("_rest", F.col("_exact") - F.col("_floor"))
        .withColumn("_open", draws - F.sum("_floor").over(everything))
        .withColumn(name, F.col("_floor") + (F.row_number().over(by_rest) <= F.col("_open")).cast("int"))
        .drop("_exact", "_floor", "_rest", "_open")
    )


def split_quotas(df: DataFrame, label: str, test: float = 0.2, validation: float = 0.15) -> DataFrame:
    """Rows of each class for test and validation (one row per class)."""
    everything = Window.partitionBy()
    total = F.sum("_count").over(everything)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_count"))
    counts = counts.withColumn("_draws", total - F.ceil(F.lit(float(test)) * total))
    kept = _largest_remainder(counts, "_count", F.col("_draws"), "_kept", label)
    rest = F.sum("_kept").over(everything)
    kept = kept.withColumn("_draws", rest - F.ceil(F.lit(float(validation)) * rest))
    final = _largest_remainder(kept, "_kept", F.col("_draws"), "_train", label)
    return final.select(
        label,
        (F.col("_count") - F.col("_kept")).alias("_test"),
        (F.col("_kept") - F.col("_train")).alias("_validation"),
    )


def stratified_split(
    df: DataFrame,
    label: str,
    labels: Sequence[str],
    test: float = 0.2,
    validation: float = 0.15,
    ident: str = "review_id",
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` = test / validation / train with exact class quotas.

    A class has two cuts in its hash order.  Rows in buckets before, between and after
    them need no ranking; only the (at most two) buckets with a cut inside are ranked.
    The cuts, a row per class of ``labels``, travel to the rows: moved by class, a table with
    a few labels would be a few tasks.
    """
    rows = df.filter(F.col(label).isin(list(labels)))
    hashed = _hashed(rows, ident, seed)
    quotas = split_quotas(rows, label, test, validation)
    starts = _bucket_starts(hashed.select(label, "_bucket"), [label]).join(quotas, label)
    first, second = F.col("_test"), F.col("_test") + F.col("_validation")
    start, end = F.col("_before"), F.col("_before") + F.col("_n")

    def last_before(cut: Column) -> Column:
        return F.coalesce(F.max(F.when(end <= cut, F.col("_bucket"))), F.lit(""))

    def around(cut: Column) -> Column:
        return F.max(F.when((start < cut) & (end > cut), F.struct("_bucket", "_before")))

    cuts = starts.groupBy(label, "_test", "_validation").agg(
        last_before(first).alias("_last_test"),
        last_before(second).alias("_last_validation"),
        around(first).alias("_edge_1"),
        around(second).alias("_edge_2"),
    )
    bucket = F.col("_bucket")
    edge = F.when(bucket == F.col("_edge_1._bucket"), F.col("_edge_1._before")).when(
        bucket == F.col("_edge_2._bucket"), F.col("_edge_2._before")
    )
    placed = hashed.join(F.broadcast(cuts), label).withColumn("_start", edge)
    whole = F.when(bucket <= F.col("_last_test"), "test").when(bucket <= F.col("_last_validation"), "validation")
    inside = Window.partitionBy(label, "_bucket").orderBy("_hash", ident)
    ranked = placed.filter(F.col("_start").isNotNull()).withColumn(
        "_rank", F.col("_start") + F.row_number().over(inside)
    )
    by_rank = F.when(F.col("_rank") <= first, "test").when(F.col("_rank") <= second, "validation")
    return (
        placed.filter(F.col("_start").isNull())
        .select(*df.columns, whole.otherwise("train").alias("split"))
        .unionByName(ranked.select(*df.columns, by_rank.otherwise("train").alias("split")))
    )
