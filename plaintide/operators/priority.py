"""Priority of clusters and the listings made of it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaintide import rules
from plaintide.functions import text
from plaintide.operators.ids import small_rank
from plaintide.schema import PRIORITY_COLUMNS, require_columns, select_existing, with_defaults

CLIP = 600


def minmax(value: Column) -> Column:
    """Min-max scaling over a table of clusters; a constant column gives 1 for all."""
    everything = Window.partitionBy()
    low, high = F.min(value).over(everything), F.max(value).over(everything)
    return F.when(high == low, 1.0).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def minmax_normalize(df: DataFrame, column: str, name: str) -> DataFrame:
    """The same for a table of any size: the two ends are one row, joined by broadcast."""
    value = text.to_numeric(F.col(column), 0.0)
    ends = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("e")).scalar()
    return (
        df.withColumn("_ends", ends)
        .withColumn(
            name,
            F.when(F.col("_ends.high") == F.col("_ends.low"), 1.0).otherwise(
                F.try_divide(value - F.col("_ends.low"), F.col("_ends.high") - F.col("_ends.low"))
            ),
        )
        .drop("_ends")
    )


def priority_scores(df: DataFrame, weights: Mapping[str, float] = rules.PRIORITY_WEIGHTS) -> DataFrame:
    """Score 0..100 and rank of every cluster; works on a table of clusters.

    Missing optional columns get neutral defaults.  Equal scores rank by cluster id.
    Counts may come as text or with decimals; they are whole numbers in the result.
    """
    require_columns(df, ["cluster_id", "cluster_theme", "cluster_size", "major_issue", "top_keywords"])
    defaults = {
        "negative_ratio": F.lit(1.0),
        "avg_issue_confidence": F.lit(0.5),
        "major_issue_count": F.col("cluster_size"),
    }
    size, count = F.col("cluster_size"), F.col("major_issue_count")
    numbers = with_defaults(df, defaults).withColumns(
        {
            "cluster_size": text.to_numeric(size, 0.0),
            "negative_ratio": text.to_numeric(F.col("negative_ratio"), 1.0),
            "avg_issue_confidence": text.to_numeric(F.col("avg_issue_confidence"), 0.5),
            "major_issue_count": text.to_numeric(count, 0.0),
        }
    )
    numbers = numbers.withColumn("issue_concentration", count / F.when(size == 0, 1.0).otherwise(size))
    scored = numbers.withColumns(
        {
            "cluster_size_score": minmax(size),
            "issue_concentration_score": minmax(F.col("issue_concentration")),
            "confidence_score": minmax(F.col("avg_issue_confidence")),
            "negative_ratio_score": minmax(F.col("negative_ratio")),
            "growth_proxy_score": F.lit(rules.GROWTH_PROXY),
        }
    )
    parts = [F.lit(float(w)) * F.col(name) for name, w in weights.items()]
    share = parts[0]
    for part in parts[1:]:
        share = share + part
    # Half to even on the scaled double, unlike F.round.
    scored = scored.withColumn("priority_score", F.rint(share * 100 * 100) / 100)
    ranked = small_rank(scored, "priority_rank", F.desc("priority_score"), F.asc("cluster_id"))
    reviews = [c for c in ranked.columns if c.startswith("representative_review_")]
    whole = {c: F.col(c).cast("bigint") for c in ("cluster_size", "major_issue_count")}
    ranked = ranked.withColumns({c: text.clip(F.col(c), CLIP) for c in reviews} | whole)
    return select_existing(ranked, PRIORITY_COLUMNS)


def review_list(df: DataFrame) -> Column:
    """The representative reviews that are not blank, stripped, as one array."""
    columns = [f"representative_review_{i}" for i in (1, 2, 3) if f"representative_review_{i}" in df.columns]
    cleaned = F.array(*[text.strip(F.coalesce(c, F.lit(""))) for c in columns])
    return F.filter(cleaned, lambda x: x != "") if columns else F.array().cast("array<string>")


def cluster_listing(df: DataFrame, limit: int = 20) -> DataFrame:
    """The largest clusters with their reviews as a list."""
    require_columns(df, ["cluster_id", "cluster_theme", "cluster_size", "major_issue", "top_keywords"])
    return (
        df.orderBy(F.desc("cluster_size"), "cluster_id")
        .limit(limit)
        .select(
            "cluster_id", "cluster_theme", "cluster_size", "major_issue", "top_keywords",
            review_list(df).alias("representative_reviews"),
        )
    )


def priority_listing(df: DataFrame, limit: int = 10) -> DataFrame:
    """The most urgent clusters with their reviews as a list."""
    columns = [
        "priority_rank", "cluster_id", "cluster_theme", "priority_score", "cluster_size",
        "major_issue", "top_keywords",
    ]
    require_columns(df, columns)
    return (
        df.orderBy("priority_rank")
        .limit(limit)
        .select(*columns, review_list(df).alias("representative_reviews"))
    )
