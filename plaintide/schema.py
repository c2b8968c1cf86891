"""Table schemas and column shaping shared by all operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Names, order and types of the columns of all tables.
RAW_REVIEWS = (
    "`Product Name` STRING, `Brand Name` STRING, Price DOUBLE, Rating DOUBLE, "
    "Reviews STRING, `Review Votes` DOUBLE"
)
CLEAN_REVIEWS = (
    "review_id BIGINT, product_name STRING, brand STRING, price DOUBLE, "
    "rating DOUBLE, review_text STRING, review_votes DOUBLE, "
    "sentiment_label STRING, date DATE, issue_label STRING"
)

ANNOTATION_COLUMNS = [
    "annotation_id", "review_id", "review_text", "rating", "sentiment_label",
    "rule_issue_label", "manual_issue_label", "annotation_note",
]
BOOTSTRAP_COLUMNS = [
    "annotation_id", "review_id", "review_text", "rating", "sentiment_label",
    "rule_issue_label", "keyword_guess_label", "keyword_guess_score",
    "manual_issue_label", "needs_review", "review_reason", "annotation_note",
]
PREDICTION_COLUMNS = [
    "review_text", "true_label", "pred_label", "correct", "confidence",
    "top_1_label", "top_1_prob", "top_2_label", "top_2_prob", "top_3_label",
    "top_3_prob",
]
ERROR_REVIEW_COLUMNS = [
    "review_id_for_error_analysis", "review_text", "true_label", "pred_label",
    "confidence", "top_1_label", "top_1_prob", "top_2_label", "top_2_prob",
    "top_3_label", "top_3_prob", "corrected_label", "review_decision",
    "review_note",
]
REVIEW_CLUSTER_COLUMNS = [
    "review_id", "review_text", "rating", "sentiment_label", "product_name",
    "brand", "predicted_issue_label", "predicted_issue_confidence",
    "cluster_id", "distance_to_cluster_center",
]
LABELED_FIRST_COLUMNS = [
    "cluster_id", "cluster_theme", "theme_confidence_score", "cluster_size",
    "top_keywords", "major_issue", "major_issue_count",
    "avg_issue_confidence", "negative_ratio",
]
PRIORITY_COLUMNS = [
    "priority_rank", "cluster_id", "cluster_theme", "priority_score",
    "cluster_size", "major_issue", "major_issue_count", "issue_concentration",
    "avg_issue_confidence", "negative_ratio", "top_keywords",
    "representative_review_1", "representative_review_2",
    "representative_review_3", "cluster_size_score",
    "issue_concentration_score", "confidence_score", "negative_ratio_score",
    "growth_proxy_score",
]


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise ``ValueError`` for the first missing column; no job is started."""
    for name in columns:
        if name not in df.columns:
            raise ValueError(f"missing required column: {name}; found {df.columns}")
    return df


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[name for name in columns if name in df.columns])


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Put the listed columns that exist first and keep the others behind."""
    head = [name for name in first if name in df.columns]
    return df.select(*head, *[name for name in df.columns if name not in head])


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add each column that is missing, with its default."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def label_id(label: Column, labels: Sequence[str]) -> Column:
    """Position of ``label`` in ``labels``; null when it is not listed."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), label)
    return F.when(position > 0, (position - 1).cast("int"))


def id_label(ident: Column, labels: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), ident.cast("int"))
