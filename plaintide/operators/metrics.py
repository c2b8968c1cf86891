"""Classifier evaluation, class weights and the error-review queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from plaintide import rules
from plaintide.functions.text import normalized_label, parse_boolean
from plaintide.operators.ids import small_rank, top_rows
from plaintide.schema import ERROR_REVIEW_COLUMNS, PREDICTION_COLUMNS, require_columns, select_existing

MACRO, WEIGHTED = "macro avg", "weighted avg"


def label_table(df: DataFrame, labels: Sequence[str], name: str) -> DataFrame:
    """All labels with their ids, as a table of the session of ``df``."""
    spark = df.sparkSession
    return spark.range(len(labels), numPartitions=1).select(
        F.get(F.array(*[F.lit(x) for x in labels]), F.col("id").cast("int")).alias(name),
        F.col("id").cast("int").alias("label_id"),
    )


def class_weights(df: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    """Balanced weights rows / (classes * rows of the class), one row per class."""
    counts = df.filter(F.col(label).isin(list(labels))).groupBy(label).agg(F.count(F.lit(1)).alias("class_count"))
    total = F.sum("class_count").over(Window.partitionBy())
    return counts.withColumn("class_weight", total / (F.lit(len(labels)) * F.col("class_count")))


def with_class_weights(df: DataFrame, label: str, labels: Sequence[str], name: str = "class_weight") -> DataFrame:
    """Rows of ``labels`` with the weight of their class; the weights, a row per class, travel to the rows."""
    weights = class_weights(df, label, labels).select(label, F.col("class_weight").alias(name))
    return df.join(F.broadcast(weights), label)


def rare_labels(df: DataFrame, label: str, fewer_than: int = 2) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") < fewer_than)


def confusion_matrix(
    df: DataFrame, labels: Sequence[str], true: str = "true_label", pred: str = "pred_label"
) -> DataFrame:
    """One row ``true_*`` per label, one column ``pred_*`` per label, zeros included."""
    counts = df.groupBy(true).agg(*[F.count_if(F.col(pred) == x).alias(f"pred_{x}") for x in labels])
    return (
        label_table(df, labels, true)
        .join(counts, true, "left")
        .na.fill(0)
        .select("label_id", F.concat(F.lit("true_"), true).alias("label"), *[f"pred_{x}" for x in labels])
    )


def _class_scores(df: DataFrame, labels: Sequence[str], true: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from one aggregation."""
    pairs = df.groupBy(true, pred).agg(F.count(F.lit(1)).alias("_n"))
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col(true).alias("label"), F.col("_n").alias("_true"), F.lit(0).cast("bigint").alias("_pred")),
                F.struct(F.col(pred).alias("label"), F.lit(0).cast("bigint").alias("_true"), F.col("_n").alias("_pred")),
            )
        ).alias("s"),
        F.when(F.col(true) == F.col(pred), F.col("_n")).otherwise(0).alias("_hit"),
    )
    # Each hit appears once on the true side and once on the predicted side.
    sums = sides.groupBy(F.col("s.label").alias("label")).agg(
        F.sum("s._true").alias("_true"),
        F.sum("s._pred").alias("_pred"),
        F.sum(F.when(F.col("s._true") > 0, F.col("_hit")).otherwise(0)).alias("_hit"),
    )
    filled = label_table(df, labels, "label").join(sums, "label", "left").na.fill(0, ["_true", "_pred", "_hit"])
    precision = F.coalesce(F.try_divide(F.col("_hit"), F.col("_pred")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("_hit"), F.col("_true")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("_hit"), F.col("_pred") + F.col("_true")), F.lit(0.0))
    return filled.select(
        "label_id",
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1_score"),
        F.col("_true").alias("support"),
        "_hit",
        "_pred",
    )


def _mean(name: str, weight: str | None):
    if weight is None:
        return F.avg(name)
    return F.coalesce(F.try_divide(F.sum(F.col(name) * F.col(weight)), F.sum(weight)), F.lit(0.0))


def classification_report(
    df: DataFrame, labels: Sequence[str], true: str = "true_label", pred: str = "pred_label"
) -> DataFrame:
    """Scores per class, then their plain and their support-weighted mean."""
    scores = _class_scores(df, labels, true, pred).drop("_hit", "_pred")
    names = ["precision", "recall", "f1_score"]
    rows = [
        scores.agg(
            F.lit(len(labels) + i).alias("label_id"),
            F.lit(label).alias("label"),
            *[_mean(n, weight).alias(n) for n in names],
            F.sum("support").alias("support"),
        )
        for i, (label, weight) in enumerate([(MACRO, None), (WEIGHTED, "support")])
    ]
    return scores.unionByName(rows[0]).unionByName(rows[1])


def classifier_metrics(
    df: DataFrame, labels: Sequence[str], true: str = "true_label", pred: str = "pred_label"
) -> DataFrame:
    """One row: accuracy, macro F1, weighted F1 and the number of rows.

    The macro mean is over the labels that occur as true or predicted label.
    """
    scores = _class_scores(df, labels, true, pred)
    occurring = (F.col("support") > 0) | (F.col("_pred") > 0)
    return scores.agg(
        F.try_divide(F.sum("_hit"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(occurring, F.col("f1_score"))).alias("macro_f1"),
        _mean("f1_score", "support").alias("weighted_f1"),
        F.sum("support").alias("rows"),
    )


def error_review_queue(predictions: DataFrame, order: str, max_rows: int = 150) -> DataFrame:
    """Wrong predictions for people to look at, the priority labels first.

    ``order`` is a unique column that settles ties.
    """
    require_columns(predictions, PREDICTION_COLUMNS)
    known = predictions.withColumns(
        {
            "true_label": normalized_label(F.col("true_label")),
            "pred_label": normalized_label(F.col("pred_label")),
            "correct": parse_boolean(F.col("correct")),
        }
    )
    rank = F.when(F.col("true_label").isin(rules.PRIORITY_TRUE_LABELS), 1).otherwise(2)
    keys = [F.asc("review_priority"), F.asc("true_label"), F.desc("confidence"), F.asc(order)]
    wrong = known.filter(~F.col("correct")).withColumn("review_priority", rank)
    worst = top_rows(wrong, max_rows, *keys, keys=["review_priority", "true_label", "confidence"], ident=order)
    queue = small_rank(worst, "review_id_for_error_analysis", *keys).withColumns(
        {
            "corrected_label": F.col("true_label"),
            "review_decision": F.lit(""),
            "review_note": F.lit(""),
        }
    )
    return select_existing(queue, ERROR_REVIEW_COLUMNS)


def error_counts(predictions: DataFrame, labels: Sequence[str] = tuple(rules.PRIORITY_TRUE_LABELS)) -> DataFrame:
    """Wrong predictions per label, zeros included."""
    wrong = predictions.filter(~parse_boolean(F.col("correct")))
    counts = wrong.groupBy(normalized_label(F.col("true_label")).alias("label")).agg(
        F.count(F.lit(1)).alias("error_count")
    )
    return label_table(predictions, labels, "label").join(counts, "label", "left").na.fill(0, ["error_count"]).drop(
        "label_id"
    )


def review_queue_summary(bootstrap: DataFrame) -> DataFrame:
    return bootstrap.groupBy("needs_review", "review_reason").agg(F.count(F.lit(1)).alias("count"))
