"""Class probabilities, triage and prediction tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from plaintide import rules
from plaintide.functions import text, vectors
from plaintide.operators.annotate import with_keyword_hits
from plaintide.operators.once import once
from plaintide.schema import PREDICTION_COLUMNS


def with_softmax(df: DataFrame, scores: Sequence[Column], name: str) -> DataFrame:
    """Add the softmax of the score columns as ``ARRAY<DOUBLE>``.

    The exponentials are summed in sorted order: rows whose scores are permutations
    of each other get the same probabilities to the last bit, so ties stay ties.
    """
    n = len(scores)
    probability = [F.get("_exps", F.lit(i)) / F.col("_sum") for i in range(n)]
    staged = (
        df.withColumns({f"_s{i}": s.cast("double") for i, s in enumerate(scores)})
        .withColumn("_max", F.greatest(*[F.col(f"_s{i}") for i in range(n)]))
        .withColumn("_exps", F.array(*[F.exp(F.col(f"_s{i}") - F.col("_max")) for i in range(n)]))
        .withColumn("_sum", vectors.total(F.sort_array("_exps")))
    )
    return once(staged, {name: F.array(*probability)}).drop("_max", "_exps", "_sum", *[f"_s{i}" for i in range(n)])


def keyword_issue_probabilities(
    df: DataFrame, name: str = "issue_probs", text_col: str = "review_text"
) -> DataFrame:
    """Weak scorer: softmax over the keyword counts, 'other' counting as half a hit."""
    hits = {label: f"_hits_{label}" for label in rules.ISSUE_KEYWORDS}
    scored = with_keyword_hits(df, rules.ISSUE_KEYWORDS, hits, text_col)
    scores = [F.col(hits[x]) if x in hits else F.lit(0.5) for x in rules.ISSUES]
    return with_softmax(scored, scores, name).drop(*hits.values())


def rating_sentiment_probabilities(
    df: DataFrame, name: str = "sentiment_probs", rating: str = "rating"
) -> DataFrame:
    """Weak scorer: softmax over the distance of the rating from the middle."""
    value = F.coalesce(F.nanvl(F.col(rating), F.lit(None).cast("double")), F.lit(5.0))
    return with_softmax(df, [3 - value, 1 - F.abs(value - 3), value - 3], name)


def with_best_label(
    df: DataFrame, probabilities: str, labels: Sequence[str], label_col: str, confidence_col: str
) -> DataFrame:
    """Most probable label (first id on a tie) and its probability."""
    top = F.array_max(probabilities)
    names = F.array(*[F.lit(x) for x in labels])
    return df.withColumn(confidence_col, top).withColumn(
        label_col, F.get(names, (F.array_position(F.col(probabilities), F.col(confidence_col)) - 1).cast("int"))
    )


def probability_map(probabilities: Column, labels: Sequence[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), probabilities)


def sentiment_scores(df: DataFrame, probabilities: str, labels: Sequence[str] = tuple(rules.SENTIMENTS)) -> DataFrame:
    """Label, confidence, probability map and all classes from most to least likely."""
    scored = with_best_label(df, probabilities, labels, "sentiment_label", "sentiment_confidence")
    return scored.withColumn(
        "sentiment_probabilities", probability_map(F.col(probabilities), labels)
    ).withColumn("ranked_sentiments", vectors.ranked(F.col(probabilities), labels, len(labels)))


def check_triage_arguments(top_k: int, min_candidate: float, dominant: float) -> None:
    if not 1 <= top_k <= 10:
        raise ValueError(f"top_k must lie in 1..10, not {top_k}")
    for value in (min_candidate, dominant):
        if not 0.0 <= value <= 1.0:
            raise ValueError(f"thresholds must lie in 0..1, not {value}")


def triage(
    df: DataFrame,
    probabilities: str,
    labels: Sequence[str] = tuple(rules.ISSUES),
    top_k: int = 3,
    min_candidate: float = 0.10,
    dominant: float = 0.80,
) -> DataFrame:
    """Rank the issues of each row, keep the credible ones, name the mode.

    Candidates are the first rank and every other rank of at least
    ``min_candidate``.  One candidate is ``single``, or ``single-dominant`` from
    ``dominant`` on; more are ``multi-candidate``.
    """
    check_triage_arguments(top_k, min_candidate, dominant)
    first = F.get("ranked_issue_predictions", F.lit(0))
    alone = F.size("candidate_issues") == 1
    return (
        once(df, {"ranked_issue_predictions": vectors.ranked(F.col(probabilities), labels, top_k)})
        .withColumns(
            {
                "primary_issue_label": first["label"],
                "primary_issue_confidence": first["confidence"],
                "candidate_issues": F.filter(
                    "ranked_issue_predictions",
                    lambda x: (x["rank"] == 1) | (x["confidence"] >= min_candidate),
                ),
                "issue_probabilities": probability_map(F.col(probabilities), labels),
            }
        )
        .withColumn(
            "issue_mode",
            F.when(alone & (F.col("primary_issue_confidence") >= dominant), "single-dominant")
            .when(alone, "single")
            .otherwise("multi-candidate"),
        )
    )


def not_blank(df: DataFrame, text_col: str = "review_text") -> DataFrame:
    """Rows fit for scoring, with the text stripped."""
    return once(df, {text_col: text.strip(F.coalesce(text_col, F.lit("")))}).filter(F.col(text_col) != "")


def rejects(df: DataFrame, ident: str = "review_id", text_col: str = "review_text") -> DataFrame:
    """(id, reason) of the rows that :func:`not_blank` drops."""
    empty = text.strip(F.coalesce(text_col, F.lit(""))) == ""
    return df.filter(empty).select(ident, F.lit("blank review text").alias("reason"))


def score_feedback(
    df: DataFrame,
    sentiment_probs: str = "sentiment_probs",
    issue_probs: str = "issue_probs",
    top_k: int = 3,
    min_candidate: float = 0.10,
    dominant: float = 0.80,
) -> DataFrame:
    """Sentiment and issue triage of every row, from two probability columns."""
    scored = sentiment_scores(not_blank(df), sentiment_probs)
    return triage(scored, issue_probs, rules.ISSUES, top_k, min_candidate, dominant)


def prediction_table(
    df: DataFrame, true: str, probabilities: str, labels: Sequence[str] = tuple(rules.ISSUES), keep: Sequence[str] = ()
) -> DataFrame:
    """True and predicted label, confidence and the three best classes, one row per row."""
    ranked = once(df, {"_ranked": vectors.ranked(F.col(probabilities), labels, min(3, len(labels)))})
    best = [F.get("_ranked", F.lit(i)) for i in range(3)]
    wide = ranked.withColumns(
        {
            "true_label": F.col(true),
            "pred_label": best[0]["label"],
            "confidence": best[0]["confidence"],
            **{f"top_{i + 1}_label": best[i]["label"] for i in range(3)},
            **{f"top_{i + 1}_prob": best[i]["confidence"] for i in range(3)},
        }
    ).withColumn("correct", F.col("true_label") == F.col("pred_label"))
    return wide.select(*keep, *PREDICTION_COLUMNS)


def score_with_plugin(
    df: DataFrame, make_predict: Callable, n_classes: int, name: str, batch: int = 32, text_col: str = "review_text"
) -> DataFrame:
    """Logits of a user's own model, in Arrow batches, then softmax in the JVM.

    ``make_predict`` loads the model once per Python worker and returns a function
    from a numpy array of texts to an array (rows, n_classes).
    """
    logits = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch)
    scored = df.withColumn("_logits", logits(F.col(text_col)))
    return with_softmax(scored, [F.get("_logits", F.lit(i)) for i in range(n_classes)], name).drop("_logits")
