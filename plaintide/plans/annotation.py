"""Files of the labelling loop: distributions, samples, review queues."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plaintide import rules
from plaintide.operators import annotate, distributions as dist, metrics, sampling
from plaintide.session import written
from plaintide.sources.writers import write_table


def distribution_job(clean: DataFrame, out: str) -> DataFrame:
    """Label the issues of clean reviews and write the summaries analysts start from."""
    write_table(annotate.with_first_match(clean), f"{out}/clean_reviews_with_issues")
    labeled = clean.sparkSession.read.parquet(f"{out}/clean_reviews_with_issues")
    summaries = {
        "missing_values": dist.missing_values(labeled),
        "rating_distribution": dist.rating_distribution(labeled),
        "sentiment_distribution": dist.distribution(labeled, "sentiment_label"),
        "avg_rating_by_sentiment": dist.mean_by(labeled, "sentiment_label", "rating", "avg_rating"),
        "issue_distribution": dist.distribution(labeled, "issue_label"),
        "issue_sentiment_counts": dist.crosstab(labeled, "issue_label", "sentiment_label", rules.SENTIMENTS),
        "issue_sentiment_crosstab": dist.crosstab_shares(labeled, "issue_label", "sentiment_label", rules.SENTIMENTS),
        "negative_issue_distribution": dist.negative_distribution(labeled),
        "sentiment_samples": dist.label_samples(labeled, "sentiment_label", "review_id"),
        "issue_samples": dist.label_samples(labeled, "issue_label", "review_id"),
    }
    for name, summary in summaries.items():
        write_table(summary, f"{out}/{name}", "csv")
    return labeled


def annotation_sample(clean: DataFrame, total: int = 2000, seed: int = 42) -> DataFrame:
    """The sample of ``sampling.annotation_sample``, with the labels of all rows written once."""
    return sampling.annotation_sample(clean, total, seed, candidates=written(sampling.annotation_candidates(clean)))


def annotation_job(clean: DataFrame, out: str, total: int = 2000, seed: int = 42) -> DataFrame:
    """Draw the annotation sample, give it starting labels and flag what to look at."""
    spark = clean.sparkSession
    write_table(annotation_sample(clean, total, seed), f"{out}/annotation_sample")
    sample = spark.read.parquet(f"{out}/annotation_sample")
    write_table(annotate.flag_for_review(sample), f"{out}/annotation_bootstrap")
    flagged = spark.read.parquet(f"{out}/annotation_bootstrap")
    write_table(metrics.review_queue_summary(flagged), f"{out}/review_queue_summary", "csv")
    return flagged


def error_review_job(predictions: DataFrame, order: str, out: str, max_rows: int = 150) -> DataFrame:
    """Write the wrong predictions people should correct, and how many there are."""
    write_table(metrics.error_review_queue(predictions, order, max_rows), f"{out}/error_review_candidates", "csv")
    write_table(metrics.error_counts(predictions), f"{out}/error_counts", "csv")
    return predictions.sparkSession.read.option("header", True).csv(f"{out}/error_counts")
