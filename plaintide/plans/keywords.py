"""Keywords of clusters as a job: texts are split into words once, counts are written once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plaintide import rules
from plaintide.operators import clusters
from plaintide.operators.frequent import BUCKET_BITS, frequent_terms
from plaintide.session import written


def keyword_scores(
    df: DataFrame, text_col: str = "review_text", cluster: str = "cluster_id", n: int = 8,
    stop_words: Sequence[str] = tuple(rules.ENGLISH_STOP_WORDS), domain_words: Sequence[str] = tuple(rules.DOMAIN_STOP_WORDS),
    min_df: int = 2, max_features: int | None = 8000, across_reviews: bool = True, order: str = "review_id", bits: int = BUCKET_BITS,
) -> DataFrame:
    """The rows of ``clusters.cluster_keyword_scores``, from one pass over the texts.

    The words are written, and of their counts only those of terms that can get into
    the vocabulary are shuffled.
    """
    words = written(clusters.cluster_words(df, text_col, cluster, stop_words, order))
    occurrences = clusters.term_occurrences(words, cluster)
    if across_reviews:
        occurrences = occurrences.unionByName(written(clusters.seams(words, cluster, order)))
    counts, vocabulary = frequent_terms(
        occurrences, lambda rows: clusters.count_terms(rows, cluster), lambda c: clusters.term_totals(c, min_df), max_features, bits=bits
    )
    return clusters.score_terms(counts, vocabulary, words.agg(F.count_distinct(cluster)).scalar(), cluster, n, domain_words)


def keywords(df: DataFrame, cluster: str = "cluster_id", **options) -> DataFrame:
    """One row per cluster with its keywords, best first, joined with ', '."""
    return clusters.joined_keywords(keyword_scores(df, cluster=cluster, **options), cluster)


def cluster_summary(df: DataFrame, silhouette_score: float | None = None, n_keywords: int = 8, n_reviews: int = 3, **options) -> DataFrame:
    """``clusters.cluster_summary`` with the keywords of this job."""
    return clusters.cluster_summary(df, silhouette_score, n_reviews=n_reviews, keywords=keywords(df, n=n_keywords, **options))
