"""Complaint clusters: centres, distances, keywords, profiles, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from plaintide import rules
from plaintide.functions import text, vectors
from plaintide.operators.ids import most_frequent
from plaintide.operators.once import once
from plaintide.schema import REVIEW_CLUSTER_COLUMNS, require_columns, select_existing


#: Numbers in all centres together that may travel as one value (8 bytes each).
MAX_CENTER_NUMBERS = 1 << 24
SEAM_BITS = 17


def l2_normalize(df: DataFrame, vector: str, name: str | None = None) -> DataFrame:
    """Scale every vector to length 1; a zero vector stays as it is."""
    return (
        df.withColumn("_norm", vectors.l2_norm(F.col(vector)))
        .withColumn(
            name or vector,
            F.when(
                F.col("_norm") > 0,
                F.transform(vector, lambda x: x.cast("double") / F.col("_norm")),
            ).otherwise(F.col(vector).cast("array<double>")),
        )
        .drop("_norm")
    )


def cluster_centers(df: DataFrame, vector: str = "embedding", cluster: str = "cluster_id") -> DataFrame:
    """Mean vector per cluster.  Partial means are merged, so a big cluster is no hot key."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.groupBy(cluster).agg(vector_to_array(mean).alias("center"))


def with_distance(
    df: DataFrame,
    centers: DataFrame,
    vector: str = "embedding",
    cluster: str = "cluster_id",
    name: str = "distance_to_cluster_center",
) -> DataFrame:
    """Euclidean distance of every row to the centre of its own cluster.

    The measured size of the centres decides between a broadcast and a shuffle join,
    which AQE splits at a skewed cluster.
    """
    return (
        df.join(centers.select(cluster, F.col("center").alias("_center")), cluster)
        .withColumn(name, vectors.euclidean(F.col(vector), F.col("_center")))
        .drop("_center")
    )


def nearest_center(
    df: DataFrame, centers: DataFrame, vector: str = "embedding", cluster: str = "cluster_id",
    name: str = "distance_to_cluster_center",
) -> DataFrame:
    """Assign every row to the nearest centre; the lower id wins a tie.

    All centres are needed for every row, as in any k-means step: they travel as one
    value of k * dimensions numbers, taken from a scalar subquery.  More than
    ``MAX_CENTER_NUMBERS`` are an error here; ``plans.assignment`` takes any number.
    """
    table = centers.select(F.col(cluster).alias("id"), "center")
    numbers = table.agg(F.sum(F.size("center")).alias("n")).scalar()
    fits = table.filter(F.when(numbers > MAX_CENTER_NUMBERS, F.raise_error(F.lit("too many centres for one value"))).isNull())
    everything = fits.agg(F.sort_array(F.collect_list(F.struct("id", "center"))).alias("c")).scalar()
    distances = F.transform(
        F.col("_centers"),
        lambda c: F.struct(vectors.euclidean(F.col(vector), c["center"]).alias("distance"), c["id"].alias("id")),
    )
    return (
        df.withColumn("_centers", everything)
        .withColumn("_best", F.array_min(distances))
        .withColumn(cluster, F.col("_best.id"))
        .withColumn(name, F.col("_best.distance"))
        .drop("_centers", "_best")
    )


def silhouette(df: DataFrame, vector: str = "embedding", cluster: str = "cluster_id") -> float | None:
    """Mean cosine silhouette over all rows, none for a single cluster.

    Spark's evaluator works on sums per cluster, never on pairs of rows.
    """
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(cluster).cast("int").alias("prediction"))
    if rows.select("prediction").distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(distanceMeasure="cosine").evaluate(rows)


def _seams(words: DataFrame, cluster: str, order: str) -> DataFrame:
    """Last word of a review and first word of the next one in its cluster.

    Neighbours are found inside buckets of 2**17 consecutive ids and then between
    the ends of the buckets, so that no cluster is handled as one group.
    """
    ends = words.filter(F.size("_words") > 0).select(
        cluster,
        order,
        F.shiftright(F.col(order).cast("bigint"), SEAM_BITS).alias("_bucket"),
        F.get("_words", F.lit(0)).alias("_first"),
        F.element_at("_words", -1).alias("_last"),
    )
    inside = Window.partitionBy(cluster, "_bucket").orderBy(order)
    between = Window.partitionBy(cluster).orderBy("_bucket")
    buckets = ends.groupBy(cluster, "_bucket").agg(
        F.min_by("_first", order).alias("_first"), F.max_by("_last", order).alias("_last")
    )
    parts = [
        part.withColumn("_next", F.lead("_first").over(window)).select(cluster, "_last", "_next")
        for part, window in [(ends, inside), (buckets, between)]
    ]
    seams = parts[0].unionByName(parts[1]).filter(F.col("_next").isNotNull())
    return seams.select(cluster, F.concat("_last", F.lit(" "), "_next").alias("term"))


def cluster_words(
    df: DataFrame, text_col: str = "review_text", cluster: str = "cluster_id",
    stop_words: Sequence[str] = tuple(rules.ENGLISH_STOP_WORDS), order: str = "review_id",
) -> DataFrame:
    """(cluster, order, ``_words``): the words of each review without stop words."""
    words = text.without_stop_words(text.tokens(F.col(text_col)), stop_words)
    return once(df.select(cluster, order, text_col), {"_words": words}).drop(text_col)


def term_occurrences(words: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """A row per word and per pair of neighbouring words of a review.

    Pairs are put together behind the generator: a lambda over the array would be interpreted.
    """
    placed = words.select(cluster, "_words", F.posexplode("_words").alias("_at", "_word"))
    pair = F.concat("_word", F.lit(" "), F.get("_words", F.col("_at") + 1))
    return placed.select(cluster, F.explode(F.array("_word", pair)).alias("term")).filter(F.col("term").isNotNull())


def seams(words: DataFrame, cluster: str = "cluster_id", order: str = "review_id") -> DataFrame:
    """A row per pair made of the last word of a review and the first word of the next one in the cluster."""
    return _seams(words, cluster, order)


def count_terms(occurrences: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return occurrences.groupBy(cluster, "term").agg(F.count(F.lit(1)).alias("tf"))


def cluster_term_counts(
    df: DataFrame,
    text_col: str = "review_text",
    cluster: str = "cluster_id",
    stop_words: Sequence[str] = tuple(rules.ENGLISH_STOP_WORDS),
    across_reviews: bool = True,
    order: str = "review_id",
) -> DataFrame:
    """Occurrences of every word and word pair per cluster.

    The text of a cluster is never brought together: words are counted where they
    are read and the counts are merged.  ``across_reviews`` adds the pair made of the
    last word of a review and the first word of the next one in the cluster.
    """
    words = cluster_words(df, text_col, cluster, stop_words, order)
    both = term_occurrences(words, cluster)
    return count_terms(both.unionByName(_seams(words, cluster, order)) if across_reviews else both, cluster)


def cluster_keyword_scores(
    df: DataFrame,
    text_col: str = "review_text",
    cluster: str = "cluster_id",
    n: int = 8,
    stop_words: Sequence[str] = tuple(rules.ENGLISH_STOP_WORDS),
    domain_words: Sequence[str] = tuple(rules.DOMAIN_STOP_WORDS),
    min_df: int = 2,
    max_features: int | None = 8000,
    across_reviews: bool = True,
    order: str = "review_id",
) -> DataFrame:
    """The ``n`` best terms per cluster by tf * (ln((1 + clusters) / (1 + df)) + 1).

    The vocabulary is the ``max_features`` most frequent terms found in ``min_df``
    clusters, or all of these with ``None``.  It is a cut: a cluster whose words are rare
    overall gets fewer keywords.  As one lazy plan this counts all terms anew for each of its
    readers; ``plans.keywords`` has the job that reads the texts once.
    """
    counts = cluster_term_counts(df, text_col, cluster, stop_words, across_reviews, order)
    vocabulary = most_frequent(term_totals(counts, min_df), max_features, "total", "term")
    return score_terms(counts, vocabulary, df.agg(F.count_distinct(cluster)).scalar(), cluster, n, domain_words)


def term_totals(counts: DataFrame, min_df: int = 2) -> DataFrame:
    """(term, df, total) of the terms found in ``min_df`` clusters: clusters and occurrences."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)


def score_terms(
    counts: DataFrame, vocabulary: DataFrame, clusters: Column, cluster: str = "cluster_id", n: int = 8,
    domain_words: Sequence[str] = tuple(rules.DOMAIN_STOP_WORDS),
) -> DataFrame:
    """The ``n`` best terms of the vocabulary per cluster, without short terms and those with a domain word."""
    wanted = vocabulary.select("term", "df").filter(
        (F.length("term") > 2)
        & ~F.arrays_overlap(F.split("term", " "), F.array(*[F.lit(w) for w in domain_words]))
    )
    score = F.col("tf") * (F.log((1 + F.col("_clusters")) / (1 + F.col("df"))) + 1)
    best = Window.partitionBy(cluster).orderBy(F.desc("score"), "term")
    return (
        counts.join(wanted, "term")
        .withColumn("_clusters", clusters)
        .withColumn("score", score)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= n)
        .select(cluster, "rank", "term", "tf", "df", "score")
    )


def cluster_keywords(df: DataFrame, cluster: str = "cluster_id", **options) -> DataFrame:
    """One row per cluster with its keywords, best first, joined with ', '."""
    return joined_keywords(cluster_keyword_scores(df, cluster=cluster, **options), cluster)


def joined_keywords(scores: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return (
        scores.groupBy(cluster)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_terms"))
        .select(cluster, F.array_join(F.col("_terms.term"), ", ").alias("top_keywords"))
    )


def cluster_profile(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Size, modal sentiment and issue, mean confidence and share of negatives.

    Rows are first merged to one row per (cluster, sentiment, issue).
    """
    cells = df.groupBy(cluster, "sentiment_label", "predicted_issue_label").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("predicted_issue_confidence").alias("_sum"),
        F.count("predicted_issue_confidence").alias("_known"),
    )
    key = Window.partitionBy(cluster, "sentiment_label")
    issue = Window.partitionBy(cluster, "predicted_issue_label")
    cells = cells.withColumn("_by_sentiment", F.sum("_n").over(key)).withColumn("_by_issue", F.sum("_n").over(issue))

    def mode(count: str, label: str) -> Column:
        # Largest count, then the first label; rows without a label do not vote.
        return F.min(F.when(F.col(label).isNotNull(), F.struct((-F.col(count)).alias("n"), F.col(label).alias("label"))))

    return (
        cells.groupBy(cluster)
        .agg(
            F.sum("_n").alias("cluster_size"),
            mode("_by_sentiment", "sentiment_label").alias("_s"),
            mode("_by_issue", "predicted_issue_label").alias("_i"),
            F.try_divide(F.sum("_sum"), F.sum("_known")).alias("avg_issue_confidence"),
            (F.sum(F.when(F.col("sentiment_label") == "negative", F.col("_n")).otherwise(0)) / F.sum("_n")).alias(
                "negative_ratio"
            ),
        )
        .select(
            cluster,
            "cluster_size",
            F.col("_s.label").alias("major_sentiment"),
            (-F.col("_s.n")).alias("major_sentiment_count"),
            F.col("_i.label").alias("major_issue"),
            (-F.col("_i.n")).alias("major_issue_count"),
            "avg_issue_confidence",
            "negative_ratio",
        )
    )


def representative_reviews(
    df: DataFrame, n: int = 3, cluster: str = "cluster_id", distance: str = "distance_to_cluster_center",
    ident: str = "review_id", text_col: str = "review_text",
) -> DataFrame:
    """The ``n`` reviews nearest to the centre, as columns ``representative_review_1..n``.

    Numbers are ranked first; only the few winners fetch their text.
    """
    nearest = Window.partitionBy(cluster).orderBy(distance, ident)
    winners = (
        df.select(cluster, distance, ident)
        .withColumn("_rank", F.row_number().over(nearest))
        .filter(F.col("_rank") <= n)
        .select(F.col(cluster), ident, "_rank")
    )
    texts = winners.join(df.select(ident, text_col), ident)
    return texts.groupBy(cluster).agg(
        *[
            F.coalesce(F.max(F.when(F.col("_rank") == i, F.col(text_col))), F.lit("")).alias(f"representative_review_{i}")
            for i in range(1, n + 1)
        ]
    )


def cluster_summary(
    df: DataFrame, silhouette_score: float | None = None, n_keywords: int = 8, n_reviews: int = 3,
    keywords: DataFrame | None = None, **keyword_options,
) -> DataFrame:
    """One row per cluster: profile, keywords (counted here unless given), representative reviews."""
    require_columns(df, ["review_id", "review_text", "cluster_id", "distance_to_cluster_center"])
    profile = cluster_profile(df)
    if keywords is None:
        keywords = cluster_keywords(df, n=n_keywords, **keyword_options)
    reviews = representative_reviews(df, n_reviews)
    score = F.lit(silhouette_score).cast("double")
    return (
        profile.join(keywords, "cluster_id", "left")
        .join(reviews, "cluster_id", "left")
        .select(
            "cluster_id",
            "cluster_size",
            F.coalesce("top_keywords", F.lit("")).alias("top_keywords"),
            "major_sentiment",
            "major_sentiment_count",
            "major_issue",
            "major_issue_count",
            "avg_issue_confidence",
            "negative_ratio",
            score.alias("silhouette_score_global"),
            *[f"representative_review_{i}" for i in range(1, n_reviews + 1)],
        )
    )


def review_clusters(df: DataFrame) -> DataFrame:
    """The per-review output columns of the clustering job."""
    return select_existing(df, REVIEW_CLUSTER_COLUMNS)
