"""From clean reviews to ranked complaint clusters and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from plaintide import rules
from plaintide.functions import text
from plaintide.operators import clusters, priority, sampling, scoring, themes
from plaintide.operators.cleaning import by_sentiment, usable_reviews
from plaintide.plans import keywords, reports
from plaintide.schema import require_columns
from plaintide.session import written
from plaintide.sources.writers import write_lines, write_table

CLUSTER_INPUT = ["review_id", "review_text", "sentiment_label", "rating", "product_name", "brand"]


def reviews_to_cluster(
    clean: DataFrame, sentiment: str = "negative", max_samples: int | None = None, seed: int = 42
) -> DataFrame:
    """Usable reviews of one sentiment, all of them unless a sample is asked for; an error when there are none."""
    require_columns(clean, CLUSTER_INPUT)
    rows = by_sentiment(usable_reviews(clean.select(*CLUSTER_INPUT)), sentiment)
    if rows.isEmpty():
        raise ValueError(f"no usable reviews of sentiment {sentiment!r}")
    return rows if max_samples is None else sampling.sample_n(rows, max_samples, "review_id", seed)


def embed_reviews(
    df: DataFrame, dims: int = 512, name: str = "embedding", text_col: str = "review_text"
) -> DataFrame:
    """Hashed word and word-pair counts scaled to length 1; needs no fitting."""
    words = df.withColumn("_words", text.without_stop_words(text.tokens(F.col(text_col)), rules.ENGLISH_STOP_WORDS))
    both = words.withColumn("_terms", F.concat("_words", text.bigrams(F.col("_words")))).drop("_words")
    hashed = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=dims).transform(both)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(hashed)
    return unit.withColumn(name, vector_to_array("_unit", "float32")).drop("_terms", "_tf", "_unit")


def embed_with_plugin(
    df: DataFrame, make_predict: Callable, name: str = "embedding", batch: int = 64, text_col: str = "review_text"
) -> DataFrame:
    """Vectors of a user's own encoder, in Arrow batches, scaled to length 1 in the JVM."""
    encode = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return clusters.l2_normalize(df.withColumn(name, encode(F.col(text_col))), name)


def kmeans_clusters(
    df: DataFrame, k: int = 20, seed: int = 42, vector: str = "embedding", max_iter: int = 300
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``cluster_id``, table of centres); the centres' movement ends the fit well before ``max_iter``."""
    featured = df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(
        k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="cluster_id"
    ).fit(featured.select("_features"))
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    table = df.sparkSession.createDataFrame(centers, "cluster_id INT, center ARRAY<DOUBLE>")
    return model.transform(featured).drop("_features"), table


@dataclass
class Clustering:
    reviews: DataFrame
    silhouette: float | None
    summary: DataFrame


def cluster_reviews(
    clean: DataFrame,
    score: Callable[[DataFrame], DataFrame] | None = None,
    embed: Callable[[DataFrame], DataFrame] = embed_reviews,
    k: int = 20,
    sentiment: str = "negative",
    max_samples: int | None = None,
    seed: int = 42,
) -> Clustering:
    """Filter, score, embed, cluster, summarise.

    ``score`` adds ``predicted_issue_label`` and ``predicted_issue_confidence``; the
    keyword scorer is the default.  Features are written once, as k-means reads them many
    times; cluster and distance follow from the centres in one more scan.
    """
    rows = reviews_to_cluster(clean, sentiment, max_samples, seed)
    featured = written(embed((score or keyword_issues)(rows)))
    assigned, centers = kmeans_clusters(featured, k, seed)
    measured = clusters.with_distance(assigned, centers)
    value = clusters.silhouette(measured)
    reviews = clusters.review_clusters(measured)
    return Clustering(reviews, value, keywords.cluster_summary(reviews, value))


def keyword_issues(df: DataFrame) -> DataFrame:
    """Predicted issue and confidence from the keyword scorer."""
    scored = scoring.keyword_issue_probabilities(df, "_probs")
    return scoring.with_best_label(
        scored, "_probs", rules.ISSUES, "predicted_issue_label", "predicted_issue_confidence"
    ).drop("_probs")


def insight_job(clean: DataFrame, out: str, top_n: int = 10, **options) -> DataFrame:
    """The whole job: clusters, themes, priorities and both reports under ``out``."""
    found = cluster_reviews(clean, **options)
    spark = clean.sparkSession
    write_table(found.reviews, f"{out}/review_clusters")
    reviews = spark.read.parquet(f"{out}/review_clusters")
    write_table(keywords.cluster_summary(reviews, found.silhouette), f"{out}/cluster_summary")
    labeled = themes.label_themes(spark.read.parquet(f"{out}/cluster_summary"))
    write_table(labeled, f"{out}/cluster_summary_labeled")
    labeled = spark.read.parquet(f"{out}/cluster_summary_labeled")
    write_table(priority.priority_scores(labeled), f"{out}/priority_scores")
    ranked = spark.read.parquet(f"{out}/priority_scores")
    sentiment = options.get("sentiment", "negative")
    write_lines(reports.clustering_report(labeled, sentiment=sentiment), f"{out}/clustering_report")
    write_lines(reports.insight_report(ranked, top_n, sentiment=sentiment), f"{out}/insight_report")
    return ranked
