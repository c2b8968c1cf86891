"""The review tables, derived by Spark from the driver tables.

The texts of ``documents`` are invented words, so a phrase chosen by ``n_chars`` is
appended: copies of a text stay copies and every issue label occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plaintide import rules
from plaintide.functions import labels, text
from plaintide.operators import clusters, scoring
from plaintide.operators.annotate import with_first_match, with_keyword_label
from plaintide.operators.cleaning import clean_reviews as clean_job, cleaned
from plaintide.sources.readers import read_table

PHRASES = [
    "battery dies, charger dead", "screen cracked, touch display", "slow, laggy, it freezes",
    "no wifi signal, sim network", "blurry camera photos, video focus", "late delivery, package missing",
    "seller refused refund, warranty support", "price not worth the money", "refurbished, scratches, dented",
    "android update bug, system apps", "<b>see</b> http://x.example/a?b=1 www.x.example", "",
]
KEYS = {"documents": "doc_id", "embeddings": "vec_id", "pages": "page_id"}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The fixtures are single files: deal their rows to the cores, of large ones in more parts than there are cores."""
    return df.repartition(*keys) if keys else df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = read_table(spark, f"{sf_dir}/{name}.parquet")
    return spread(rows, KEYS[name]) if name in KEYS else rows


def counted(spark: SparkSession, sf_dir: str, name: str):
    """The number of rows of a table, as a scalar subquery."""
    return read_table(spark, f"{sf_dir}/{name}.parquet").agg(F.count(F.lit(1))).scalar()


def text_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of all texts of ``documents``, to choose a number of files."""
    return read_table(spark, f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0] or 0


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per document, of the products in turn."""
    documents = table(spark, sf_dir, "documents").withColumn("_part", F.col("doc_id") % counted(spark, sf_dir, "part"))
    part = table(spark, sf_dir, "part")
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("n_chars") % len(PHRASES)).cast("int"))
    return documents.join(part, part.p_partkey == documents["_part"], "left").select(
        F.col("doc_id").alias("ordinal"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        F.when(F.col("doc_id") % 37 != 0, (1 + (F.col("doc_id") * 7 + F.col("n_chars")) % 5).cast("double")).alias("rating"),
        F.concat("text", F.lit(" "), phrase).alias("review_text"),
        (F.col("doc_id") % 11).cast("double").alias("review_votes"),
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under the raw column names."""
    return reviews(spark, sf_dir).withColumnsRenamed({v: k for k, v in rules.RAW_COLUMNS.items()})


def clean_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_job(raw_reviews(spark, sf_dir))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean texts of all reviews, copies included, with the sentiment of the rating."""
    return (
        cleaned(reviews(spark, sf_dir))
        .withColumnRenamed("ordinal", "review_id")
        .withColumn("sentiment_label", labels.rating_sentiment(F.col("rating")))
    )


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sentences`` with the first-match issue."""
    return with_first_match(sentences(spark, sf_dir))


def probable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labeled`` with class probabilities of the two weak scorers."""
    return scoring.rating_sentiment_probabilities(
        scoring.keyword_issue_probabilities(labeled(spark, sf_dir))
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first-match issue as truth, the keyword scorer as the model under test."""
    return scoring.prediction_table(probable(spark, sf_dir), "issue_label", "issue_probs", keep=["review_id"])


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews with the rule label, as annotators would get them."""
    return (
        with_keyword_label(sentences(spark, sf_dir), "rule_issue_label", "_score")
        .drop("_score")
        .withColumns({"annotation_id": F.col("review_id"), "manual_issue_label": F.lit(""), "annotation_note": F.lit("")})
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster_id")


def pointed(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Clean texts of all reviews, each with one of the vectors in turn and its cluster."""
    vectors = embeddings(spark, sf_dir).select("vec_id", "cluster_id", *extra)
    numbered = reviews(spark, sf_dir).withColumn("vec_id", F.col("ordinal") % counted(spark, sf_dir, "embeddings"))
    rows = cleaned(numbered.join(vectors, "vec_id"), extra=["cluster_id", *extra])
    return rows.withColumnRenamed("ordinal", "review_id").withColumn(
        "sentiment_label", labels.rating_sentiment(F.col("rating"))
    )


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews with cluster, predicted issue and distance."""
    rows = pointed(spark, sf_dir, "embedding")
    scored = scoring.with_best_label(
        scoring.keyword_issue_probabilities(rows, "_probs"),
        "_probs", rules.ISSUES, "predicted_issue_label", "predicted_issue_confidence",
    ).drop("_probs")
    centers = clusters.cluster_centers(embeddings(spark, sf_dir))
    return clusters.with_distance(scored, centers).drop("embedding")
