"""One query per operator; each takes (spark, sf_dir) and returns a DataFrame.

Floating results are rounded here, and arrays flattened, only so that two engines
can be compared; the operators themselves do neither.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plaintide import rules, streaming
from plaintide.functions import labels, text
from plaintide.operators import (
    annotate, cleaning, clusters, distributions as dist, metrics, priority, sampling, scoring, themes,
)
from plaintide.operators.ids import dense_id
from plaintide.plans import annotation, assignment, embedding, insight, keywords, reports, training
from plaintide.schema import id_label, label_id
from plaintide.session import shared_folder, written
from plaintide.sources.readers import read_reviews
from verification import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SAMPLE = 400
STRATIFIED = 200
CAP = 150
DRAWN = 250
SMOOTHING = [0.01, 0.1, 1.0, 10.0]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# -- scans, shaping, filters -------------------------------------------------


@query
def standardize_columns(spark, sf):
    return cleaning.standardize_columns(views.raw_reviews(spark, sf))


@query
def na_normalize(spark, sf):
    word = F.get(F.array(*[F.lit(w) for w in rules.NA_WORDS]), (F.col("ordinal") % 23).cast("int"))
    cells = views.reviews(spark, sf).select(
        "ordinal", "product_name", F.coalesce(word, F.col("brand")).alias("brand"), "review_text"
    )
    return cleaning.normalize_na(cells)


@query
def numeric_coerce(spark, sf):
    """Prices, first words of texts and ratings in one column of text."""
    kind = F.col("ordinal") % 3
    word = F.get(F.split("review_text", " "), F.lit(0))
    cell = F.when(kind == 0, F.col("price").cast("string")).when(kind == 1, word).otherwise(F.col("rating").cast("string"))
    return views.reviews(spark, sf).select("ordinal", text.to_numeric(cell, 0.5).alias("number"))


@query
def label_encode(spark, sf):
    rows = views.labeled(spark, sf)
    issue, sentiment = F.col("issue_label"), F.col("sentiment_label")
    return rows.select(
        "review_id",
        label_id(issue, rules.ISSUES).alias("issue_id"),
        label_id(sentiment, rules.SENTIMENTS).alias("sentiment_id"),
        id_label(label_id(issue, rules.ISSUES), rules.ISSUES).alias("issue_again"),
    )


@query
def dense_review_id(spark, sf):
    rows = views.reviews(spark, sf).filter(F.col("rating") <= 2).select("ordinal", "rating")
    return dense_id(rows, "ordinal", "review_id")


@query
def clean_text(spark, sf):
    return views.reviews(spark, sf).select("ordinal", text.clean_text(F.col("review_text")).alias("review_text"))


@query
def clean_page_text(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.clean_text(F.col("html")).alias("page_text"))


@query
def rating_sentiment(spark, sf):
    return views.reviews(spark, sf).select(
        "ordinal",
        labels.rating_sentiment(F.col("rating")).alias("sentiment_label"),
        labels.rating_sentiment(F.col("rating") / 2 + 1).alias("half_star_label"),
    )


@query
def dedup_first(spark, sf):
    return cleaning.dedup_first(views.reviews(spark, sf))


@query
def clean_reviews(spark, sf):
    return views.clean_reviews(spark, sf)


def _gappy(spark, sf) -> DataFrame:
    kind = F.col("review_id") % 9
    nbsp = F.lit(" ")
    return views.sentences(spark, sf).withColumn(
        "review_text", F.when(kind == 1, nbsp).when(kind != 0, F.concat(F.lit(" \n"), "review_text", nbsp))
    )


@query
def usable_reviews(spark, sf):
    return cleaning.usable_reviews(_gappy(spark, sf)).select("review_id", "review_text", "sentiment_label")


def _noisy_label(column: str):
    kind = F.col("review_id") % 4
    return (
        F.when(kind == 0, F.concat(F.lit("  "), F.upper(column)))
        .when(kind == 1, F.concat(column, F.lit("?")))
        .when(kind == 2, F.col(column))
    )


@query
def valid_label_filter(spark, sf):
    rows = views.labeled(spark, sf).withColumn("issue_label", _noisy_label("issue_label"))
    return cleaning.labeled_rows(rows, "review_text", "issue_label", rules.ISSUES).select("review_id", "issue_label")


@query
def normalize_labels(spark, sf):
    noisy = _noisy_label("issue_label")
    return views.labeled(spark, sf).select(
        "review_id",
        text.normalized_label(noisy).alias("label"),
        labels.one_of(text.normalized_label(noisy), rules.ISSUES).alias("valid_label"),
    )


@query
def negative_reviews(spark, sf):
    return cleaning.by_sentiment(views.sentences(spark, sf), "negative").select("review_id", "rating", "review_text")


@query
def parse_boolean(spark, sf):
    """Comparisons, counts and first words of texts in one column of text."""
    kind = F.col("ordinal") % 3
    word = F.get(F.split("review_text", " "), F.lit(0))
    low = F.initcap((F.col("rating") <= 2).cast("string"))
    cell = F.when(kind == 0, low).when(kind == 1, F.col("review_votes").cast("int").cast("string")).otherwise(word)
    return views.reviews(spark, sf).select("ordinal", text.parse_boolean(cell).alias("flag"))


@query
def clip_text(spark, sf):
    return views.reviews(spark, sf).select(
        "ordinal", *[text.clip(F.col("review_text"), n).alias(f"clip_{n}") for n in (80, 600)]
    )


@query
def token_ngrams(spark, sf):
    words = text.without_stop_words(text.tokens(F.col("review_text")), rules.ENGLISH_STOP_WORDS)
    rows = views.sentences(spark, sf).select("review_id", words.alias("words"))
    return rows.withColumn("pairs", text.bigrams(F.col("words"))).select(
        "review_id",
        F.size("words").alias("n_words"),
        F.size("pairs").alias("n_pairs"),
        F.array_join(F.concat("words", "pairs"), "|").alias("terms"),
    )


# -- labels and distributions -------------------------------------------------


@query
def issue_first_match(spark, sf):
    return views.labeled(spark, sf).select("review_id", "issue_label")


@query
def issue_keyword_score(spark, sf):
    rows = annotate.with_keyword_label(views.sentences(spark, sf), "rule_label", "rule_score")
    both = annotate.with_keyword_label(rows, "guess_label", "guess_score", rules.GUESS_KEYWORDS)
    return both.select("review_id", "rule_label", "rule_score", "guess_label", "guess_score")


@query
def issue_word_score(spark, sf):
    """Issue labels when keywords match whole words only."""
    rows = annotate.with_first_match(views.sentences(spark, sf), mode="word")
    rows = annotate.with_keyword_label(rows, "rule_label", "rule_score", mode="word")
    both = annotate.with_keyword_label(rows, "guess_label", "guess_score", rules.GUESS_KEYWORDS, mode="word")
    return both.select("review_id", "issue_label", "rule_label", "rule_score", "guess_label", "guess_score")


@query
def fill_issue_label(spark, sf):
    kind = F.col("review_id") % 4
    label = F.when(kind == 0, " NaN ").when(kind == 1, " Screen ").when(kind == 2, "  ")
    rows = views.sentences(spark, sf).withColumn("issue_label", label)
    return annotate.fill_issue_label(rows).select("review_id", "issue_label")


@query
def annotation_bootstrap(spark, sf):
    return annotate.flag_for_review(views.annotated(spark, sf)).drop("review_text")


@query
def review_queue_summary(spark, sf):
    return metrics.review_queue_summary(annotate.flag_for_review(views.annotated(spark, sf)))


@query
def apply_corrections(spark, sf):
    columns = ["review_id", "manual_issue_label", "keyword_guess_label", "review_reason"]
    flagged = written(annotate.flag_for_review(views.annotated(spark, sf)).select(*columns))  # read as labels and as corrections
    corrections = flagged.filter(F.col("review_reason") == rules.REASON_CONFLICT).select(
        "review_id", F.col("keyword_guess_label").alias("corrected_label")
    )
    return annotate.apply_corrections(flagged.select("review_id", "manual_issue_label"), corrections)


@query
def sentiment_distribution(spark, sf):
    return rounded(dist.distribution(views.sentences(spark, sf), "sentiment_label"), "proportion")


@query
def issue_distribution(spark, sf):
    return rounded(dist.distribution(views.labeled(spark, sf), "issue_label"), "proportion")


@query
def negative_issue_distribution(spark, sf):
    clean = annotate.with_first_match(views.clean_reviews(spark, sf))
    return rounded(dist.negative_distribution(clean), "negative_proportion")


@query
def issue_sentiment_counts(spark, sf):
    return dist.crosstab(views.labeled(spark, sf), "issue_label", "sentiment_label", rules.SENTIMENTS)


@query
def issue_sentiment_crosstab(spark, sf):
    shares = dist.crosstab_shares(views.labeled(spark, sf), "issue_label", "sentiment_label", rules.SENTIMENTS)
    return rounded(shares, *rules.SENTIMENTS)


@query
def avg_rating_by_sentiment(spark, sf):
    return rounded(dist.mean_by(views.sentences(spark, sf), "sentiment_label", "rating", "avg_rating"), "avg_rating")


@query
def missing_values(spark, sf):
    return dist.missing_values(views.clean_reviews(spark, sf))


@query
def rating_distribution(spark, sf):
    return dist.rating_distribution(views.sentences(spark, sf))


@query
def label_samples(spark, sf):
    return dist.label_samples(views.labeled(spark, sf), "issue_label", "review_id")


# -- samples and splits --------------------------------------------------------


def _rule_labeled(spark, sf) -> DataFrame:
    """The table of labels an earlier job would have left; sampling reads it three times."""
    return written(views.annotated(spark, sf).select("review_id", "sentiment_label", "rule_issue_label"))


@query
def stratified_sample(spark, sf):
    return sampling.stratified_sample(_rule_labeled(spark, sf), STRATIFIED)


@query
def annotation_sample(spark, sf):
    return annotation.annotation_sample(written(views.clean_reviews(spark, sf)), SAMPLE)


@query
def cap_per_class(spark, sf):
    rows = _rule_labeled(spark, sf)
    return sampling.cap_per_class(rows, CAP, "sentiment_label", rules.SENTIMENTS).select("review_id", "sentiment_label")


@query
def stratified_split(spark, sf):
    rows = _rule_labeled(spark, sf).select("review_id", "rule_issue_label")
    return sampling.stratified_split(rows, "rule_issue_label", rules.ISSUES)


@query
def sample_n(spark, sf):
    negative = written(cleaning.by_sentiment(views.sentences(spark, sf), "negative"))
    return sampling.sample_n(negative, DRAWN).select("review_id", "rating", "review_text")


@query
def class_weights(spark, sf):
    rows = views.annotated(spark, sf)
    return rounded(metrics.class_weights(rows, "rule_issue_label", rules.ISSUES), "class_weight")


@query
def rare_labels(spark, sf):
    words = F.explode(text.tokens(F.col("review_text"))).alias("token")
    return metrics.rare_labels(views.sentences(spark, sf).select(words), "token")


# -- scoring and evaluation ----------------------------------------------------


@query
def softmax_scores(spark, sf):
    rows = views.probable(spark, sf)
    best = scoring.with_best_label(rows, "issue_probs", rules.ISSUES, "label", "confidence")
    probs = {f"p_{x}": F.get("issue_probs", F.lit(i)) for i, x in enumerate(rules.ISSUES)}
    wide = best.select("review_id", "label", "confidence", *[c.alias(n) for n, c in probs.items()])
    return rounded(wide, "confidence", *probs)


def _ranked_columns(array: str, n: int, prefix: str):
    item = [F.get(array, F.lit(i)) for i in range(n)]
    return [
        *[x["label"].alias(f"{prefix}_label_{i + 1}") for i, x in enumerate(item)],
        *[F.round(x["confidence"], 6).alias(f"{prefix}_confidence_{i + 1}") for i, x in enumerate(item)],
    ]


@query
def issue_triage(spark, sf):
    rows = scoring.triage(views.probable(spark, sf), "issue_probs")
    return rows.select(
        "review_id",
        "issue_mode",
        F.size("candidate_issues").alias("n_candidates"),
        F.array_join("candidate_issues.label", ",").alias("candidates"),
        *_ranked_columns("ranked_issue_predictions", 3, "rank"),
    )


@query
def score_feedback(spark, sf):
    """Every ninth text is blank and every ninth missing: these are rejects."""
    probable = scoring.rating_sentiment_probabilities(scoring.keyword_issue_probabilities(scoring.not_blank(_gappy(spark, sf))))
    rows = scoring.score_feedback(probable, top_k=5, min_candidate=0.05, dominant=0.6)
    return rounded(
        rows.select(
            "review_id", "sentiment_label", "sentiment_confidence", "primary_issue_label",
            "primary_issue_confidence", "issue_mode",
            F.array_join("candidate_issues.label", ",").alias("candidates"),
            F.array_join("ranked_issue_predictions.label", ",").alias("ranking"),
            F.array_join("ranked_sentiments.label", ",").alias("sentiment_ranking"),
            F.col("issue_probabilities")["other"].alias("p_other"),
            F.col("sentiment_probabilities")["neutral"].alias("p_neutral"),
        ),
        "sentiment_confidence", "primary_issue_confidence", "p_other", "p_neutral",
    )


@query
def score_feedback_rejects(spark, sf):
    return scoring.rejects(_gappy(spark, sf))


PROBS = ["confidence", "top_1_prob", "top_2_prob", "top_3_prob"]


@query
def topk_predictions(spark, sf):
    rows = views.predictions(spark, sf)
    names = [f"top_{i}_{part}" for i in (1, 2, 3) for part in ("label", "prob")]
    return rounded(rows.select("review_id", *names), *PROBS[1:])


@query
def prediction_table(spark, sf):
    rows = views.predictions(spark, sf)
    return rounded(rows.select("review_id", "review_text", "true_label", "pred_label", "correct", "confidence"), "confidence")


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(views.predictions(spark, sf), rules.ISSUES)


@query
def classification_report(spark, sf):
    return rounded(
        metrics.classification_report(views.predictions(spark, sf), rules.ISSUES), "precision", "recall", "f1_score"
    )


@query
def classifier_metrics(spark, sf):
    return rounded(
        metrics.classifier_metrics(views.predictions(spark, sf), rules.ISSUES), "accuracy", "macro_f1", "weighted_f1"
    )


@query
def classification_report_lines(spark, sf):
    rows = written(views.predictions(spark, sf).select("true_label", "pred_label"))
    accuracy = metrics.classifier_metrics(rows, rules.ISSUES).select("accuracy").scalar()
    return reports.classification_report_text(metrics.classification_report(rows, rules.ISSUES), accuracy)


@query
def error_review_queue(spark, sf):
    return rounded(metrics.error_review_queue(views.predictions(spark, sf), "review_id"), *PROBS)


@query
def error_counts(spark, sf):
    return metrics.error_counts(views.predictions(spark, sf))


# -- clusters ------------------------------------------------------------------


@query
def l2_normalize(spark, sf):
    rows = views.embeddings(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: x * 3))
    unit = clusters.l2_normalize(rows, "embedding")
    return unit.select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 5))


@query
def cluster_centers(spark, sf):
    centers = clusters.cluster_centers(views.embeddings(spark, sf))
    return rounded(centers.select("cluster_id", F.posexplode("center").alias("dim", "value")), "value")


@query
def distance_to_center(spark, sf):
    rows = views.embeddings(spark, sf)
    measured = clusters.with_distance(rows, clusters.cluster_centers(rows)).drop("embedding")
    return rounded(measured, "distance_to_cluster_center")


@query
def nearest_center(spark, sf):
    rows = views.embeddings(spark, sf)
    assigned = clusters.nearest_center(rows.drop("cluster_id"), clusters.cluster_centers(rows)).drop("embedding")
    return rounded(assigned, "distance_to_cluster_center")


@query
def nearest_center_blocks(spark, sf):
    """As ``nearest_center``, with three centres at most in a value."""
    rows = written(views.embeddings(spark, sf))
    centers = clusters.cluster_centers(rows)
    assigned = assignment.assign_to_centers(rows.drop("cluster_id"), centers, "vec_id", max_numbers=3 * 64)
    return rounded(assigned.drop("embedding"), "distance_to_cluster_center")


@query
def silhouette(spark, sf):
    value = clusters.silhouette(views.embeddings(spark, sf))
    return spark.range(1).select(F.round(F.lit(value), 6).alias("silhouette"))


@query
def cluster_keywords(spark, sf):
    return keywords.keywords(views.pointed(spark, sf))


@query
def issue_keywords(spark, sf):
    scores = keywords.keyword_scores(views.labeled(spark, sf), cluster="issue_label", n=12)
    return rounded(scores, "score")


@query
def cluster_profile(spark, sf):
    return rounded(clusters.cluster_profile(views.clustered(spark, sf)), "avg_issue_confidence", "negative_ratio")


@query
def representative_reviews(spark, sf):
    return clusters.representative_reviews(_review_clusters(spark, sf))


def _review_clusters(spark, sf) -> DataFrame:
    """The table the clustering job leaves for the summary."""
    return written(clusters.review_clusters(views.clustered(spark, sf)))


def _summary(spark, sf) -> DataFrame:
    return keywords.cluster_summary(_review_clusters(spark, sf))


@query
def cluster_summary(spark, sf):
    return rounded(_summary(spark, sf), "avg_issue_confidence", "negative_ratio")


# -- themes, priority, reports ---------------------------------------------------


def _labeled_clusters(spark, sf) -> DataFrame:
    return themes.label_themes(_summary(spark, sf))


@query
def cluster_themes(spark, sf):
    rows = _labeled_clusters(spark, sf)
    return rows.select("cluster_id", "cluster_theme", "theme_confidence_score", "major_issue")


@query
def theme_distribution(spark, sf):
    return themes.theme_distribution(_labeled_clusters(spark, sf))


@query
def recommended_actions(spark, sf):
    """For every cluster the action under its own theme and under each theme of the rules."""
    known = F.array("cluster_theme", *[F.lit(t) for t, _, _ in rules.THEME_RULES], F.lit(rules.DEFAULT_THEME))
    rows = _labeled_clusters(spark, sf).select("cluster_id", "major_issue", "top_keywords", F.posexplode(known).alias("theme_no", "theme"))
    action = themes.recommended_action(F.col("theme"), F.col("major_issue"), F.col("top_keywords"))
    return rows.select("cluster_id", "theme_no", "theme", action.alias("action"))


@query
def minmax_normalize(spark, sf):
    return rounded(
        priority.minmax_normalize(views.sentences(spark, sf), "price", "price_score").select("review_id", "price_score"),
        "price_score",
    )


def _rounded_priority(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return rounded(df, *[c for c in df.columns if kinds[c] == "double"])


@query
def priority_scores(spark, sf):
    return _rounded_priority(priority.priority_scores(_labeled_clusters(spark, sf)))


@query
def priority_scores_minimal(spark, sf):
    rows = _labeled_clusters(spark, sf).select(
        "cluster_id", "cluster_theme", F.col("cluster_size").cast("string").alias("cluster_size"), "major_issue", "top_keywords"
    )
    return _rounded_priority(priority.priority_scores(rows))


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("representative_reviews", F.array_join("representative_reviews", " || "))


@query
def cluster_listing(spark, sf):
    return _flat(priority.cluster_listing(_labeled_clusters(spark, sf), 5))


@query
def priority_listing(spark, sf):
    return _flat(priority.priority_listing(priority.priority_scores(_labeled_clusters(spark, sf)), 4))


@query
def clustering_report_lines(spark, sf):
    value = clusters.silhouette(views.embeddings(spark, sf))
    summary = keywords.cluster_summary(_review_clusters(spark, sf), value)
    return reports.clustering_report(written(themes.label_themes(summary)), top_n=7, sentiment="all")


@query
def insight_report_lines(spark, sf):
    ranked = written(priority.priority_scores(_labeled_clusters(spark, sf)))
    return reports.insight_report(ranked, top_n=6, sentiment="all")


# -- machine learning (no SQL counterpart) ---------------------------------------


def _annotations(spark, sf) -> DataFrame:
    return written(annotate.flag_for_review(views.annotated(spark, sf)), "zstd")


def _issue_model(spark, sf):
    return training.train_issue_classifier(_annotations(spark, sf))


def _sentiment_model(spark, sf):
    return training.train_baseline_sentiment(written(views.clean_reviews(spark, sf), "zstd"))


@query
def baseline_sentiment(spark, sf):
    return _sentiment_model(spark, sf).metrics()


@query
def baseline_feedback(spark, sf):
    scored = training.baseline_feedback(views.sentences(spark, sf), _sentiment_model(spark, sf).model)
    return scored.select("review_id", "sentiment_label", "issue_label")


@query
def capped_sentiment(spark, sf):
    clean = written(views.clean_reviews(spark, sf))
    return training.train_capped_sentiment(clean, CAP).report()


@query
def issue_classifier(spark, sf):
    return _issue_model(spark, sf).predictions


@query
def score_issues(spark, sf):
    scored = training.score_issues(views.sentences(spark, sf), _issue_model(spark, sf).model)
    return scored.select("review_id", "predicted_issue_label", "predicted_issue_confidence")


@query
def score_sentiment(spark, sf):
    scored = training.score_sentiment(views.sentences(spark, sf), _sentiment_model(spark, sf).model)
    return scored.select(
        "review_id", "sentiment_label", "sentiment_confidence",
        F.array_join("ranked_sentiments.label", ",").alias("ranking"),
    )


@query
def embed_reviews(spark, sf):
    vectors = insight.embed_reviews(views.sentences(spark, sf).select("review_id", "review_text"))
    return vectors.select("review_id", F.posexplode("embedding").alias("dim", "value"))


@query
def kmeans_clusters(spark, sf):
    rows, _ = insight.kmeans_clusters(written(views.embeddings(spark, sf).drop("cluster_id")))
    return rows.select("vec_id", "cluster_id")


@query
def kmeans_agreement(spark, sf):
    """Rows whose cluster is that of the nearest fitted centre."""
    rows, centers = insight.kmeans_clusters(written(views.embeddings(spark, sf).drop("cluster_id")))
    again = clusters.nearest_center(rows.withColumnRenamed("cluster_id", "fitted"), centers)
    return again.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("fitted") == F.col("cluster_id")).alias("n_agree"))


@query
def lloyd_step(spark, sf):
    """One k-means step from the centres of the labels: assign, then average."""
    rows = views.embeddings(spark, sf)
    assigned = clusters.nearest_center(rows.drop("cluster_id"), clusters.cluster_centers(rows))
    moved = clusters.cluster_centers(assigned)
    return rounded(moved.select("cluster_id", F.posexplode("center").alias("dim", "value")), "value")


@query
def minibatch_steps(spark, sf):
    """Three mini-batches of half the rows move the centres of the labels; the state is a table."""
    rows = written(views.embeddings(spark, sf))
    start = clusters.cluster_centers(rows).withColumn("n", F.lit(0).cast("bigint"))
    state = assignment.minibatch_kmeans(rows.drop("cluster_id"), start, "vec_id", share=0.5, steps=3, patience=None)
    return rounded(state.select("cluster_id", "n", F.posexplode("center").alias("dim", "value")), "value")


@query
def embed_norms(spark, sf):
    """Length of every hashed vector: 1, or 0 without a term."""
    vectors = insight.embed_reviews(views.sentences(spark, sf).select("review_id", "review_text"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select("review_id", F.size("embedding").alias("n_dims"), F.round(norm, 4).alias("norm"))


def _terms(spark, sf) -> DataFrame:
    """Words and word pairs of every review, as the classifiers see them."""
    rows = views.sentences(spark, sf).select("review_id", "review_text")
    return PipelineModel(training.term_stages()).transform(rows).select("review_id", "_terms")


@query
def tfidf_vocabulary(spark, sf):
    return rounded(training.counted_vocabulary(written(_terms(spark, sf))), "idf")


@query
def tfidf_vectors(spark, sf):
    rows = written(_terms(spark, sf))
    return rounded(training.tfidf_vectors(rows, training.counted_vocabulary(rows)), "weight")


def _term_space(spark, sf, rank: int, **options):
    """TF-IDF table of all reviews, and its leading directions."""
    docs = training.written_terms(views.sentences(spark, sf).select("review_id", "review_text"), "review_id")
    reviews = embedding.by_review(docs, written(training.counted_vocabulary(docs)))
    return reviews, embedding.fit_by_review(reviews, rank, **options)


@query
def lsa_strength(spark, sf):
    """The two leading singular values after two passes, with what they leave of the table."""
    _, space = _term_space(spark, sf, 2, oversample=0, passes=2)
    rows = [(i, s, s * s / space.total) for i, s in enumerate(space.singular_values, 1)]
    strength = spark.createDataFrame(rows, "place INT, singular_value DOUBLE, share DOUBLE")
    n_terms = space.directions.agg(F.count(F.lit(1))).scalar()
    strength = strength.withColumns({"n_terms": n_terms, "residual": F.lit(1.0 - space.explained)})
    return rounded(strength, "singular_value", "share", "residual")


@query
def lsa_lengths(spark, sf):
    """Length of every review along the two leading directions, and of what is left of it."""
    reviews, space = _term_space(spark, sf, 2, oversample=0, passes=2)
    along = embedding.coordinates_by_review(reviews, space.directions, 2)
    squared = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    rest = F.greatest(F.lit(0.0), 1 - F.col("_squared"))
    measured = along.withColumn("_squared", squared).select("review_id", F.sqrt("_squared").alias("length"), rest.alias("residual"))
    return measured.select("review_id", F.round("length", 5).alias("length"), F.round("residual", 5).alias("residual"))


@query
def learnt_embedding(spark, sf):
    """All reviews along the 64 leading directions."""
    rows = views.sentences(spark, sf).select("review_id", "review_text")
    vectors = embedding.learnt_embedding(written(rows, "zstd"))
    return vectors.select("review_id", F.posexplode("embedding").alias("dim", "value"))


def _labelled_terms(spark, sf, label: str) -> DataFrame:
    """(id, ``_terms``, label) of every review."""
    rows = views.labeled(spark, sf).select("review_id", "review_text", label)
    return written(PipelineModel(training.term_stages()).transform(rows).select("review_id", "_terms", label))


def _scored_by_table(spark, sf, label: str, names: list[str]) -> DataFrame:
    docs = _labelled_terms(spark, sf, label)
    vocabulary, model = training.fit_term_model(docs, label, names)
    return training.score_by_table(docs, vocabulary, model.drop("smoothing"), names, "probs")


@query
def score_issues_table(spark, sf):
    """Issue and confidence of every review from a written table of weights."""
    scored = _scored_by_table(spark, sf, "issue_label", rules.ISSUES)
    best = scoring.with_best_label(scored, "probs", rules.ISSUES, "predicted_issue_label", "predicted_issue_confidence")
    return rounded(best.select("review_id", "predicted_issue_label", "predicted_issue_confidence"), "predicted_issue_confidence")


@query
def score_sentiment_table(spark, sf):
    scored = _scored_by_table(spark, sf, "sentiment_label", rules.SENTIMENTS).drop("sentiment_label")
    best = scoring.sentiment_scores(scored, "probs")
    return rounded(
        best.select("review_id", "sentiment_label", "sentiment_confidence", F.array_join("ranked_sentiments.label", ",").alias("ranking")), "sentiment_confidence"
    )


@query
def issue_smoothing_path(spark, sf):
    """Models judged on the validation part; the best by macro-F1 is chosen."""
    rows = views.annotated(spark, sf).select("review_id", "review_text", "rule_issue_label")
    docs = PipelineModel(training.term_stages()).transform(rows).select("review_id", "_terms", "rule_issue_label")
    path = training.smoothing_path(written(docs), "rule_issue_label", rules.ISSUES, SMOOTHING)
    return rounded(path, "accuracy", "macro_f1")


@query
def capped_penalty_path(spark, sf):
    """Logistic regression for several penalties on one feature table, chosen on validation rows."""
    rows = cleaning.usable_reviews(written(views.clean_reviews(spark, sf))).select("review_id", "review_text", "sentiment_label")
    capped = sampling.cap_per_class(rows, CAP, "sentiment_label", rules.SENTIMENTS)
    return training.train_path(capped, "sentiment_label", rules.SENTIMENTS)[1]


@query
def sentiment_test_rows(spark, sf):
    """Test rows per class of the baseline's split."""
    rows = cleaning.usable_reviews(views.clean_reviews(spark, sf)).select("review_id", "sentiment_label")
    split = sampling.stratified_split(rows, "sentiment_label", rules.SENTIMENTS, 0.2, 0.0)
    return dist.value_counts(split.filter("split = 'test'"), "sentiment_label", "n_rows")


@query
def streamed_feedback(spark, sf):
    """All reviews scored or rejected by streams that are stopped after a batch and started again; each row once."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = views.reviews(spark, sf)
    files = max(4, views.text_bytes(spark, sf) >> 26)
    rows.repartition(files).write.parquet(f"{folder}/in")
    batch = -(-files // 4)
    streaming.feedback_stream(spark, f"{folder}/in", rows.schema, folder, files_per_batch=batch, stop_after=1)
    streaming.feedback_stream(spark, f"{folder}/in", rows.schema, folder, files_per_batch=batch)
    scored = spark.read.parquet(f"{folder}/feedback").select("ordinal", F.lit(None).cast("string").alias("reason"), "issue_label", "rating_label")
    rejected = spark.read.schema("ordinal BIGINT, reason STRING").parquet(f"{folder}/feedback_rejects")
    rejected = rejected.select("ordinal", "reason", *[F.lit(None).cast("string").alias(c) for c in ("issue_label", "rating_label")])
    return scored.unionByName(rejected).groupBy("ordinal", "reason", "issue_label", "rating_label").agg(F.count(F.lit(1)).alias("times"))


@query
def split_csv(spark, sf):
    """Documents written as CSV with line ends in their cells, read back by many tasks for each file."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = views.read_table(spark, f"{sf}/documents.parquet").select("doc_id", "source", "text")
    rows.repartition(max(2, views.text_bytes(spark, sf) >> 28)).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
    back = read_reviews(spark, folder, "doc_id BIGINT", ordinal="ordinal", split=True)
    body = F.coalesce("text", F.lit(""))
    same = F.count(F.lit(1)).over(Window.partitionBy("ordinal")).alias("same_ordinal")
    return back.select("doc_id", "source", F.length(body).alias("n_chars"), F.md5(body.cast("binary")).alias("digest"), same)


@query
def feedback_by_saved_models(spark, sf):
    """Both models trained, saved, loaded and applied to reviews of which some are blank."""
    folder = f"{shared_folder(spark)}/feedback-{uuid.uuid4().hex}"
    _sentiment_model(spark, sf).model.write().save(f"{folder}/sentiment")
    _issue_model(spark, sf).model.write().save(f"{folder}/issue")
    rows = _gappy(spark, sf).select("review_id", "review_text")
    scored = training.feedback_job(rows, f"{folder}/sentiment", f"{folder}/issue", folder)
    return scored.select("review_id", "sentiment_label", "primary_issue_label", "issue_mode")


@query
def review_clusters(spark, sf):
    return insight.cluster_reviews(written(views.clean_reviews(spark, sf))).reviews
