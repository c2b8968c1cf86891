"""Text classifiers as Spark ML pipelines, with weights, split and evaluation."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer,
    SQLTransformer, StopWordsRemover,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plaintide import rules
from plaintide.functions.text import TOKEN
from plaintide.operators import linear, metrics, sampling, scoring
from plaintide.operators.annotate import with_first_match
from plaintide.operators.cleaning import labeled_rows, usable_reviews
from plaintide.operators.frequent import frequent_terms
from plaintide.operators.ids import most_frequent
from plaintide.plans.logistic import as_model, feature_blocks, fit_blocks
from plaintide.plans.reports import classification_report_text
from plaintide.schema import label_id
from plaintide.session import written
from plaintide.sources.writers import write_label_mapping, write_lines, write_metrics, write_table


@dataclass
class Trained:
    """A fitted pipeline with the scored rows it was tested on."""

    model: PipelineModel
    labels: list[str]
    predictions: DataFrame
    validation: DataFrame

    def metrics(self) -> DataFrame:
        return metrics.classifier_metrics(self.predictions, self.labels)

    def validation_metrics(self) -> DataFrame:
        return metrics.classifier_metrics(self.validation, self.labels)

    def report(self) -> DataFrame:
        return metrics.classification_report(self.predictions, self.labels)

    def confusion(self) -> DataFrame:
        return metrics.confusion_matrix(self.predictions, self.labels)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(term, n, first): every occurrence with n = 1, and every term of a row once more with first = 1."""
    every = docs.select(F.explode("_terms").alias("term"), F.lit(1).alias("n"), F.lit(0).alias("first"))
    once_a_row = docs.select(F.explode(F.array_distinct("_terms")).alias("term"), F.lit(0).alias("n"), F.lit(1).alias("first"))
    return every.unionByName(once_a_row)


def _count_terms(occurrences: DataFrame) -> DataFrame:
    """Occurrences of each term, and rows that have it."""
    return occurrences.groupBy("term").agg(F.sum("n").alias("tf"), F.sum("first").alias("df"))


def _allowed(counts: DataFrame, docs: DataFrame, min_df: float, max_df: float) -> DataFrame:
    rows = counts.withColumn("_rows", docs.agg(F.count(F.lit(1))).scalar())
    return rows.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("_rows")))


def _with_idf(terms: DataFrame) -> DataFrame:
    return terms.select("term", "tf", "df", (F.log((1 + F.col("_rows")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_vocabulary(docs: DataFrame, min_df: float = 3.0, max_df: float = 0.9, max_features: int | None = 50_000) -> DataFrame:
    """(term, tf, df, idf) of the ``max_features`` most frequent terms of the ``_terms`` arrays.

    As one lazy plan it counts the terms anew for each of its readers;
    ``counted_vocabulary`` is the job that writes the counts.
    """
    terms = _allowed(_count_terms(_occurrences(docs)), docs, min_df, max_df)
    return _with_idf(most_frequent(terms, max_features, "tf", "term"))


def counted_vocabulary(
    docs: DataFrame, min_df: float = 3.0, max_df: float = 0.9, max_features: int | None = 50_000, bits: int = 22
) -> DataFrame:
    """``tfidf_vocabulary`` as a job on a table: only terms that can get in are counted by themselves."""
    allowed = lambda counts: _allowed(counts, docs, min_df, max_df)
    terms = docs.select(F.explode("_terms").alias("term"))
    return _with_idf(frequent_terms(_occurrences(docs), _count_terms, allowed, max_features, "tf", bits, terms)[1])


def tfidf_vectors(docs: DataFrame, vocabulary: DataFrame, ident: str = "review_id") -> DataFrame:
    """(id, term, weight) of the terms of each row that the vocabulary has, scaled to length 1.

    Terms meet the vocabulary where they are read, so the others don't move; counts and
    lengths need one shuffle, by id.
    """
    terms = docs.select(ident, F.explode("_terms").alias("term")).join(vocabulary.select("term", "idf"), "term")
    counts = terms.repartition(ident).groupBy(ident, "term", "idf").agg(F.count(F.lit(1)).alias("_n"))
    weighed = counts.withColumn("_w", F.col("_n") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(ident)))
    return weighed.select(ident, "term", (F.col("_w") / norm).alias("weight"))


def _collected(vocabulary: DataFrame) -> list[tuple[str, float]]:
    """The vocabulary in the driver, most frequent term first: at most ``max_features`` rows."""
    rows = sorted(vocabulary.collect(), key=lambda r: (-r.tf, r.term))
    if not rows:
        raise ValueError("no term is frequent enough for the vocabulary")
    return [(row.term, row.idf) for row in rows]


def term_stages(text_col: str = "review_text", stop_words: Sequence[str] = tuple(rules.ENGLISH_STOP_WORDS)) -> list:
    """Words and word pairs of a text as the array ``_terms``."""
    tokens = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=TOKEN, gaps=False, toLowercase=True)
    words = StopWordsRemover(inputCol="_tokens", outputCol="_words", stopWords=list(stop_words))
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    terms = SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__")
    return [tokens, words, pairs, terms]


def written_terms(rows: DataFrame, *keep: str, text_col: str = "review_text", stop_words: Sequence[str] = tuple(rules.ENGLISH_STOP_WORDS)) -> DataFrame:
    """The columns ``keep`` and ``_terms``, of a table of the words alone.

    Pairs are two thirds of the terms' bytes, so whoever reads the table puts them together.
    """
    stages = term_stages(text_col, stop_words)
    words = written(PipelineModel(stages[:2]).transform(rows).select(*keep, "_words"), "zstd")
    return PipelineModel(stages[2:]).transform(words).select(*keep, "_terms")


def tfidf_stages(vocabulary: Sequence[tuple[str, float]]) -> list:
    """``_terms`` to the vector ``_features`` of tf * idf, scaled to length 1."""
    counter = CountVectorizerModel.from_vocabulary([t for t, _ in vocabulary], inputCol="_terms", outputCol="_counts")
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense([idf for _, idf in vocabulary]), inputCol="_counts", outputCol="_tfidf"
    )
    return [counter, weigh, Normalizer(p=2.0, inputCol="_tfidf", outputCol="_features")]


@dataclass
class Features:
    """Labelled rows as one written table of blocks of TF-IDF vectors, with the vectors and the stages that make them."""

    stages: list
    table: DataFrame
    blocks: DataFrame


def text_features(
    train: DataFrame,
    label: str,
    labels: Sequence[str],
    text_col: str = "review_text",
    max_features: int = 50_000,
    min_df: float = 3.0,
    max_df: float = 0.9,
    stop_words: Sequence[str] = tuple(rules.ENGLISH_STOP_WORDS),
) -> Features:
    """TF-IDF over words and word pairs with balanced class weights; idf is ln((1 + n) / (1 + df)) + 1, vectors have length 1."""
    rows = metrics.with_class_weights(train, label, labels, "_weight").select(
        text_col, label_id(F.col(label), labels).cast("double").alias("_label"), "_weight"
    )
    stages = term_stages(text_col, stop_words)
    # Terms are read to count them, to weigh them and to count rows: tokenise once.
    prepared = written_terms(rows, "_label", "_weight", text_col=text_col, stop_words=stop_words)
    vectorize = tfidf_stages(_collected(counted_vocabulary(prepared, min_df, max_df, max_features)))
    weighted = PipelineModel(vectorize).transform(prepared).select("_features", "_label", "_weight")
    return Features([*stages, *vectorize], weighted, feature_blocks(weighted))


def fit_regression(features: Features, c: float = 1.0, max_iter: int = 1000) -> PipelineModel:
    """Weighted logistic regression on written features.

    The penalty is that of a loss summed over rows with strength ``c``: balanced weights sum to
    the number of rows, so the mean loss takes 1 / (c * rows).  A table with one label needs no fit.
    """
    columns = dict(
        featuresCol="_features", labelCol="_label", weightCol="_weight",
        predictionCol="_prediction", rawPredictionCol="_raw", probabilityCol="probability",
    )
    rows, kinds, last = features.table.agg(F.count(F.lit(1)), F.count_distinct("_label"), F.max("_label")).first()
    penalty = 1.0 / (c * rows)
    if kinds < 2:
        return PipelineModel([*features.stages, LogisticRegression(family="multinomial", regParam=penalty, standardization=False, **columns).fit(features.table)])
    coefficients, intercepts, _ = fit_blocks(features.blocks, len(features.stages[-3].vocabulary), int(last) + 1, penalty, max_iter)
    return PipelineModel([*features.stages, as_model(coefficients, intercepts, **columns)])


def fit_text_classifier(
    train: DataFrame, label: str, labels: Sequence[str], text_col: str = "review_text", max_iter: int = 1000, c: float = 1.0, **features
) -> PipelineModel:
    """TF-IDF over words and word pairs, then weighted logistic regression."""
    return fit_regression(text_features(train, label, labels, text_col, **features), c, max_iter)


def linear_tables(model: PipelineModel) -> tuple[DataFrame, DataFrame]:
    """A fitted classifier as the tables (term, idf) and (term, weights) that ``linear.class_scores`` reads."""
    counter, weigh, _, regression = model.stages[-4:]
    spark = SparkSession.active()
    terms = [(t, float(w)) for t, w in zip(counter.vocabulary, weigh.getScalingVec())]
    matrix, intercepts = regression.coefficientMatrix.toArray(), regression.interceptVector.toArray()
    weights = [(t, w) for (t, _), w in zip(terms, matrix.T.tolist())]
    return (
        spark.createDataFrame(terms, "term STRING, idf DOUBLE"),
        spark.createDataFrame([*weights, (None, intercepts.tolist())], "term STRING, weights ARRAY<DOUBLE>"),
    )


def train_path(
    rows: DataFrame, label: str, labels: Sequence[str], strengths: Sequence[float] = (0.1, 1.0, 10.0),
    test: float = 0.2, validation: float = 0.15, seed: int = 42, max_iter: int = 1000, **features,
) -> tuple[Trained, DataFrame]:
    """The classifier whose penalty does best on the validation rows, and the table (penalty, accuracy, macro_f1, rows, chosen).

    All penalties (1 / strength) are fitted on one feature table and judged on the validation
    part; the test part is scored by the chosen one only.
    """
    parts = written(sampling.stratified_split(rows, label, labels, test, validation, seed=seed), "zstd")
    table = text_features(parts.filter("split = 'train'"), label, labels, **features)
    models = {1.0 / c: fit_regression(table, c, max_iter) for c in strengths}

    def predictions(model: PipelineModel, split: str) -> DataFrame:
        scored = score_classes(parts.filter(F.col("split") == split), model, "_probs")
        return scoring.prediction_table(scored, label, "_probs", labels, keep=["review_id"])

    judged = [predictions(m, "validation").select(F.lit(p).alias("penalty"), "true_label", "pred_label") for p, m in models.items()]
    path = written(linear.best_fit(functools.reduce(DataFrame.unionByName, judged), "penalty"))
    best = models[path.filter("chosen").first().penalty]
    return Trained(best, list(labels), predictions(best, "test"), predictions(best, "validation")), path


def fit_term_model(
    docs: DataFrame, label: str, labels: Sequence[str], smoothing: Sequence[float] = (1.0,), max_features: int | None = 50_000
) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, model) as written tables: naive Bayes weights of the ``_terms`` of labelled rows.

    Needs counts only, so it grows with a cluster where an iterative fit doesn't.
    """
    vocabulary = written(counted_vocabulary(docs.select("_terms"), max_features=max_features))
    counts = written(linear.class_term_counts(docs, vocabulary, label))
    sizes = docs.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    n_terms = vocabulary.agg(F.count(F.lit(1)).cast("double")).scalar()
    return vocabulary, written(linear.naive_bayes(counts, sizes, labels, n_terms, smoothing))


def score_by_table(
    docs: DataFrame, vocabulary: DataFrame, model: DataFrame, labels: Sequence[str], name: str, ident: str = "review_id", by: str | None = None
) -> DataFrame:
    """``docs`` without ``_terms``, with the class probabilities of a model that is a table."""
    vectors = tfidf_vectors(docs, vocabulary, ident)
    return linear.class_scores(docs.drop("_terms"), vectors, model, labels, name, ident, by)


def smoothing_path(
    docs: DataFrame, label: str, labels: Sequence[str], smoothing: Sequence[float], test: float = 0.2, validation: float = 0.15, seed: int = 42,
    ident: str = "review_id",
) -> DataFrame:
    """(smoothing, accuracy, macro_f1, rows, chosen): naive Bayes fitted on the training part, chosen on the validation part.

    One table of counts gives the weights for all values, and one pass scores them all.
    """
    split = sampling.stratified_split(docs.select(ident, label), label, labels, test, validation, seed=seed)
    parts = written(docs.join(split.select(ident, "split"), ident))
    vocabulary, model = fit_term_model(parts.filter("split = 'train'"), label, labels, smoothing)
    judged = parts.filter("split = 'validation'").select(ident, F.col(label).alias("true_label"), "_terms")
    scored = score_by_table(judged, vocabulary, model, labels, "_probs", ident, "smoothing")
    best = scoring.with_best_label(scored, "_probs", labels, "pred_label", "confidence")
    return linear.best_fit(best, "smoothing")


def score_classes(df: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    """Add class probabilities in label-id order as ``ARRAY<DOUBLE>``."""
    scored = model.transform(df).withColumn(name, vector_to_array("probability"))
    return scored.select(*df.columns, name)


def score_issues(df: DataFrame, model: PipelineModel, labels: Sequence[str] = tuple(rules.ISSUES)) -> DataFrame:
    """Predicted issue and confidence of every review."""
    scored = score_classes(df, model, "_probs")
    return scoring.with_best_label(
        scored, "_probs", labels, "predicted_issue_label", "predicted_issue_confidence"
    ).drop("_probs")


def score_sentiment(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Sentiment label, confidence, probability map and ranked classes."""
    bare = df.drop("sentiment_label")
    return scoring.sentiment_scores(score_classes(bare, model, "_probs"), "_probs").drop("_probs")


def baseline_feedback(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Model sentiment and first-match issue of every review."""
    return with_first_match(score_sentiment(df, model), "issue_label")


def score_feedback(
    df: DataFrame, sentiment_model: PipelineModel, issue_model: PipelineModel, **triage_options
) -> DataFrame:
    """Sentiment and issue triage of every review from two fitted models.

    Blank reviews can't be scored; ``scoring.rejects`` gives them.
    """
    scored = score_classes(scoring.not_blank(df), sentiment_model, "_sentiment")
    both = score_classes(scored, issue_model, "_issue")
    return scoring.score_feedback(both, "_sentiment", "_issue", **triage_options).drop("_sentiment", "_issue")


def feedback_job(
    df: DataFrame, sentiment_model: str, issue_model: str, out: str, ident: str = "review_id", **triage_options
) -> DataFrame:
    """Score reviews with two saved models; scored rows and rejects together are all rows."""
    models = [PipelineModel.load(path) for path in (sentiment_model, issue_model)]
    write_table(score_feedback(df, *models, **triage_options), f"{out}/feedback")
    write_table(scoring.rejects(df, ident), f"{out}/feedback_rejects")
    return df.sparkSession.read.parquet(f"{out}/feedback")


def save(trained: Trained, out: str, title: str | None = None) -> None:
    """Model, label map, metrics, report, confusion matrix and test predictions."""
    spark = trained.predictions.sparkSession
    tested = written(trained.predictions)
    trained.model.write().overwrite().save(f"{out}/model")
    write_label_mapping(spark, trained.labels, f"{out}/label_mapping")
    summary = metrics.classifier_metrics(tested, trained.labels)
    write_metrics(summary, f"{out}/metrics")
    report = metrics.classification_report(tested, trained.labels)
    accuracy = spark.read.json(f"{out}/metrics").agg(F.first("accuracy")).scalar()
    write_lines(classification_report_text(report, accuracy, title=title), f"{out}/report")
    write_table(metrics.confusion_matrix(tested, trained.labels), f"{out}/confusion_matrix", "csv")
    write_table(tested, f"{out}/test_predictions")


def _train(rows: DataFrame, label: str, labels: Sequence[str], test: float, validation: float, seed: int, **options) -> Trained:
    parts = written(sampling.stratified_split(rows, label, labels, test, validation, seed=seed), "zstd")
    model = fit_text_classifier(parts.filter("split = 'train'"), label, labels, **options)

    def predictions(split: str) -> DataFrame:
        scored = score_classes(parts.filter(F.col("split") == split), model, "_probs")
        return scoring.prediction_table(scored, label, "_probs", labels, keep=["review_id"])

    return Trained(model, list(labels), predictions("test"), predictions("validation"))


def train_baseline_sentiment(clean: DataFrame, seed: int = 42, **options) -> Trained:
    """Sentiment from text on the natural class mix, 80/20."""
    rows = usable_reviews(clean).select("review_id", "review_text", "sentiment_label")
    return _train(rows, "sentiment_label", rules.SENTIMENTS, 0.2, 0.0, seed, **options)


def train_capped_sentiment(clean: DataFrame, max_per_class: int = 10_000, seed: int = 42, **options) -> Trained:
    """Sentiment from text with at most ``max_per_class`` rows a class, 72/8/20."""
    rows = usable_reviews(clean).select("review_id", "review_text", "sentiment_label")
    capped = sampling.cap_per_class(rows, max_per_class, "sentiment_label", rules.SENTIMENTS, seed=seed)
    return _train(capped, "sentiment_label", rules.SENTIMENTS, 0.2, 0.1, seed, **options)


def train_issue_classifier(annotated: DataFrame, seed: int = 42, **options) -> Trained:
    """Issue from text on annotated rows, 68/12/20, balanced class weights."""
    rows = labeled_rows(annotated, "review_text", "manual_issue_label", rules.ISSUES)
    rows = rows.select("review_id", "review_text", "manual_issue_label")
    return _train(rows, "manual_issue_label", rules.ISSUES, 0.2, 0.15, seed, **options)
