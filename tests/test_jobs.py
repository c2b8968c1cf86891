import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from plaintide import rules, streaming
from plaintide.operators import scoring
from plaintide.operators.cleaning import clean_reviews as clean_job
from plaintide.plans import annotation, insight, training
from plaintide.schema import RAW_REVIEWS
from plaintide.sources import readers, writers
from verification import views

SF = "/root/testdata/sf0.001"
HEADER = "Product Name,Brand Name,Price,Rating,Reviews,Review Votes\n"


def test_csv_reader(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEADER + 'P,N/A,1.5,4,"two\nlines, ""quoted""",3\nQ,x,oops,,plain,nan\n', encoding="utf-8-sig")
    (tmp_path / "a.csv").write_text(HEADER + "R,y,2,3,first,0\n", encoding="utf-8-sig")
    df = readers.read_reviews(spark, str(tmp_path), RAW_REVIEWS, ordinal="ordinal")
    rows = df.orderBy("ordinal").collect()
    assert len({r.ordinal for r in rows}) == 3
    assert [r["Product Name"] for r in rows] == ["R", "P", "Q"]
    assert rows[1].Reviews == 'two\nlines, "quoted"'
    assert rows[1]["Brand Name"] is None and rows[1].Price == 1.5
    assert rows[2].Price is None and rows[2].Rating is None and rows[2]["Review Votes"] is None


def test_cleaning_straight_from_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "P,x,1,abc,some text,0\nQ,x,oops,2,more text,1\nR,x,3,,last text,1\n")
    raw = readers.read_reviews(spark, str(tmp_path), ordinal="ordinal")
    rows = clean_job(raw).orderBy("review_id").collect()
    assert [(r.rating, r.sentiment_label) for r in rows] == [(None, None), (2.0, "negative"), (None, "positive")]
    assert [r.price for r in rows] == [1.0, None, 3.0]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc', 2.5)], "id BIGINT, t STRING, x DOUBLE")
    writers.write_table(df, str(tmp_path / "t"), "csv")
    again = readers.read_reviews(spark, str(tmp_path / "t"), "id BIGINT, t STRING, x DOUBLE")
    assert again.collect() == df.collect()
    with pytest.raises(ValueError):
        writers.write_table(df, str(tmp_path / "u"), "xml")


def test_label_mapping(spark, tmp_path):
    missing = readers.read_label_mapping(spark, str(tmp_path / "none"))
    assert [r.label for r in missing.orderBy("label_id").collect()] == rules.ISSUES
    (tmp_path / "label_mapping.json").write_text(json.dumps({"id2label": {"0": "x", "1": "y"}}, indent=2))
    known = readers.read_label_mapping(spark, str(tmp_path))
    assert [(r.label_id, r.label) for r in known.orderBy("label_id").collect()] == [(0, "x"), (1, "y")]
    writers.write_label_mapping(spark, rules.SENTIMENTS, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().label2id.neutral == 1


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clean"))
    writers.write_table(views.clean_reviews(spark, SF), path)
    return views.spread(readers.read_table(spark, path), "review_id")


def test_insight_job(spark, clean, tmp_path):
    ranked = insight.insight_job(clean, str(tmp_path), top_n=3, k=4, sentiment="all")
    assert [r.priority_rank for r in ranked.orderBy("priority_rank").collect()] == list(range(1, ranked.count() + 1))
    assert ranked.agg(F.sum("cluster_size")).first()[0] == clean.count()
    scores = [r.priority_score for r in ranked.collect()]
    assert all(0 <= s <= 100 for s in scores)
    lines = [r.value for r in spark.read.text(str(tmp_path / "insight_report")).collect()]
    assert lines[0] == "# Product Manager Insight Report"
    assert sum(x.startswith("### Priority") for x in lines) == min(3, ranked.count())
    with pytest.raises(ValueError):
        insight.reviews_to_cluster(clean, "no such sentiment")


def test_training_and_saved_model(spark, clean, tmp_path):
    trained = training.train_baseline_sentiment(clean)
    assert trained.validation.count() == 0
    assert trained.metrics().first().rows == trained.predictions.count() > 0
    path = str(tmp_path / "model")
    trained.model.write().overwrite().save(path)
    rows = clean.select("review_id", "review_text")
    before = training.score_sentiment(rows, trained.model)
    after = training.baseline_feedback(rows, PipelineModel.load(path))
    a = {r.review_id: r.sentiment_probabilities for r in before.collect()}
    b = {r.review_id: r.sentiment_probabilities for r in after.collect()}
    assert a == b
    assert all(abs(sum(p.values()) - 1) < 1e-9 for p in a.values())


def test_labelling_loop(spark, clean, tmp_path):
    out = str(tmp_path)
    labeled = annotation.distribution_job(clean, out)
    shares = spark.read.option("header", True).csv(f"{out}/issue_distribution")
    assert shares.agg(F.sum(F.col("count").cast("int"))).first()[0] == labeled.count() == clean.count()
    flagged = annotation.annotation_job(clean, out, total=50)
    assert flagged.count() == 50
    predictions = views.predictions(spark, SF)
    annotation.error_review_job(predictions, "review_id", out, max_rows=5)
    queue = readers.read_reviews(spark, f"{out}/error_review_candidates")
    assert queue.count() == 5 and "review_decision" in queue.columns


def test_issue_classifier_learns(spark):
    words = {"battery": "charger empties", "screen": "glass pixels", "network": "signal lost"}
    rows = [(i, f"{words[x]} again item{i % 7}", x) for i, x in enumerate(list(words) * 40)]
    df = spark.createDataFrame(rows, "review_id BIGINT, review_text STRING, manual_issue_label STRING")
    trained = training.train_issue_classifier(df)
    assert trained.metrics().first().accuracy == 1.0
    assert trained.validation_metrics().first().accuracy == 1.0
    scored = training.score_issues(df.select("review_id", "review_text"), trained.model)
    assert scored.join(df, "review_id").filter("predicted_issue_label <> manual_issue_label").count() == 0


def test_plugins(spark):
    # Defined here so that they travel to the workers by value.
    def fixed_logits():
        return lambda texts: np.array([[len(t), 1.0, 2.0] for t in texts], dtype=np.float64)

    def letter_counts():
        return lambda texts: np.array([[t.count("a"), t.count("b"), 1.0] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([(1, "a"), (2, "aabbb")], "review_id INT, review_text STRING")
    scored = scoring.score_with_plugin(df, fixed_logits, 3, "p").orderBy("review_id").collect()
    assert np.argmax(scored[0].p) == 2 and np.argmax(scored[1].p) == 0
    vectors = insight.embed_with_plugin(df, letter_counts).orderBy("review_id").collect()
    assert np.linalg.norm(vectors[1].embedding) == pytest.approx(1.0)


def test_stateless_operators_accept_a_stream(spark, tmp_path):
    rows = views.reviews(spark, SF).select("ordinal", "rating", "review_text")
    gap = F.when(F.col("ordinal") == 1, "<b> </b>").when(F.col("ordinal") != 2, F.col("review_text"))
    rows = rows.withColumn("review_text", gap)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streaming.start_scoring(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    query = streaming.start_rejects(stream, str(tmp_path / "rejects"), str(tmp_path / "state2"))
    assert query.awaitTermination(120)
    gone = spark.read.parquet(str(tmp_path / "rejects"))
    assert sorted(r.ordinal for r in gone.collect()) == [1, 2]
    assert spark.read.parquet(str(tmp_path / "out")).count() + 2 == rows.count()
    written = spark.read.parquet(str(tmp_path / "out"))
    batch = streaming.scored_reviews(rows)
    columns = ["ordinal", "issue_label", "sentiment_label", "primary_issue_label", "issue_mode"]
    assert sorted(written.select(*columns).collect()) == sorted(batch.select(*columns).collect())


def test_saved_training_and_unified_scoring(spark, clean, tmp_path):
    sentiment = training.train_baseline_sentiment(clean)
    training.save(sentiment, str(tmp_path), title="Baseline Sentiment Classification Report")
    report = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert report[0] == "Baseline Sentiment Classification Report" and report[1] == "=" * len(report[0])
    assert report[3].startswith("Accuracy: 0.") and report[5].split() == ["precision", "recall", "f1-score", "support"]
    assert spark.read.parquet(str(tmp_path / "test_predictions")).count() == spark.read.json(str(tmp_path / "metrics")).first().rows
    labeled = views.annotated(spark, SF).withColumn("manual_issue_label", F.col("rule_issue_label"))
    issue = training.train_issue_classifier(labeled)
    rows = clean.select("review_id", "review_text")
    scored = training.score_feedback(rows, sentiment.model, issue.model, top_k=2)
    assert scored.count() == rows.count()
    row = scored.first()
    assert len(row.ranked_issue_predictions) == 2 and row.primary_issue_label in rules.ISSUES
    assert row.sentiment_label in rules.SENTIMENTS
    holes = rows.withColumn("review_text", F.when(F.col("review_id") % 5 > 0, F.col("review_text")).otherwise(" \u2003"))
    issue.model.write().overwrite().save(str(tmp_path / "issue_model"))
    done = training.feedback_job(holes, str(tmp_path / "model"), str(tmp_path / "issue_model"), str(tmp_path), top_k=2)
    gone = spark.read.parquet(str(tmp_path / "feedback_rejects"))
    assert done.count() + gone.count() == rows.count() and {r.review_id % 5 for r in gone.collect()} == {0}
