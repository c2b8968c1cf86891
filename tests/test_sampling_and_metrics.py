import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from plaintide import rules
from plaintide.operators import metrics, sampling, scoring
from plaintide.schema import label_id


def order(ident, seed=42):
    return hashlib.md5(f"{seed}:{ident}".encode()).hexdigest()


def make_rows(n=1500):
    """One issue holds a third of all rows, some are rare."""
    dice = random.Random(7)
    issues = ["battery"] * 10 + ["screen"] * 8 + ["network"] * 6 + ["price"] * 5 + ["other"]
    return [(i * 3 + 1, dice.choice(rules.SENTIMENTS), dice.choice(issues)) for i in range(n)] + [(9_000_001, "neutral", "camera")]


SCHEMA = "review_id BIGINT, sentiment_label STRING, rule_issue_label STRING"


def brute_sample(rows, target):
    """Quota per issue, then the rest, then a trim, all in hash order."""
    if len(rows) <= target:
        return {r[0] for r in rows}
    quota = max(1, target // len({r[2] for r in rows}))
    taken = []
    for issue in {r[2] for r in rows}:
        taken += sorted((r for r in rows if r[2] == issue), key=lambda r: order(r[0]))[:quota]
    if len(taken) < target:
        rest = [r for r in rows if r not in taken]
        taken += sorted(rest, key=lambda r: order(r[0]))[: target - len(taken)]
    return {r[0] for r in sorted(taken, key=lambda r: order(r[0]))[:target]}


@pytest.mark.parametrize("partitions", [1, 4, 13])
@pytest.mark.parametrize("target", [3, 100, 5000])
def test_stratified_sample(spark, partitions, target):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = {r.review_id for r in sampling.stratified_sample(df, target).collect()}
    assert got == brute_sample(rows, target)


@pytest.mark.parametrize("partitions", [1, 13])
def test_sample_and_cap(spark, partitions):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    want = sorted((r[0] for r in rows), key=order)[:77]
    assert {r.review_id for r in sampling.sample_n(df, 77).collect()} == set(want)
    capped = sampling.cap_per_class(df, 50, "sentiment_label", rules.SENTIMENTS).collect()
    assert Counter(r.sentiment_label for r in capped) == {s: 50 for s in rules.SENTIMENTS}
    for s in rules.SENTIMENTS:
        first = sorted((r[0] for r in rows if r[1] == s), key=order)[:50]
        assert {r.review_id for r in capped if r.sentiment_label == s} == set(first)


@pytest.mark.parametrize("total", [60, 900, 10_000])
def test_annotation_sample(spark, total):
    words = {"battery": "charger", "screen": "pixel", "network": "wifi", "price": "cheap", "other": "zzz", "camera": "blurry"}
    # Few negatives, so that the other sentiments have to fill up.
    rows = [r for r in make_rows() if r[1] != "negative" or r[0] % 5 == 0]
    df = spark.createDataFrame(
        [(r[0], f"a {words[r[2]]} b", 1.0, r[1], None) for r in rows],
        "review_id BIGINT, review_text STRING, rating DOUBLE, sentiment_label STRING, issue_label STRING",
    )
    targets = sampling.sentiment_targets(total)
    want = set()
    for s in rules.SENTIMENTS:
        want |= brute_sample([r for r in rows if r[1] == s], targets[s])
    rest = sorted((r[0] for r in rows if r[0] not in want), key=order)
    want |= set(rest[: total - len(want)])
    got = sampling.annotation_sample(df, total).orderBy("annotation_id").collect()
    assert [r.annotation_id for r in got] == list(range(1, len(got) + 1))
    assert len(got) == min(total, len(rows))
    assert [r.review_id for r in got] == sorted(want, key=order)
    assert {r.review_id: r.rule_issue_label for r in got} == {r[0]: r[2] for r in rows if r[0] in want}


def largest_remainder(counts, draws):
    total = sum(counts.values())
    exact = {k: n / total * draws for k, n in counts.items()}
    result = {k: math.floor(v) for k, v in exact.items()}
    order_ = sorted(counts, key=lambda k: (-(exact[k] - result[k]), k))
    for k in order_[: int(draws - sum(result.values()))]:
        result[k] += 1
    return result


@pytest.fixture(params=[1, 2, sampling.BUCKET_DIGITS])
def bucket_digits(request, monkeypatch):
    """Few buckets: cuts fall inside them."""
    monkeypatch.setattr(sampling, "BUCKET_DIGITS", request.param)
    monkeypatch.setattr(sampling, "BUCKETS", 16**request.param)


def test_draws_inside_large_buckets(spark, bucket_digits):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {r.review_id for r in sampling.stratified_sample(df, 100).collect()} == brute_sample(rows, 100)
    want = sorted((r[0] for r in rows), key=order)[:333]
    assert {r.review_id for r in sampling.sample_n(df, 333).collect()} == set(want)


@pytest.mark.parametrize("test, validation", [(0.2, 0.15), (0.2, 0.0), (0.2, 0.002)])
def test_stratified_split(spark, bucket_digits, test, validation):
    partitions, rows = 7, make_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = sampling.stratified_split(df, "rule_issue_label", rules.ISSUES, test, validation).collect()
    assert len(got) == len(rows)
    counts = Counter(r[2] for r in rows)
    kept = largest_remainder(counts, len(rows) - math.ceil(test * len(rows)))
    train = largest_remainder(kept, sum(kept.values()) - math.ceil(validation * sum(kept.values())))
    parts = {(r.rule_issue_label, r.review_id): r.split for r in got}
    for issue in counts:
        ids = sorted((r[0] for r in rows if r[2] == issue), key=order)
        n_test, n_validation = counts[issue] - kept[issue], kept[issue] - train[issue]
        want = ["test"] * n_test + ["validation"] * n_validation + ["train"] * train[issue]
        assert [parts[issue, i] for i in ids] == want


def test_rows_stay_where_they_are(spark):
    """Quotas and weights, a row per class, travel to the rows: a class is never brought together."""
    df = spark.createDataFrame(make_rows(), SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        weighed = metrics.with_class_weights(df, "rule_issue_label", rules.ISSUES)
        assert "SortMergeJoin" not in weighed._jdf.queryExecution().executedPlan().toString()
        plan = sampling.stratified_split(df, "rule_issue_label", rules.ISSUES)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin [rule_issue_label") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert weighed.count() == df.filter(F.col("rule_issue_label").isin(rules.ISSUES)).count()
    assert weighed.columns == ["rule_issue_label", "review_id", "sentiment_label", "class_weight"]


def test_metrics_agree_with_spark(spark):
    dice = random.Random(1)
    labels = rules.ISSUES[:6]
    rows = [(i, dice.choice(labels[:5]), dice.choice(labels[1:])) for i in range(400)]
    df = spark.createDataFrame(rows, "id INT, true_label STRING, pred_label STRING")
    numeric = df.select(
        label_id(F.col("true_label"), labels).cast("double").alias("label"),
        label_id(F.col("pred_label"), labels).cast("double").alias("prediction"),
    )

    def spark_value(name, **kw):
        return MulticlassClassificationEvaluator(metricName=name, **kw).evaluate(numeric)

    row = metrics.classifier_metrics(df, labels).first()
    assert row.accuracy == pytest.approx(spark_value("accuracy"))
    assert row.weighted_f1 == pytest.approx(spark_value("f1"))
    report = {r.label: r for r in metrics.classification_report(df, labels).collect()}
    for i, label in enumerate(labels[:5]):
        assert report[label].recall == pytest.approx(spark_value("recallByLabel", metricLabel=float(i)))
    assert row.macro_f1 == pytest.approx(sum(report[x].f1_score for x in labels) / len(labels))
    assert report["macro avg"].support == 400
    matrix = metrics.confusion_matrix(df, labels).orderBy("label_id").collect()
    assert [r.label for r in matrix] == [f"true_{x}" for x in labels]
    assert sum(matrix[0][f"pred_{x}"] for x in labels) == sum(r[1] == labels[0] for r in rows)
    assert sum(matrix[5][f"pred_{x}"] for x in labels) == 0


def test_macro_f1_ignores_labels_that_never_occur(spark):
    df = spark.createDataFrame([("battery", "battery"), ("screen", "battery")], "true_label STRING, pred_label STRING")
    row = metrics.classifier_metrics(df, rules.ISSUES).first()
    assert row.macro_f1 == pytest.approx((2 / 3 + 0) / 2)
    assert metrics.classification_report(df, rules.ISSUES).filter("label = 'macro avg'").first().f1_score == pytest.approx(2 / 3 / 11)


def test_class_weights_and_rare(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2 + [("c",)], "l STRING")
    weights = {r.l: r.class_weight for r in metrics.class_weights(df, "l", ["a", "b", "c"]).collect()}
    assert weights == {"a": 0.5, "b": 1.5, "c": 3.0}
    assert [r.l for r in metrics.rare_labels(df, "l").collect()] == ["c"]


def probability_rows(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i INT, p ARRAY<DOUBLE>")


def test_triage_modes(spark):
    rows = probability_rows(spark, [[0.85, 0.08, 0.07], [0.7, 0.09, 0.05], [0.85, 0.12, 0.03], [0.4, 0.4, 0.2]])
    got = scoring.triage(rows, "p", ["x", "y", "z"]).orderBy("i").collect()
    assert [r.issue_mode for r in got] == ["single-dominant", "single", "multi-candidate", "multi-candidate"]
    assert [c.label for c in got[3].ranked_issue_predictions] == ["x", "y", "z"]
    for r in got:
        assert r.ranked_issue_predictions[: len(r.candidate_issues)] == r.candidate_issues
    with pytest.raises(ValueError):
        scoring.triage(rows, "p", top_k=11)
    with pytest.raises(ValueError):
        scoring.triage(rows, "p", min_candidate=1.5)


def test_softmax(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (3.0, 1.0, 2.0), (1000.0, 0.0, -1000.0)], "a DOUBLE, b DOUBLE, c DOUBLE")
    got = [r.p for r in scoring.with_softmax(rows, [F.col(c) for c in "abc"], "p").collect()]
    for p in got:
        assert sum(p) == pytest.approx(1.0)
    assert sorted(got[0]) == sorted(got[1])
    assert got[2] == [1.0, 0.0, 0.0]


def test_blank_rows_are_rejected(spark):
    df = spark.createDataFrame([(1, " x "), (2, "  "), (3, None)], "review_id INT, review_text STRING")
    assert [r.review_text for r in scoring.not_blank(df).collect()] == ["x"]
    assert sorted(r.review_id for r in scoring.rejects(df).collect()) == [2, 3]


def test_error_queue_order_and_limit(spark):
    rows = [
        (i, f"t{i}", label, "other", str(label == "other"), conf, "a", 0.1, "b", 0.1, "c", 0.1)
        for i, (label, conf) in enumerate(
            [("battery", 0.9), ("shipping", 0.2), ("condition", 0.3), ("condition", 0.8), ("condition", 0.8), ("other", 0.5)]
        )
    ]
    columns = "id INT, review_text STRING, true_label STRING, pred_label STRING, correct STRING, confidence DOUBLE, " + ", ".join(
        f"top_{i}_label STRING, top_{i}_prob DOUBLE" for i in (1, 2, 3)
    )
    df = spark.createDataFrame(rows, columns)
    got = metrics.error_review_queue(df, "id", 4).orderBy("review_id_for_error_analysis").collect()
    assert [r.review_text for r in got] == ["t3", "t4", "t2", "t1"]
    counts = {r.label: r.error_count for r in metrics.error_counts(df).collect()}
    assert counts == {"condition": 3, "performance": 0, "shipping": 1, "service": 0}
