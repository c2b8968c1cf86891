import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plaintide import rules
from plaintide.operators import clusters, priority, themes
from plaintide.plans import reports


def unit(vector):
    norm = math.sqrt(sum(x * x for x in vector))
    return [x / norm for x in vector]


@pytest.fixture(scope="module")
def points(spark):
    dice = random.Random(3)
    rows = [(i, i % 3, unit([dice.gauss(j == i % 3, 0.4) for j in range(5)])) for i in range(120)]
    return rows, spark.createDataFrame(rows, "review_id BIGINT, cluster_id INT, embedding ARRAY<DOUBLE>")


def test_centers_distance_nearest(spark, points):
    rows, df = points
    centers = {c: [sum(r[2][j] for r in rows if r[1] == c) / 40 for j in range(5)] for c in range(3)}
    table = clusters.cluster_centers(df)
    for r in table.collect():
        assert r.center == pytest.approx(centers[r.cluster_id])
    for r in clusters.with_distance(df, table).collect():
        assert r.distance_to_cluster_center == pytest.approx(math.dist(r.embedding, centers[r.cluster_id]))
    for r in clusters.nearest_center(df.drop("cluster_id"), table).collect():
        best = min(centers, key=lambda c: math.dist(r.embedding, centers[c]))
        assert r.cluster_id == best


def test_silhouette(spark, points):
    rows, df = points

    def cosine(a, b):
        return 1 - sum(x * y for x, y in zip(a, b))

    scores = []
    for i, c, v in rows:
        mean = {
            k: sum(cosine(v, w) for j, d, w in rows if d == k and j != i) / (40 - (k == c)) for k in range(3)
        }
        other = min(mean[k] for k in mean if k != c)
        scores.append((other - mean[c]) / max(other, mean[c]))
    assert clusters.silhouette(df) == pytest.approx(sum(scores) / len(scores))
    assert clusters.silhouette(df.withColumn("cluster_id", F.lit(1))) is None


TEXTS = [
    (1, 0, "Battery drains fast. Battery!"), (2, 0, "the battery drains"), (140_000, 0, "cable battery"),
    (3, 1, "blurry lens, battery drains"), (5, 1, "lens lens blurry"), (280_000, 1, "cable loose"), (4, 1, "a b"),
]


def brute_terms(across):
    counts = Counter()
    for cluster in (0, 1):
        lists = [
            [w for w in re.findall(r"\w\w+", t.lower()) if w not in rules.ENGLISH_STOP_WORDS]
            for _, c, t in sorted(TEXTS) if c == cluster
        ]
        if across:
            lists = [[w for words in lists for w in words]]
        for words in lists:
            counts.update((cluster, w) for w in words)
            counts.update((cluster, f"{a} {b}") for a, b in zip(words, words[1:]))
    return counts


@pytest.mark.parametrize("across", [False, True])
def test_term_counts(spark, across):
    df = spark.createDataFrame(TEXTS, "review_id BIGINT, cluster_id INT, review_text STRING").repartition(3)
    got = clusters.cluster_term_counts(df, across_reviews=across).collect()
    assert {(r.cluster_id, r.term): r.tf for r in got} == dict(brute_terms(across))


def test_keywords(spark):
    df = spark.createDataFrame(TEXTS, "review_id BIGINT, cluster_id INT, review_text STRING")
    got = {r.cluster_id: r.top_keywords for r in clusters.cluster_keywords(df, n=3).collect()}
    assert got == {0: "battery, battery drains, drains", 1: "battery, battery drains, cable"}
    few = clusters.cluster_keyword_scores(df, max_features=1).collect()
    assert {r.term for r in few} == {"battery"}


def test_profile_and_representatives(spark):
    rows = [
        (1, "a", "negative", "screen", 0.5, 7, 0.3), (2, "b", "neutral", "battery", 0.7, 7, 0.1),
        (3, "c", "neutral", "screen", None, 7, 0.1), (4, "d", "negative", "battery", 0.9, 7, 0.2),
        (5, "e", "negative", "other", 0.4, 8, 0.0),
    ]
    df = spark.createDataFrame(
        rows,
        "review_id INT, review_text STRING, sentiment_label STRING, predicted_issue_label STRING, "
        "predicted_issue_confidence DOUBLE, cluster_id INT, distance_to_cluster_center DOUBLE",
    )
    got = {r.cluster_id: r for r in clusters.cluster_summary(df).collect()}
    seven = got[7]
    assert (seven.cluster_size, seven.major_sentiment, seven.major_sentiment_count) == (4, "negative", 2)
    assert (seven.major_issue, seven.major_issue_count, seven.negative_ratio) == ("battery", 2, 0.5)
    assert seven.avg_issue_confidence == pytest.approx(0.7)
    assert [seven[f"representative_review_{i}"] for i in (1, 2, 3)] == ["b", "c", "d"]
    assert [got[8][f"representative_review_{i}"] for i in (1, 2, 3)] == ["e", "", ""]


CLUSTERS = "cluster_id INT, cluster_theme STRING, cluster_size BIGINT, major_issue STRING, major_issue_count BIGINT, avg_issue_confidence DOUBLE, negative_ratio DOUBLE, top_keywords STRING"


def test_priority_example(spark):
    df = spark.createDataFrame(
        [(1, "A", 100, "x", 50, 0.9, 1.0, ""), (2, "B", 60, "x", 45, 0.6, 1.0, ""), (3, "C", 20, "x", 4, 0.3, 1.0, "")], CLUSTERS
    )
    got = priority.priority_scores(df).orderBy("priority_rank").collect()
    assert [(r.cluster_theme, r.priority_score) for r in got] == [("A", 86.14), ("B", 67.5), ("C", 12.5)]
    assert {r.negative_ratio_score for r in got} == {1.0}


def test_priority_edges(spark):
    df = spark.createDataFrame([(2, "A", "0", "x", "k"), (1, "B", "oops", "x", "k")], "cluster_id INT, cluster_theme STRING, cluster_size STRING, major_issue STRING, top_keywords STRING")
    got = priority.priority_scores(df).orderBy("priority_rank").collect()
    assert [r.cluster_id for r in got] == [1, 2]
    assert [r.priority_score for r in got] == [97.5, 97.5]
    assert priority.priority_scores(df.limit(0)).count() == 0
    constant = priority.minmax_normalize(df.withColumn("v", F.lit(3)), "v", "s")
    assert {r.s for r in constant.collect()} == {1.0}


def test_themes(spark):
    rows = [
        (1, 5, "zzz", "none", "", None, ""), (2, 5, "otterbox cover", "other", "", "", ""),
        (3, 5, "", "Battery", "", "", ""), (4, 5, "responsive", "x", "", "", ""),
    ]
    df = spark.createDataFrame(
        rows, "cluster_id INT, cluster_size INT, top_keywords STRING, major_issue STRING, "
        "representative_review_1 STRING, representative_review_2 STRING, representative_review_3 STRING",
    )
    got = {r.cluster_id: (r.cluster_theme, r.theme_confidence_score) for r in themes.label_themes(df).collect()}
    assert got[1] == (rules.DEFAULT_THEME, 0)
    assert got[2] == ("Accessory or case compatibility issues", 2)
    assert got[3] == ("Battery and charging complaints", 4)
    assert got[4] == ("Screen and display defects", 1)


def test_actions(spark):
    rows = [("Charging", "x", "k"), ("General", "x", "USB hub"), ("General", "Sim", ""), ("General", "x", "y"), ("Smartwatch", "", "")]
    df = spark.createDataFrame(rows, "t STRING, i STRING, k STRING")
    got = [r[0] for r in df.select(themes.recommended_action(F.col("t"), F.col("i"), F.col("k"))).collect()]
    assert got == [
        rules.THEME_ACTIONS[0][1], rules.FALLBACK_ACTIONS[0][1], rules.FALLBACK_ACTIONS[1][1],
        rules.DEFAULT_ACTION, rules.THEME_ACTIONS[9][1],
    ]


def lines_of(df):
    return [r.line for r in df.orderBy(*reports.KEY).collect()]


def test_reports_read_in_order(spark):
    df = spark.createDataFrame(
        [(4, "Theme B", 60, "x", 45, 0.61238, 0.125, "k1, k2"), (9, "Theme A", 100, "x", 50, 0.9, 1.0, "k3")], CLUSTERS
    ).withColumn("representative_review_1", F.lit("first\nline"))
    report = lines_of(reports.clustering_report(df, top_n=1))
    assert report[0] == "# Review Clustering and Topic Discovery Report"
    assert "- Total clustered reviews: **160**" in report
    assert "| Theme A | 1 |" in report and "| Theme B | 1 |" in report
    assert "### Cluster 9: Theme A" in report and "### Cluster 4: Theme B" not in report
    assert report[report.index("Representative reviews:") + 2] == "1. first line"
    assert [x for x in report if x.startswith("## ")] == [
        "## 1. Overview", "## 2. Cluster Theme Distribution", "## 3. Top Clusters by Size",
        "## 4. Detailed Cluster Summaries", "## 5. Interpretation",
    ]
    insight = lines_of(reports.insight_report(priority.priority_scores(df)))
    assert "- Negative ratio: **0.12**" in insight
    assert "- Top priority themes included in this report: **2**" in insight
    assert [x for x in insight if x.startswith("### ")] == ["### Priority 1: Theme A", "### Priority 2: Theme B"]
    assert insight[-2] == reports.LIMITS[-1] and "Themes to act on first: Theme A, Theme B." in insight


def test_listings(spark):
    df = spark.createDataFrame([(1, "T", 5, "x", 1, 0.5, 1.0, "k"), (2, "U", 9, "x", 1, 0.5, 1.0, "k")], CLUSTERS).withColumns(
        {"representative_review_1": F.lit(" a "), "representative_review_2": F.lit(" "), "representative_review_3": F.lit(None).cast("string")}
    )
    got = priority.cluster_listing(df, 1).collect()
    assert [(r.cluster_id, r.representative_reviews) for r in got] == [(2, ["a"])]
    ranked = priority.priority_listing(priority.priority_scores(df), 1).first()
    assert ranked.cluster_id == 2 and ranked.representative_reviews == ["a"]
