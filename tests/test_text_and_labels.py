import math
import random
import re

import pytest
from pyspark.sql import functions as F

from plaintide import rules
from plaintide.functions import labels, text
from plaintide.operators import annotate, cleaning
from plaintide.operators.ids import dense_id, most_frequent, top_ids, top_rows
from plaintide.schema import id_label, label_id, reorder, require_columns, select_existing, with_defaults


def evaluate(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r.o for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "raw, expected",
    [
        (None, ""),
        ("a<b\nc>d", "a<b c>d"),
        ("a<b\rc>d", "a d"),
        ("a<b c>d", "a d"),
        ("x  y", "x y"),
        ("x\x1cy z", "x y z"),
        ("see http://a.b/c?d=1 and www.e.f now", "see and now"),
        ("http://a b", "b"),
        (" \t two\n\nlines \x85", "two lines"),
        ("<p>one</p><br/>two", "one two"),
        ("　wide　　gap", "wide gap"),
        ("a  b", "a b"),
    ],
)
def test_clean_text(spark, raw, expected):
    assert evaluate(spark, [raw], text.clean_text) == [expected]


def test_clip(spark):
    values = [None, "  a\r\nb ", "x" * 10, "abc  def"]
    assert evaluate(spark, values, lambda c: text.clip(c, 5)) == ["", "a  b", "xxxxx...", "abc..."]


def test_rating_sentiment(spark):
    values = [None, float("nan"), 1.0, 2.0, 2.5, 3.0, 3.5, 5.0]
    expected = ["positive", "positive", "negative", "negative", "positive", "neutral", "positive", "positive"]
    assert evaluate(spark, values, labels.rating_sentiment, "double") == expected
    textual = evaluate(spark, ["abc", "2", None, "1d"], lambda c: labels.rating_sentiment(c, numeric=False))
    assert textual == [None, "negative", "positive", None]


def test_to_numeric_and_boolean(spark):
    cells = ["1.5", "abc", None, "NaN", "1e2", "7f", " 3 "]
    assert evaluate(spark, cells, lambda c: text.to_numeric(c, 0.5)) == [1.5, 0.5, 0.5, 0.5, 100.0, 0.5, 3.0]
    assert evaluate(spark, ["TRUE", "yes", "1", "0", None], text.parse_boolean) == [True, True, True, False, False]


def test_fixed_rounds_like_c(spark):
    values = [0.125, 0.375, 0.155, 0.145, 0.005, 86.14, 100.0, -0.125, -0.001, 0.0, 2.675, 0.99999, 12.5]
    values += [i / 200 for i in range(0, 400, 7)]
    for digits in (2, 4):
        got = evaluate(spark, values, lambda c: text.fixed(c, digits), "double")
        want = [f"{v:.{digits}f}" for v in values]
        assert got == ["0." + "0" * digits if float(w) == 0 else w for w in want]


def test_tokens_and_bigrams(spark):
    words = evaluate(spark, ["A b cc DD-ee_1 été"], text.tokens)
    assert words == [["cc", "dd", "ee_1", "été"]]
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w ARRAY<STRING>")
    assert [r[0] for r in rows.select(text.bigrams(F.col("w"))).collect()] == [["a b", "b c"], [], []]


# Example reviews with (first match, (rule label, score), (second opinion, score)).
GOLDEN = [
    ("The phone battery dies very quickly and the charging port is loose.", "battery", ("battery", 3), ("battery", 3)),
    ("This phone is very slow and freezes all the time.", "performance", ("performance", 3), ("performance", 3)),
    ("Great phone for the price. It works well and arrived quickly.", "shipping", ("shipping", 1), ("shipping", 1)),
    ("The screen cracked after one day and the touch display stopped working.", "screen", ("screen", 5), ("screen", 5)),
    ("The phone could not connect to the carrier network and the SIM card was not recognized.", "network", ("network", 2), ("network", 2)),
    ("The phone is locked and cannot be used with my SIM card.", "condition", ("network", 1), ("network", 1)),
    ("Customer service refused my refund request and never replied.", "condition", ("service", 3), ("service", 3)),
    ("The phone freezes all the time and the battery dies quickly.", "battery", ("battery", 2), ("performance", 2)),
    ("Nothing to say", "other", ("other", 0), ("other", 0)),
]


def test_keyword_labels(spark):
    rows = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "review_id INT, review_text STRING")
    rows = annotate.with_first_match(rows)
    rows = annotate.with_keyword_label(rows, "rule", "rule_score")
    rows = annotate.with_keyword_label(rows, "guess", "guess_score", rules.GUESS_KEYWORDS)
    got = [
        (r.review_text, r.issue_label, (r.rule, r.rule_score), (r.guess, r.guess_score))
        for r in rows.orderBy("review_id").collect()
    ]
    assert got == GOLDEN


def test_review_flags(spark):
    rows = spark.createDataFrame(
        [
            (1, "battery slow slow freezes", "positive", "battery"),
            (2, "nothing here", "negative", "other"),
            (3, "camera photo", "neutral", "Screen "),
            (4, "zzz", "neutral", "strange"),
            (5, "camera photo", "negative", "camera"),
        ],
        "review_id INT, review_text STRING, sentiment_label STRING, rule_issue_label STRING",
    )
    got = {r.review_id: (r.manual_issue_label, r.needs_review, r.review_reason) for r in annotate.flag_for_review(rows).collect()}
    assert got == {
        1: ("battery", "yes", rules.REASON_POSITIVE),
        2: ("other", "yes", rules.REASON_NEGATIVE),
        3: ("screen", "yes", rules.REASON_CONFLICT),
        4: ("other", "yes", rules.REASON_OTHER),
        5: ("camera", "no", ""),
    }


def test_corrections_replace_labels(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "review_id INT, manual_issue_label STRING")
    fixes = spark.createDataFrame([(2, "c"), (3, "d")], "review_id INT, corrected_label STRING")
    got = annotate.apply_corrections(rows, fixes).orderBy("review_id").collect()
    assert [r.manual_issue_label for r in got] == ["a", "c"]


def test_the_last_correction_holds(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "review_id INT, manual_issue_label STRING")
    fixes = spark.createDataFrame([(1, "x", 1), (1, "c", 2), (2, None, 3), (2, "z", 1)], "review_id INT, corrected_label STRING, at INT")
    got = annotate.apply_corrections(rows, fixes, order="at").orderBy("review_id").collect()
    assert [r.manual_issue_label for r in got] == ["c", "z"]
    assert annotate.apply_corrections(rows, fixes).count() == 2


def test_clean_reviews_keeps_the_first_copy(spark):
    raw = spark.createDataFrame(
        [
            (900000000000, "p", "b", 1.0, 1.0, "same  text", 0.0),
            (5, "p", "b", 1.0, 3.0, "same text", 0.0),
            (7, "p", "b", 1.0, None, "<b>other</b> text", 0.0),
            (1, "p", "b", 1.0, 5.0, "12345", 0.0),
            (3, "p", "b", 1.0, float("nan"), "123456", 0.0),
            (9, "p", "b", 1.0, 5.0, None, 0.0),
        ],
        "ordinal BIGINT, `Product Name` STRING, `Brand Name` STRING, Price DOUBLE, Rating DOUBLE, Reviews STRING, `Review Votes` DOUBLE",
    )
    got = [(r.review_id, r.review_text, r.sentiment_label) for r in cleaning.clean_reviews(raw).orderBy("review_id").collect()]
    assert got == [(1, "123456", "positive"), (2, "same text", "neutral"), (3, "other text", "positive")]


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_dense_id_has_no_gaps(spark, partitions):
    values = [(i * 2_654_435_761) % (1 << 62) for i in range(500)] + list(range(300)) + [-5, -(1 << 50)]
    df = spark.createDataFrame([(v,) for v in values], "o BIGINT").repartition(partitions)
    got = dense_id(df, "o", "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, len(values) + 1))
    assert [r.o for r in got] == sorted(values)


def test_dense_id_deals_rows(spark):
    """A table of 2**15 rows in a row is no single task, as whole rows move by bucket."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        got = dense_id(spark.range(1 << 15).withColumnRenamed("id", "o"), "o", "n")
        parts = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("n") - 1 - F.col("o"))).alias("off"))
        rows = parts.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.rows for r in rows) == 1 << 15 and max(r.off for r in rows) == 0
    assert max(r.rows for r in rows) <= 1 << 14


def test_top_rows_merges_tasks(spark):
    df = spark.range(1000).repartition(17).withColumn("k", F.col("id") % 10)
    got = top_ids(df, 7, F.desc("k"), F.asc("id"), fan_in=4)
    assert [r.id for r in got.collect()] == [9, 19, 29, 39, 49, 59, 69]
    best = top_rows(df.withColumn("text", F.lit("t")), 7, F.desc("k"), F.asc("id"), keys=["k"], ident="id")
    assert sorted(r.id for r in best.collect()) == [9, 19, 29, 39, 49, 59, 69] and "text" in best.columns


@pytest.mark.parametrize("n", [0, 1, 5, 40, 199, 200, 500, None])
def test_most_frequent(spark, n):
    rows = [(f"{'ab'[i % 2]}{i % 7}{i:03d}", 1 + (i % 20 == 0) * i) for i in range(200)]
    df = spark.createDataFrame(rows, "term STRING, total INT").repartition(13)
    got = most_frequent(df, n, "total", "term", prefix=2)
    assert sorted(map(tuple, got.collect())) == sorted(sorted(rows, key=lambda r: (-r[1], r[0]))[:n])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan


def test_building_operators_starts_no_job(spark):
    from __spark_entry__ import queries

    sc = spark.sparkContext
    sc.setJobGroup("build", "build")
    for name in ("distance_to_center", "nearest_center", "clean_reviews", "dedup_first", "issue_distribution", "error_review_queue"):
        if name in queries():
            queries()[name](spark, "/root/testdata/sf0.001")
    # reading a Parquet footer is the only job there may be
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("build")]
    assert all(sc.statusTracker().getStageInfo(s).numTasks == 1 for j in jobs if j for s in j.stageIds if sc.statusTracker().getStageInfo(s))
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, 2)], "a INT, b INT")
    with pytest.raises(ValueError, match="c"):
        require_columns(df, ["a", "c"])
    assert select_existing(df, ["b", "x"]).columns == ["b"]
    assert reorder(df, ["b", "x"]).columns == ["b", "a"]
    assert with_defaults(df, {"a": F.lit(9), "z": F.lit(0)}).first().asDict() == {"a": 1, "b": 2, "z": 0}
    ids = spark.createDataFrame([("other",), ("battery",), ("?",)], "l STRING").select(label_id(F.col("l"), rules.ISSUES).alias("i"))
    assert [r.i for r in ids.collect()] == [10, 0, None]
    assert [r[0] for r in ids.select(id_label(F.col("i"), rules.ISSUES)).collect()] == ["other", "battery", None]


def test_sentiment_filter_and_na(spark):
    df = spark.createDataFrame([("negative", "N/A"), ("neutral", "null"), ("neutral", "x")], "sentiment_label STRING, t STRING")
    assert cleaning.by_sentiment(df, "ALL").count() == 3
    assert cleaning.by_sentiment(df, "neutral").count() == 2
    assert [r.t for r in cleaning.normalize_na(df, ["t"]).collect()] == [None, None, "x"]


def test_nothing_is_nan_in_fixed_words():
    assert not any(isinstance(w, float) and math.isnan(w) for w in rules.NA_WORDS)
    assert len(rules.THEME_RULES) == 12 and len(rules.ISSUES) == 11


RULES = {
    "a": ["os", "wi-fi", "not worth it", "Éclair", "!!"],
    "b": ["those", "wi fi", "worth", "not worth", "a b c"],
    "c": [],
    "d": ["wifi", "x_1", "a b", "it"],
}


def _whole_words(value, keywords):
    line = " " + " ".join(re.findall(r"\w+", (value or "").lower())) + " "
    return sum(f" {p} " in line for p in (" ".join(re.findall(r"\w+", k.lower())) for k in keywords) if p)


def test_keywords_as_whole_words(spark):
    rng = random.Random(3)
    pieces = ["os", "those", "wi", "fi", "-", " ", " ", "not", "worth", "it", "éclair", "ÉCLAIR", "a", "b", "c", "x_1", "!!", "\n", "wifi", "."]
    texts = [None, "", " ", "!!", "those", "OS", "os.", "not worth", "a b", "a b c"] + ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, review_text STRING")
    hit = annotate.with_keyword_hits(rows, RULES, {k: f"n_{k}" for k in RULES}, mode="word")
    first = annotate.with_first_match(hit, mode="word", rules_table=RULES)
    best = annotate.with_keyword_label(first, "best", "score", RULES, mode="word")
    for r in best.collect():
        want = {k: _whole_words(r.review_text, words) for k, words in RULES.items()}
        assert {k: r[f"n_{k}"] for k in RULES} == want, r.review_text
        assert r.issue_label == next((k for k, n in want.items() if n), "other")
        top = max(want.values())
        assert (r.best, r.score) == (next(k for k in want if want[k] == top) if top else "other", top)


def test_unknown_mode(spark):
    rows = spark.createDataFrame([("x",)], "review_text STRING")
    with pytest.raises(ValueError):
        annotate.with_first_match(rows, mode="words")
