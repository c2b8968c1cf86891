"""Jobs that count only what can get in, and centres in any number."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaintide.operators import clusters, frequent
from plaintide.plans import assignment, keywords, training
from plaintide.session import written


def wordy(rng, n):
    return " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "battery"] + [f"w{int(rng.paretovariate(0.7))}" for _ in range(4)]) for _ in range(n))


@pytest.fixture(scope="module")
def reviews(spark):
    rng = random.Random(11)
    rows = [(i, wordy(rng, rng.randint(0, 40)), i % 5) for i in range(300)] + [(300, None, 1), (301, "", 2)]
    return written(spark.createDataFrame(rows, "review_id bigint, review_text string, cluster_id int"))


@pytest.mark.parametrize("n, bits", [(1, 6), (7, 6), (7, 12), (60, 8), (10**4, 10), (None, 8)])
def test_frequent_terms(spark, n, bits):
    rng = random.Random(bits)
    terms = [f"t{int(rng.paretovariate(0.8)) % 400}" for _ in range(4000)]
    rows = written(spark.createDataFrame([(t, i % 3) for i, t in enumerate(terms)], "term string, part int"))
    want = Counter(terms)
    allowed = {t: c for t, c in want.items() if not t.endswith("2")}
    _, best = frequent.frequent_terms(
        rows, lambda x: x.groupBy("term", "part").agg(F.count(F.lit(1)).alias("n")),
        lambda c: c.filter("term not like '%2'").groupBy("term").agg(F.sum("n").alias("total")), n, bits=bits,
    )
    got = {r.term: r.total for r in best.collect()}
    assert got == dict(sorted(allowed.items(), key=lambda x: (-x[1], x[0]))[:n])


def test_only_wanted_terms_are_counted(spark):
    """One frequent term and many rare ones: the counts hold few of these."""
    terms = ["often"] * 500 + [f"rare{i}" for i in range(3000)]
    rows = written(spark.createDataFrame([(t,) for t in terms], "term string"))
    counts, best = frequent.frequent_terms(rows, lambda x: x.groupBy("term").agg(F.count(F.lit(1)).alias("total")), lambda c: c, 1, bits=12)
    assert [tuple(r) for r in best.collect()] == [("often", 500)]
    assert counts.count() < 100


@pytest.mark.parametrize("options", [{}, {"across_reviews": False}, {"max_features": 9}, {"max_features": None, "min_df": 1}, {"max_features": 25, "bits": 6}])
def test_keywords_as_one_plan_and_as_a_job(reviews, options):
    plain = {k: v for k, v in options.items() if k != "bits"}
    want = clusters.cluster_keyword_scores(reviews, n=6, **plain)
    got = keywords.keyword_scores(reviews, n=6, **options)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("n", [5, 40, 5000, None])
def test_vocabulary_as_one_plan_and_as_a_job(reviews, n):
    docs = written(reviews.select("review_id", F.split(F.coalesce("review_text", F.lit("")), " ").alias("_terms")))
    want = training.tfidf_vocabulary(docs, max_features=n)
    got = training.counted_vocabulary(docs, max_features=n, bits=7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def vectors(spark, n, dims, seed, name="embedding", ident="vec_id"):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, dims)).round(2)
    return values, written(spark.createDataFrame([(i, v) for i, v in enumerate(values.tolist())], f"{ident} bigint, {name} array<double>"))


@pytest.mark.parametrize("room", [1, 12, 50, 10**6])
def test_centers_in_blocks(spark, room):
    _, rows = vectors(spark, 60, 4, 1)
    values, centers = vectors(spark, 17, 4, 2, "center", "cluster_id")
    centers = centers.unionByName(centers.filter("cluster_id < 3").withColumn("cluster_id", F.col("cluster_id") + 100))
    want = clusters.nearest_center(rows, centers)
    got = assignment.assign_to_centers(rows, centers, "vec_id", max_numbers=room)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_more_centers_than_one_value_holds(spark):
    """300 000 centres of 57 numbers are above the bound of one value."""
    dims, k = 57, 300_000
    assert dims * k > clusters.MAX_CENTER_NUMBERS
    number = lambda i: (F.pmod(F.xxhash64("cluster_id", F.lit(i)), F.lit(1000)) / 1000).cast("double")
    centers = written(spark.range(k).withColumnRenamed("id", "cluster_id").withColumn("center", F.array(*[number(i) for i in range(dims)])))
    values, rows = vectors(spark, 4, dims, 3)
    got = {r.vec_id: r.cluster_id for r in assignment.assign_to_centers(rows, centers, "vec_id").collect()}
    table = centers.orderBy("cluster_id").toPandas()
    known = np.stack(table.center.to_numpy())
    assert got == {i: int(np.argmin(((known - v) ** 2).sum(1))) for i, v in enumerate(values)}


def test_terms_of_reviews(spark):
    """Words and pairs of neighbours, put together without a lambda that Spark interprets."""
    rows = [(0, ["a", "b", "a", "b"]), (0, ["b"]), (1, []), (1, None), (2, ["x", "y"])]
    terms = clusters.term_occurrences(spark.createDataFrame(rows, "cluster_id int, _words array<string>"))
    want = [(c, t) for c, w in rows for t in [*(w or []), *map(" ".join, zip(w or [], (w or [])[1:]))]]
    assert sorted(tuple(r) for r in terms.collect()) == sorted(want)
    assert "lambda" not in terms._jdf.queryExecution().optimizedPlan().toString()


def test_corrections_read_the_flagged_table(spark):
    """Texts are cleaned and searched once, not for the labels and again for the corrections."""
    from verification import queries

    files = queries.QUERIES["apply_corrections"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "documents" in f]
