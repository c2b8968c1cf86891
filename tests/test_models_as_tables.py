"""Models whose weights and centres are tables, against the libraries and numpy."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from plaintide.operators import linear
from plaintide.plans import assignment, training
from plaintide.session import written

LABELS = ["good", "bad", "none"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    words = {"good": ["nice", "fine", "great"], "bad": ["awful", "poor", "broken"], "none": []}
    data = []
    for i in range(240):
        label = LABELS[i % 2]
        data.append((i, " ".join(rng.choice(["phone", "case", "box", "cable"] + words[label]) for _ in range(rng.randint(3, 15))), label))
    data += [(240, "", "good"), (241, "unheard words only", "bad")]
    return written(spark.createDataFrame(data, "review_id bigint, review_text string, label string"))


def terms(rows):
    return PipelineModel(training.term_stages()).transform(rows).select("review_id", "_terms", "label")


def probabilities(df, name="probs"):
    return {r.review_id: r[name] for r in df.collect()}


def test_pipeline_as_tables(rows):
    model = training.fit_text_classifier(rows.limit(200), "label", LABELS[:2], min_df=2.0, max_iter=50)
    vocabulary, table = training.linear_tables(model)
    want = probabilities(training.score_classes(rows, model, "probs"))
    got = probabilities(training.score_by_table(terms(rows), vocabulary, table, LABELS[:2], "probs"))
    assert got.keys() == want.keys() and len(got) == 242
    assert all(np.allclose(got[i], want[i], atol=1e-9) for i in want)


def test_naive_bayes(rows):
    docs = written(terms(rows))
    vocabulary, model = training.fit_term_model(docs, "label", LABELS, [0.5, 2.0])
    known = {r.term: r.idf for r in vocabulary.collect()}
    data = [(r.review_id, r.label, [t for t in r._terms if t in known]) for r in docs.collect()]
    for a in (0.5, 2.0):
        weights = {r.term: r.weights for r in model.filter(F.col("smoothing") == a).collect()}
        assert set(weights) == {*known, None}
        for k, label in enumerate(LABELS):
            mine = [t for _, x, ts in data if x == label for t in ts]
            for t in known:
                assert weights[t][k] == pytest.approx(np.log((mine.count(t) + a) / (len(mine) + a * len(known))))
            assert weights[None][k] == pytest.approx(np.log((sum(x == label for _, x, _ in data) + 1) / (len(data) + 3)))
    scored = probabilities(training.score_by_table(docs, vocabulary, model.filter("smoothing = 2"), LABELS, "probs"))
    weights = {r.term: np.array(r.weights) for r in model.filter("smoothing = 2").collect()}
    for i, _, ts in data:
        x = {t: ts.count(t) * known[t] for t in set(ts)}
        norm = sum(v * v for v in x.values()) ** 0.5
        z = weights[None] + sum((v / norm * weights[t] for t, v in x.items()), np.zeros(3))
        assert np.allclose(scored[i], np.exp(z - z.max()) / np.exp(z - z.max()).sum())


def test_best_fit(spark):
    data = [(0.1, "a", "a"), (0.1, "b", "a"), (1.0, "a", "a"), (1.0, "b", "b"), (10.0, "a", "a"), (10.0, "b", "b"), (5.0, "a", "c"), (5.0, "b", "b")]
    got = {r.key: r for r in linear.best_fit(spark.createDataFrame(data, "key double, true_label string, pred_label string"), "key").collect()}
    assert {k for k, r in got.items() if r.chosen} == {10.0}
    assert got[0.1].macro_f1 == pytest.approx((2 / 3 + 0) / 2) and got[0.1].accuracy == 0.5
    assert got[5.0].macro_f1 == pytest.approx(1 / 3) and got[5.0].rows == 2


def test_smoothing_path(rows):
    path = training.smoothing_path(written(terms(rows)), "label", LABELS[:2], [0.1, 1.0]).collect()
    assert sorted(r.smoothing for r in path) == [0.1, 1.0] and sum(r.chosen for r in path) == 1
    assert max(r.macro_f1 for r in path) > 0.8


def test_penalty_path(rows):
    trained, path = training.train_path(rows.filter("review_id < 240"), "label", LABELS[:2], [0.01, 1.0], max_iter=30, min_df=2.0)
    got = {r.penalty: r for r in path.collect()}
    assert set(got) == {100.0, 1.0}
    chosen = max(got.values(), key=lambda r: (r.macro_f1, r.penalty))
    assert chosen.chosen and sum(r.chosen for r in got.values()) == 1
    assert trained.validation_metrics().first().macro_f1 == pytest.approx(chosen.macro_f1)


def key(seed, step, i):
    return hashlib.md5(f"{seed}:{step}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(c, 0.3, size=(120, 3)) for c in (0, 4, 8)]).round(3)
    return values, written(spark.createDataFrame([(i, v) for i, v in enumerate(values.tolist())], "vec_id bigint, embedding array<double>"))


def moved(values, ids, centers, seen):
    centers, seen = centers.copy(), seen.copy()
    near = np.array([int(np.argmin(((centers - values[i]) ** 2).sum(1))) for i in ids], int)
    for c in set(near.tolist()):
        mine = [i for i, k in zip(ids, near) if k == c]
        seen[c] += len(mine)
        centers[c] += (values[mine].mean(0) - centers[c]) * len(mine) / seen[c]
    return centers, seen


def test_minibatch_steps(points):
    values, rows = points
    start = assignment.first_centers(rows, 4, "vec_id")
    order = sorted(range(360), key=lambda i: key(42, 0, i))[:4]
    centers, seen = values[order].copy(), np.zeros(4, int)
    for step in (1, 2, 3):
        centers, seen = moved(values, [i for i in range(360) if int(key(42, step, i)[:8], 16) < 0.25 * 16**8], centers, seen)
    got = {r.cluster_id: r for r in assignment.minibatch_kmeans(rows, start, "vec_id", share=0.25, steps=3, patience=None).collect()}
    assert [got[c].n for c in range(4)] == seen.tolist()
    assert np.allclose([got[c].center for c in range(4)], centers)


def test_minibatch_stops_and_goes_on(points, monkeypatch):
    values, rows = points
    start = written(assignment.first_centers(rows, 3, "vec_id", seed=1))
    steps = []
    plain = assignment.move_centers
    monkeypatch.setattr(assignment, "move_centers", lambda *a: steps.append(1) or plain(*a))
    state = assignment.minibatch_kmeans(rows, start, "vec_id", share=0.5, steps=12, tol=100.0, patience=2)
    assert len(steps) == 2
    late = rows.filter("vec_id < 50")
    before, after = ({r.cluster_id: r for r in s.collect()} for s in (state, plain(state, late)))
    centers, seen = moved(values, range(50), np.array([before[c].center for c in range(3)]), np.array([before[c].n for c in range(3)]))
    assert np.allclose([after[c].center for c in range(3)], centers) and [after[c].n for c in range(3)] == seen.tolist()


def test_reseed(spark, points):
    values, rows = points
    state = written(spark.createDataFrame([(0, [0.0, 0.0, 0.0], 500), (1, [99.0, 99.0, 99.0], 1), (2, [4.0, 4.0, 4.0], 80)], "cluster_id bigint, center array<double>, n bigint"))
    got = {r.cluster_id: r for r in assignment.reseed(state, rows, assignment._key(42, 7, "vec_id"), "vec_id").collect()}
    first = min(range(360), key=lambda i: key(42, 7, i))
    assert got[1].center == values[first].tolist() and got[1].n == 80
    assert got[0].n == 500 and got[2].center == [4.0, 4.0, 4.0]
    assert assignment.reseed(state.filter("cluster_id <> 1"), rows, assignment._key(42, 7, "vec_id"), "vec_id").count() == 2


def shuffles(df):
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_rare_terms_stay(spark):
    """Vectors are shuffled once, by id, and class counts after the vocabulary has dropped the other terms."""
    docs = written(spark.createDataFrame([(1, ["a", "a", "b", "x"], "p"), (1, ["a"], "q"), (None, ["b"], "p"), (2, ["x"], None), (3, None, "q")], "review_id bigint, _terms array<string>, label string"))
    vocabulary = written(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "term string, idf double"))
    vectors = training.tfidf_vectors(docs, vocabulary)
    assert len(shuffles(vectors)) == 1
    got = {(r.review_id, r.term): r.weight for r in vectors.collect()}
    assert got == pytest.approx({(1, "a"): 3 / 13**0.5, (1, "b"): 2 / 13**0.5, (None, "b"): 1.0})
    counts = linear.class_term_counts(docs, vocabulary, "label")
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")
    assert {(r.label, r.term): r.n for r in counts.collect()} == {("p", "a"): 2, ("p", "b"): 2, ("q", "a"): 1}
    assert {(r.term, r.tf, r.df) for r in training._count_terms(training._occurrences(docs)).collect()} == {("a", 3, 2), ("b", 2, 2), ("x", 2, 2)}
