"""Neighbour search, toxicity and archives."""

import gzip
import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest_words import words
from plaintide.llm import ann, toxicity, warc


def cosine_truth(rows, asked, k):
    out = {}
    for n, (i, v) in enumerate(rows):
        if not asked(i):
            continue
        others = [(-float(v @ w / (math.sqrt(v @ v) * math.sqrt(w @ w))), j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v)]
        out.setdefault(i, []).append([j for _, j in sorted(others)[:k]])
    return out


def test_recall(spark, tmp_path):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 24))
    vec = centres[rng.integers(0, 20, 3000)] + 0.5 * rng.normal(size=(3000, 24))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "vec_id bigint, vec array<double>").write.parquet(str(tmp_path / "v"))
    got = ann.nearest(spark.read.parquet(str(tmp_path / "v")), F.col("vec_id") % 50 == 0, shard_rows=800).collect()
    want = cosine_truth(list(enumerate(vec)), lambda i: i % 50 == 0, 5)
    hits = sum(r.vec_id in want[r.query_id][0] for r in got)
    assert len(got) == 300 and hits >= 0.97 * 300
    for r in got:
        a, b = vec[r.query_id], vec[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [(r.score, -r.vec_id) for r in mine] == sorted(((r.score, -r.vec_id) for r in mine), reverse=True)


@pytest.mark.parametrize("groups, copies", [(200, 3), (60, 10), (20, 60)])
def test_nearest_with_copies(spark, tmp_path, groups, copies):
    """Groups of equal and of scaled vectors, larger than the degree too: every copy can be found."""
    rng = np.random.default_rng(copies)
    base = rng.normal(size=(1800, 24)).round(3)
    vec = np.concatenate([base, *[base[:groups] * (2.0 if c == 1 else 1.0) for c in range(copies - 1)]])
    ids = rng.permutation(len(vec))
    spark.createDataFrame([(int(i), v) for i, v in zip(ids, vec.tolist())], "vec_id bigint, vec array<double>").repartition(3).write.parquet(str(tmp_path / "v"))
    asked = F.col("vec_id") % 7 == 0
    got = ann.nearest(spark.read.parquet(str(tmp_path / "v")), asked, shard_rows=900).collect()
    score = (vec @ vec.T) / np.linalg.norm(vec, axis=1)[:, None] / np.linalg.norm(vec, axis=1)[None]
    np.fill_diagonal(score, -2)
    least = {int(ids[q]): np.sort(score[q])[-5] for q in range(len(vec)) if ids[q] % 7 == 0}
    assert len(got) == 5 * len(least)
    assert sum(r.score >= least[r.query_id] - 1e-9 for r in got) / len(got) >= 0.95


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (None, [1.0, 0.0]), (100, [1.0, 0.0, 0.0]), (150, [3e300, 3e300])]
    rows = [(*r, "x", 7) for r in rows]
    spark.createDataFrame(rows, "vec_id bigint, vec array<double>, id string, rank int").coalesce(1).write.parquet(str(tmp_path / "v"))
    table = spark.read.parquet(str(tmp_path / "v"))
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(table, F.col("vec_id") % 50 == 0, k=3).collect()]
    half = round(math.sqrt(0.5), 9)
    assert sorted(got) == sorted([
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, half), (50, 1, 50, 1.0), (50, 2, 150, 1.0), (50, 3, 0, half), (50, 1, 50, 1.0), (50, 2, 150, 1.0), (50, 3, 0, half),
        (150, 1, 50, 1.0), (150, 2, 50, 1.0), (150, 3, 0, half),
    ])
    assert ann.nearest(table.filter("vec_id = -1"), F.col("vec_id") % 50 == 0).collect() == []


def segment_truth(scores):
    """Maximal segments by their recursive definition: the best segment, then the rest on both sides."""
    best = None
    total = np.concatenate([[0], np.cumsum(scores)])
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = total[j] - total[i]
            if s > 0 and (best is None or s > best[2] or s == best[2] and j - i < best[1] - best[0]):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return segment_truth(scores[:i]) + [(i, j, s)] + [(a + j, b + j, c) for a, b, c in segment_truth(scores[j:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-997, 997), max_size=25, unique=True))
def test_segments(values):
    scores = np.array(values, float) + np.arange(len(values)) * 1e-3
    got = [(a, b) for a, b, _ in toxicity.segments(scores)]
    assert got == [(a, b) for a, b, _ in segment_truth(scores)]


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        text = words(rng, rng.randint(5, 150)).split()
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(["vileness", "scumlike", f"ranko{rng.choice('abcdefgh')}{rng.randint(0, 99)}"]))
        rows.append((i, " ".join(text), "en", "t", 0.5, 3))
        labels.append((i, int(toxic), 1))
    rows += [(2000, None, "en", "t", 0.5, 3), (2001, "", "en", "t", 0.5, 3), (None, "you vileness", "en", "t", 0.5, 3), (3, rows[3][1], "en", "t", 0.5, 3), (2002, words(rng, 50_000), "en", "t", 0.5, 3)]
    labels += [(None, 1, 1), (5, None, None), (1, 0, 0)]
    path = tmp_path_factory.mktemp("tox")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double, predicted int").write.parquet(str(path / "d"))
    spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int").write.parquet(str(path / "l"))
    return spark.read.parquet(str(path / "d")), spark.read.parquet(str(path / "l"))


def test_toxicity(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, keep=docs.columns).withColumn("test", toxicity.held_out("doc_id")).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    test = [r for r in got if r.test and r.doc_id is not None and r.doc_id < 1500]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in test) and len(test) > 200
    right = sum(r.predicted == (r.doc_id % 6 == 0) for r in test)
    assert right >= 0.97 * len(test)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2000].predicted == by_id[2001].predicted == by_id[2002].predicted == 0
    assert by_id[2000].score == by_id[2001].score and by_id[2000].passages == []
    assert by_id[None].predicted == 1
    for r in got:
        if r.predicted and r.doc_id is not None and r.doc_id % 6 == 0:
            hit = {w for p in r.passages for w in r.text.lower().split()[p.start : p.end]}
            assert any(w.startswith(("vile", "scum", "ranko")) for w in hit)


def test_toxicity_learns_only_from_its_rows(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    lies = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, lies)
    assert (model.toxic == again.toxic).all() and (model.slope, model.shift, model.rate) == (again.slope, again.shift, again.rate)


def test_passages_score_the_same_wherever_they_stand(spark):
    size, rng = 1 << 12, random.Random(1)
    toxic, clean = np.zeros(size + 1, np.float32), np.zeros(size + 1, np.float32)
    toxic[-1], clean[-1] = 1000, 9000
    for word in ("bad", "vil", "ugh"):
        toxic[zlib.crc32(word.encode()) % size] = 60
    for word in ("the", "and", "dog", "cat"):
        clean[zlib.crc32(word.encode()) % size] = 500
    model = toxicity.Model(toxic, clean, 2.0, scale=0.01)
    passage = "bad vil ugh bad"
    filler = lambda: " ".join(rng.choice(["the", "and", "dog", "cat"]) for _ in range(40))
    early = " ".join(f"{filler()} {w}" for w in passage.split() * 5)
    texts = [f"{filler()} {passage} {filler()}", f"{early} {filler()} {passage} {filler()}", " ".join(f"{filler()} {passage}" for _ in range(6)), "bad " * 400, early]
    got = sorted(toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect())
    found = [{(p.start, p.end): p.score for p in r.passages} for r in got]
    (alone,) = found[0].values()
    late = texts[1].split()
    at = [i for i in range(len(late)) if late[i : i + 4] == passage.split()]
    assert [found[1][i, i + 4] for i in at] == pytest.approx([alone] * len(at)) and at
    assert len(found[2]) == 6 and list(found[2].values()) == pytest.approx([alone] * 6)
    assert got[1].predicted == got[0].predicted and got[1].score >= 0.5 * got[0].score
    assert all(s < 2 * alone for s in found[3].values()) and len(found[3]) <= 1
    assert got[1].score >= got[4].score


def test_toxicity_counts_by_feature(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    assert len(model.toxic) == len(model.clean) == (1 << 20) + 1 and model.toxic.dtype == np.float32
    rows = docs.filter("doc_id < 300").select("text", (F.col("doc_id") % 6 == 0).cast("int"))
    want = np.zeros((2, 1025))
    for text, label in rows.collect():
        for word in set(text.lower().split()):
            np.add.at(want[label], [*toxicity._buckets(word, 1024), 1024], 1)
    toxic, clean = toxicity._count(rows, 1024)
    assert (toxic == want[1]).all() and (clean == want[0]).all()


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.filter("doc_id = -1"))
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}
    assert toxicity.score(docs.filter("doc_id = -1"), model).collect() == []


PAGES = [
    (4, "http://www.b.example/x?q=1#top", "p" * 100), (2, "https://a.example/", "p" * 100), (9, "https://a.example", "p" * 100), (5, None, "short"),
    (6, "ftp://u@a.example:8/é", "short"), (7, "x", None), (8, "http://c.example/\r\nX: y", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\n" + "ü" * 60),
    (None, "http://n.example", "p" * 100), (2, "https://a.example/", "p" * 100), (11, "http://d.example", ""), (12, "http://e.example", "q" * 99), (13, "http://e.example", "q" * 99),
]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "p")
    rows = [(*p, "clash", 1) for p in PAGES]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, captured string, row int").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_archives(spark, pages, tmp_path):
    path = warc.write_archives(pages, str(tmp_path / "w"), records_per_file=2)
    back = warc.read_archives(spark, path).collect()
    want = []
    for i, url, html in PAGES:
        data = (html or "").encode()
        again = len(data) >= 100 and html == "p" * 100 and i != 2
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 2 if again else None, None if again else data))
    want[8] = (2, 100, want[8][2], "revisit", 2, None)  # a repeated row revisits the first
    num = lambda x: None if x is None else int(x)
    got = [(num(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers_to), None if r.payload is None else bytes(r.payload)) for r in back]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.url for r in back} == {None if u is None else u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in PAGES}
    files = [f for f in (tmp_path / "w").glob("part-*") if f.stat().st_size]
    assert sum(len(list(warc.parse(gzip.decompress(f.read_bytes())))) for f in files) == len(PAGES) and len(files) > 3


def test_revisits_name_records(spark, pages, tmp_path):
    first, second = (warc.read_archives(spark, warc.write_archives(pages, str(tmp_path / w))).collect() for w in "ab")
    known = {r.record_id: r for r in first}
    assert len(known) == len(PAGES) and not known.keys() & {r.record_id for r in second}
    revisits = [r for r in first if r.record_type == "revisit"]
    assert len(revisits) == 4
    for r in revisits:
        to = known[r.refers_to_record]
        assert (to.record_type, to.page_id, to.payload_digest) == ("response", r.refers_to, r.payload_digest)
    assert all(r.refers_to_record is None and r.refers_to is None for r in first if r.record_type == "response")


def test_records_can_be_sought(spark, pages, tmp_path):
    """A record is a gzip member: it can be read from its position without what comes before."""
    path = warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    for r in warc.read_archives(spark, path).collect():
        data = Path(r.archive.removeprefix("file:")).read_bytes()
        [(at, content)] = [next(warc.members(data[r.position :]))]
        [record] = list(warc.parse(content))
        assert at == 0 and (record["record_id"], record["payload"]) == (r.record_id, None if r.payload is None else bytes(r.payload))


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    """Long and random payloads fill an archive sooner; one record of 17 MiB ends with an empty member."""
    body = lambda i, n: "".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz\0\n\r", k=n))
    rows = [(i, f"http://x.example/{i}", body(i, 50_000)) for i in range(40)] + [(99, "http://x.example/z", "z" * (17 << 20))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    path = warc.write_archives(df, str(tmp_path / "w"), archive_bytes=200_000)
    files = [f for f in (tmp_path / "w").glob("part-*") if f.stat().st_size]
    assert len(files) > 6 and max(f.stat().st_size for f in files) <= 200_020
    assert all(gzip.decompress(f.read_bytes()) for f in files)
    got = {int(r.page_id): bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect()}
    assert got == {i: html for i, _, html in rows}


def test_page_names_of_any_form(spark, tmp_path):
    names = ["a\r\nX: y", "50%0A", "", " ü ", None]
    df = spark.createDataFrame([(n, None, "p" * 100) for n in names], "page_id string, url string, html string")
    when = df.withColumn("seen", F.lit("2024-01-02 03:04:05"))
    back = warc.read_archives(spark, warc.write_archives(when, str(tmp_path / "w"), captured="seen")).collect()
    assert sorted((r.page_id for r in back), key=repr) == sorted(names, key=repr)
    assert {r.refers_to for r in back if r.record_type == "revisit"} == {""}


def test_history_is_ordered(pages, tmp_path):
    got = sorted(warc.capture_history(pages, str(tmp_path / "w"), records_per_file=2).collect(), key=lambda r: r.place)
    keys = [(r.key, r.captured, r.page) for r in got]
    assert len(got) == len(PAGES) and keys == sorted(keys)
    assert {"example,a)/", "example,b)/x?q=1", ")/"} <= {r.key for r in got}


def test_history_of_nothing(pages, tmp_path):
    assert warc.capture_history(pages.filter("page_id = -1"), str(tmp_path / "w")).collect() == []


def test_damage_is_noticed(pages, tmp_path):
    path = warc.write_archives(pages, str(tmp_path / "w"), records_per_file=100)
    data = max((gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*") if f.stat().st_size), key=len)
    with pytest.raises(ValueError):
        list(warc.parse(data[:-6]))
    assert path


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
