"""The stages one after the other, each held against brute force on its own input."""

import random

import pytest

import corpus_pipeline
from conftest_words import words
from plaintide.llm import packing
from test_dedup import passage_truth, short_line_truth, similar_truth


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    passage, line, base = words(rng, 60), words(rng, 12), words(rng, 200)
    rows = []
    for i in range(240):
        text = words(rng, rng.randint(20, 120))
        if i % 8 == 0:
            text = text[: len(text) // 2] + " vileness " + text[len(text) // 2 :]
        elif i % 8 == 1:
            text += " " + passage + " " + words(rng, 5)
        elif i % 8 == 2:
            text += "\n" + line + "\n" + words(rng, 10)
        elif i % 8 == 3:
            text = base.replace(base[100:105], f"{i:05d}"[:5], 1)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(240, None, None, None, None), (241, "", "en", "s", 0), (None, words(rng, 30), "en", "s", 1)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 == 0), 1) for i in range(240)], "doc_id bigint, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stage(spark, docs, corpus)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None and r.doc_id is not None and name not in ("toxicity", "ngram_jaccard"))
    before, after = (rows_of(x) for x in seen["toxicity"])
    assert {i for i, _ in before} - {i for i, _ in after} == {i for i in range(0, 240, 8)}
    before, after = (rows_of(x) for x in seen["line_dedup"])
    kept = sum(w[6] for w in short_line_truth(before))
    assert sum(bool(x.strip("\t\v\f\r ")) for _, t in after for x in (t or "").split("\n")) == kept
    before, after = (rows_of(x) for x in seen["ngram_jaccard"])
    assert len(after) == sum(w[5] for w in similar_truth(before))
    before, after = (rows_of(x) for x in seen["suffix_dedup"])
    want = passage_truth([(t or "").encode() for _, t in before], 200)
    assert sorted(len((t or "").encode()) for _, t in after if t) == sorted(len(w) for w, _ in want if w)
    before, pieces = rows_of(seen["packing"][0]), seen["packing"][1].collect()
    tokens = sum(len(packing._tokenizer(packing.WORD_BPE).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in before)
    assert sum(r.length for r in pieces) == tokens


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "ids", "sequence_id"} <= set(out.columns) and out.count() > 0


def test_empty_and_clashing(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").selectExpr("*", "1 as score", "'x' as kept", "2 as spans", "3 as row", "4 as _row", "5 as passages")
    for part in (docs.filter("doc_id = -1"), docs.filter("doc_id < 30 or doc_id is null")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, part, corpus)
            assert out.columns == docs.columns, name
            assert out.filter("kept <> 'x' or _row <> 4 or score <> 1 or spans <> 2 or row <> 3 or passages <> 5").count() == 0
