"""Ranked search, alignment and sharding against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from conftest_words import words
from plaintide.llm import alignment, lexical, sharding

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def search_truth(docs, items, k):
    """docs: (id, text); items: (item, text)."""
    found = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, whole = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            n = sum(c.values())
            if n:
                m = 75 + 25 * n * n_docs // whole
                score = sum(
                    times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, times in Counter(terms_of(text)).items() if t in c
                )
                if score > 0:
                    scores.append((-score, i is None, i))
        best = sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        out += [(item, rank + 1, i, -score) for rank, (score, _, i) in enumerate(best)]
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_folded(text):
    text = text.encode("utf-8", "ignore").decode()
    found = terms_of(text)
    assert lexical.folded(text) == (" " + "".join(t + " " for t in found)).encode().decode("latin-1")


ITEMS = [(1, "abc de FG"), (1, "abc abc"), (2, None), (3, ""), (None, "one Two"), (5, "日本語の文章"), (6, "a " * 50 + "x"), (7, "é ñ"), (8, "ba ca da fa ga ha")]


@pytest.mark.parametrize("block", [60, 10**6])
def test_search(spark, odd, block, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 64)
    rng = random.Random(3)
    many = [(i, " ".join(rng.choice(["abc", "de", "fg", "ba", "ca", "x-y", "É", "ab"]) for _ in range(rng.randint(1, 9)))) for i in range(100, 400)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(many, "doc_id bigint, text string"))
    items = spark.createDataFrame([(*x, 1, "r") for x in ITEMS], "item_id bigint, text string, row int, rank string")
    docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/search-{block}")
    docs = spark.read.parquet(path)
    got = lexical.search(docs.selectExpr("*", "1 as n", "'x' as terms"), items, k=7, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(got.collect()) == ordered(search_truth([tuple(r) for r in docs.collect()], ITEMS, 7))


def test_search_empty(spark, odd, nothing):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical.search(nothing, items).collect() == []
    assert lexical.search(odd, items.filter("item_id = -1")).collect() == []


def align_truth(docs):
    pair = alignment.tokenizers(alignment.BYTE_BPE, alignment.PIECE_BPE)
    found, counts = [], Counter()
    for i, text in docs:
        links, spelt, a, b = [], [], [], []
        if text:
            a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            if not pair.same(a, b, text):
                a, b = [], []
        ends_a, ends_b = np.cumsum([len(pair.bytes_a[x]) for x in a]).tolist(), np.cumsum([len(pair.bytes_b[x]) for x in b]).tolist()
        both, i_a, i_b = sorted(set(ends_a) & set(ends_b)), 0, 0
        for end in both:
            j_a, j_b = ends_a.index(end, i_a) + 1, ends_b.index(end, i_b) + 1
            spelt.append(",".join(map(str, a[i_a:j_a])) + "|" + ",".join(map(str, b[i_b:j_b])))
            links.append((a[j_a - 1], b[j_b - 1]))
            i_a, i_b = j_a, j_b
        counts.update(links)
        found.append((i, len(a), len(b), links, ";".join(spelt)))
    most = defaultdict(int)
    for (x, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (i, a, b, len(x), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), s and hashlib.sha256(s.encode()).hexdigest())
        for i, a, b, x, s in found
    ]


SPACED = ["a  b", " lead", "  two", "trail ", "trail  ", "a\n b", "a \n b", "\n", " ", "   ", "x▁y z", "<s> </s> <unk> <|endoftext|> x", "<0x41> b", "tab\t tab", "é́ ñ\x1c\x1d b", "😀 😀‍😀", "don't we'll", "\x00 a"]


@pytest.mark.parametrize("hot", [0, 20, 1 << 16])
def test_align(spark, odd, hot):
    docs = odd.select("doc_id", "text", "row", "ids", "score").union(
        spark.createDataFrame([(500 + i, t, 1, "x", "y") for i, t in enumerate(SPACED * 2)], "doc_id bigint, text string, row bigint, ids string, score string")
    ).selectExpr("*", "1 as name", "2 as copies", "'q' as n_A")
    docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/align-{hot}")
    docs = spark.read.parquet(path)
    got = alignment.align(docs, keep=["doc_id", "row", "name", "n_A"], hot=hot).collect()
    assert all(r.name == 1 for r in got)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got]
    assert ordered(got) == ordered(align_truth([(r.doc_id, r.text) for r in docs.collect()]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab  \n\t'sé1.,　▁", max_size=80)), min_size=1, max_size=5))
def test_chunks_are_the_text(texts):
    texts = [t for t in (t.encode("utf-8", "ignore").decode() for t in texts) if t]
    pair = alignment.tokenizers(alignment.BYTE_BPE, alignment.PIECE_BPE)
    got = list(alignment.Aligned(pair).texts(texts))
    want = align_truth(enumerate(texts))
    assert [x[:4] for x in got] == [(w[1], w[2], w[3], w[7]) for w in want]


def test_align_empty(nothing):
    assert alignment.align(nothing).collect() == []


def test_only_the_new_shard_receives(spark):
    ids = spark.range(20_000).selectExpr("cast(id as string) || 'k' as id")
    tree = sharding.Tree((((1.0, 2.0), (3.0,)), ((0.5, 0.5, 1.0),)))
    before = tree
    for k, after in enumerate([tree.grown(), tree.grown().grown(2.0), tree.heavier(1, 1.5)]):
        base = tree.grown() if k == 1 else before
        rows = ids.select(sharding.shard_of(ids.id, base).alias("x"), sharding.shard_of(ids.id, after).alias("y")).collect()
        target = 1 if k == 2 else len(base.weights())
        assert {r.y for r in rows if r.x != r.y} == {target}
        share = Counter(r.y for r in rows)
        weights = after.weights()
        for shard, w in enumerate(weights):
            assert share[shard] / len(rows) == pytest.approx(w / sum(weights), rel=0.12)


def test_tree():
    tree = sharding.Tree.even(24, 2, 3)
    assert [len(rack) for region in tree.founding for rack in region] == [4] * 6
    assert tree.grown().places()[24] == (0, 0) and tree.grown().grown().places()[25] == (0, 1)
    assert sharding.Tree.even(2, 3, 3).weights() == [1.0, 1.0]
    assert sharding.Tree.even(7, 2, 3).places()[-1] == (1, 2)


def test_shard_rows(spark, odd):
    tree = sharding.Tree.even(24)
    docs = odd.selectExpr("*", "'a' as Shard", "'b' as slot", "1 as size")
    got = sharding.shard_rows(docs, tree, keep=["doc_id", "text", "row", "Shard"]).collect()
    assert len(got) == odd.count()
    places = tree.places()
    for r in got:
        value = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(value) + 8, zlib.crc32(value), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24) and places[r.shard] == (r.region, r.rack)
    by_key = defaultdict(set)
    for r in got:
        by_key[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(v) == 1 for v in by_key.values())
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    for rows in by_shard.values():
        rows.sort(key=lambda r: r.slot)
        assert [r.slot for r in rows] == list(range(len(rows)))
        keys = [(-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in rows]
        assert keys == sorted(keys)
    sums = sharding.totals(sharding.shard_rows(docs, tree)).collect()
    assert sum(r.n_rows for r in sums) == len(got) and sum(r.n_bytes for r in sums) == sum(r["size"] for r in got)


def test_one_key_holds_most_rows(spark, tmp_path):
    spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "'same' as text").write.parquet(str(tmp_path / "hot"))
    docs = spark.read.parquet(str(tmp_path / "hot"))
    got = sharding.shard_rows(docs, sharding.Tree.even(4)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == 6000


def test_shard_empty(nothing):
    assert sharding.shard_rows(nothing, sharding.Tree.even(24)).collect() == []
