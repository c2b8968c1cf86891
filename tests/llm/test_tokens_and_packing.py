"""Encoding, token counts and packing against the tokenizer libraries."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from plaintide.llm import bpe, packing, token_counts


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.merges(bpe.BYTE_BPE).ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text(alphabet="ab \n\t'sré1.,  \x1c", max_size=120)), max_size=6))
def test_shard_is_the_library(texts):
    shard = bpe.Shard(bpe.BYTE_BPE, public_tokenizers.PATTERN)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for t in texts:
        shard.add(t)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.merges(bpe.BYTE_BPE).ranks, special_tokens={})
    assert [x.tolist() for x in shard.encoded()] == [library.encode_ordinary(t) for t in texts]


def test_encode_decode(odd, reference):
    both = bpe.decode(bpe.encode(odd, keep=["doc_id", "text", "ids", "row"], shard_chars=3000)).collect()
    assert len(both) == odd.count()
    for r in both:
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.row == 99


def test_encode_empty_table(nothing):
    assert bpe.decode(bpe.encode(nothing)).collect() == []
    assert token_counts.token_counts(nothing).collect() == []
    assert packing.pack(nothing).collect() == []


def test_token_counts(odd, reference):
    lengths = sorted(len(reference.encode_ordinary(r.text or "")) for r in odd.collect())
    curve = token_counts.token_counts(odd)
    rows = {r.length: r for r in curve.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(lengths)
    for limit, r in rows.items():
        assert r.docs_above == sum(x > limit for x in lengths)
        assert r.tokens_above == sum(x for x in lengths if x > limit)
        assert r.truncated_total == sum(min(x, limit) for x in lengths) == sum(lengths) - r.lost_tokens
        assert r.share_fitting == pytest.approx(sum(x <= limit for x in lengths) / len(lengths))
    one = token_counts.at_limit(curve, 100).collect()
    assert [r.truncated_total for r in one] == [sum(min(x, 100) for x in lengths)]
    assert token_counts.quantile(curve, 0.5).first().length == lengths[(len(lengths) + 1) // 2 - 1]


def test_token_counts_by_group(odd, reference):
    got = {(r.doc_id, r.length): (r.n_docs, r.docs_total) for r in token_counts.token_counts(odd, by=["doc_id"]).collect()}
    rows = [(r.doc_id, len(reference.encode_ordinary(r.text or ""))) for r in odd.collect()]
    assert got == {k: (n, sum(i == k[0] for i, _ in rows)) for k, n in Counter(rows).items()}


@pytest.mark.parametrize("width, block", [(64, 5_000), (2048, 6_000_000)])
def test_pack(odd, width, block):
    library = Tokenizer.from_file(packing.WORD_BPE)
    library.encode_special_tokens = True
    pieces = [r.asDict() for r in packing.pack(odd, keep=["doc_id", "text", "score"], width=width, block_chars=block).collect()]
    by_text = defaultdict(list)
    for p in pieces:
        by_text[(p["doc_id"], p["text"])].append(p)
    copies = Counter((r.doc_id, r.text) for r in odd.collect())
    assert set(by_text) == set(copies)
    for key, parts in by_text.items():
        ids = [*library.encode(key[1] or "", add_special_tokens=False).ids, 1]
        assert sum(p["length"] for p in parts) == copies[key] * len(ids)
        for p in parts:
            assert p["doc_tokens"] == len(ids)
            assert np.frombuffer(p["ids"], "<u4").tolist() == ids[p["start"] : p["start"] + p["length"]]
    windows = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append(p)
    for parts in windows.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= width and parts[0]["padded"] == (at if at & (at - 1) == 0 else width)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=40), st.integers(0, 1000))
def test_cuts_cost_least(gaps, seed):
    cuts = np.cumsum([0, *gaps])
    penalty = np.random.default_rng(seed).choice([0.0, packing.SENTENCE_END, packing.HARD_CUT], len(cuts))
    width = 16
    cost = lambda i, j: (0 if (n := cuts[j] - cuts[i]) & (n - 1) == 0 else width - n) + penalty[j] + packing.WINDOW
    best = [0.0]
    for j in range(1, len(cuts)):
        best.append(min(best[i] + cost(i, j) for i in range(j) if cuts[j] - cuts[i] <= width))
    chosen = packing.best_cuts(cuts, penalty, width)
    assert chosen[0] == 0 and chosen[-1] == len(cuts) - 1
    assert sum(cost(i, j) for i, j in zip(chosen, chosen[1:])) == pytest.approx(best[-1])


def test_digests(spark):
    from plaintide.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.merges(bpe.BYTE_BPE).ranks, special_tokens={})
    for r in QUERIES["op1_bpe"](spark, sf).collect():
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    words = Tokenizer.from_file(packing.WORD_BPE)
    tokens = {k: np.array([*words.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in docs.items()}
    pieces = QUERIES["op8_packing"](spark, sf).collect()
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(tokens[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in pieces) == sum(map(len, tokens.values()))
    used = Counter()
    for r in pieces:
        used[(r.sequence_id, r.padded)] += r.length
    assert sum(p for _, p in used) - sum(used.values()) < 0.03 * sum(used.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="abÀéßİıĳǅσΣς|.,!*-_'&$ \n1", max_size=60)), min_size=1, max_size=6))
def test_chunk_ids_are_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    library, chunks = packing._tokenizer(packing.WORD_BPE), packing.Chunks(packing.WORD_BPE, room=3, room_parts=2)
    for t in texts:
        of = chunks.numbers(t)
        ids, first, sizes, _ = chunks.look_up()
        assert [i for k in of for i in ids[first[k] : first[k] + sizes[k]].tolist()] == library.encode(t, add_special_tokens=False).ids
        chunks.make_room()
