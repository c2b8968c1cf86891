"""Exact, line, passage and near-duplicate operators against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from conftest_words import words
from plaintide.llm import exact_dedup, jaccard, line_dedup, suffix_dedup


def ordered(rows):
    """Rows by id, null ids last; equal ids keep their place."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_exact(odd):
    groups = defaultdict(list)
    for r in odd.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((r.doc_id, len(r.text or "")))
    want = []
    for text, rows in groups.items():
        keep = min(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[0]
        sha = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(rows), sha) for i, _ in rows]
    for size in (8, 2048):
        got = exact_dedup.exact_dedup(odd, block_size=size).collect()
        assert sorted([tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "text_sha256")) for r in got], key=repr) == sorted(want, key=repr)
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_hot_group(spark, tmp_path):
    rows = [(i, "same text " * 300 if i % 3 else f"own {i}") for i in range(600)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7).write.parquet(str(tmp_path / "d"))
    got = exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert {r.group_size for r in got if r.doc_id % 3} == {400} and {r.keep_id for r in got if r.doc_id % 3} == {1}
    assert sum(r.kept for r in got) == 201


def test_blocks_without_a_partner_stay(spark, tmp_path, monkeypatch):
    """Only blocks whose hash occurs twice are sorted and named; names differ exactly where blocks do."""
    rows = [(i, f"own text {i} " * 9) for i in range(40)] + [(50 + i, "shared " * 20) for i in range(3)] + [(60, ""), (61, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    tables, keep = [], exact_dedup.written
    monkeypatch.setattr(exact_dedup, "written", lambda df: tables.append(keep(df)) or tables[-1])
    got = exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert [t.filter("block IS NOT NULL").select("block").distinct().count() for t in tables if "block" in t.columns] == [2, 2]
    sizes = {r.doc_id: r.group_size for r in got}
    assert sizes == {i: 1 if i < 40 else 3 if i < 60 else 2 for i, _ in rows}


def edits(a, b):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def line_truth(rows, threshold=2, min_chars=30):
    lines = []
    for row, (i, text) in enumerate(ordered(rows)):
        for no, raw in enumerate((text or "").split("\n")):
            line = raw.strip("\t\v\f\r ")
            if len(line) >= min_chars:
                lines.append(((i is None, i, row, no), line))
    first = {}
    for place, line in lines:
        first.setdefault(line, place)
    rank = {line: k for k, line in enumerate(first)}
    near = defaultdict(set)
    for a in first:
        for b in first:
            if a < b and abs(len(a) - len(b)) <= threshold and edits(a, b) <= threshold:
                near[a].add(b)
                near[b].add(a)
    out = []
    for place, line in lines:
        kept = first[line] == place and all(rank[x] > rank[line] for x in near[line])
        out.append((place[1], place[3], first[line][1], first[line][3], sum(x == line for _, x in lines), len(near[line]), kept))
    return out


def test_lines(spark, tmp_path):
    rng = random.Random(3)
    base = [words(rng, 9) for _ in range(30)]

    def touched(line):
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(line))
            line = rng.choice([line[:at] + line[at + 1 :], line[:at] + "é" + line[at:], line[:at] + "z" + line[at + 1 :]])
        return line

    rows = [(i, "\n".join(rng.choice([touched(rng.choice(base)), "short", "", words(rng, 8), "a" * rng.randint(30, 36)]) for _ in range(6))) for i in range(60)]
    rows += [(None, rows[3][1]), (100, None), (101, ""), (7, rows[7][1]), (7, rows[7][1])]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = line_dedup.judged_lines(docs, min_chars=30).select("place.id", "place.line_no", "first.id", "first.line_no", "copies", "n_links", "kept").collect()
    want = line_truth(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(0 < w[5] for w in want) and not all(w[6] for w in want)
    left = line_dedup.drop_lines(docs).collect()
    lines = sum(len([x for x in (r.text or "").split("\n") if len(x.strip("\t\v\f\r ")) >= 30]) for r in left)
    assert lines == sum(w[6] for w in want)
    assert {100, 101} <= {r.doc_id for r in left}


def test_lines_are_split_once(spark, tmp_path, monkeypatch):
    rows = [(i, f"one line that all share\nline of document number {i}") for i in range(20)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    tables, keep = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df: tables.append(keep(df)) or tables[-1])
    got = line_dedup.judged_lines(spark.read.parquet(str(tmp_path / "d")))
    assert not [f for f in got.inputFiles() if f"{tmp_path}/" in f]
    assert sum("line" in t.columns and t.count() == 40 for t in tables) == 1
    assert sorted(r.copies for r in got.collect()) == [1] * 20 + [20] * 20


def test_lines_odd(odd, nothing):
    got = line_dedup.judged_lines(odd).select("place.id", "place.line_no", "first.id", "first.line_no", "copies", "n_links", "kept").collect()
    rows = [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 20_000]
    want = short_line_truth(rows)
    assert sorted([tuple(r) for r in got if r[0] not in (9, 10)], key=repr) == sorted(want, key=repr)
    assert line_dedup.drop_lines(odd).columns == odd.columns
    assert line_dedup.drop_lines(nothing).collect() == [] == line_dedup.judged_lines(nothing).collect()


def short_line_truth(rows):
    """Every line that isn't blank; an edit for each ten characters of the shorter line, two at most."""
    lines = [((i is None, i, row, no), raw.strip("\t\v\f\r ")) for row, (i, text) in enumerate(ordered(rows)) for no, raw in enumerate((text or "").split("\n"))]
    lines = [(place, line) for place, line in lines if line]
    first = {}
    for place, line in lines:
        first.setdefault(line, place)
    out = []
    for place, line in lines:
        near = [x for x in first if x != line and abs(len(x) - len(line)) <= 2 and edits(x, line) <= min(2, min(len(x), len(line)) // 10)]
        kept = first[line] == place and all(first[x] > place for x in near)
        out.append((place[1], place[3], first[line][1], first[line][3], sum(x == line for _, x in lines), len(near), kept))
    return out


def test_short_lines(spark, tmp_path):
    rng = random.Random(12)
    base = [words(rng, 9)[:n] for n in range(1, 34) for _ in range(2)]

    def touched(line):
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(line) + 1)
            line = rng.choice([line[:at] + line[at + 1 :], line[:at] + "é" + line[at:], line[:at] + "z" + line[at + 1 :]])
        return line

    rows = [(i, "\n".join(rng.choice([touched(rng.choice(base)), rng.choice(base), "}", " \t", ""]) for _ in range(8))) for i in range(90)]
    rows += [(None, rows[3][1]), (100, None), (101, ""), (102, "}"), (7, rows[7][1])]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = line_dedup.judged_lines(docs, min_chars=1).select("place.id", "place.line_no", "first.id", "first.line_no", "copies", "n_links", "kept").collect()
    want = short_line_truth(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    for low, high in ((10, 20), (20, 30)):
        near = [w for w, line in zip(want, [x.strip("\t\v\f\r ") for _, t in ordered(rows) for x in (t or "").split("\n") if x.strip("\t\v\f\r ")]) if low <= len(line) < high and w[5]]
        assert near and not all(w[6] for w in near)
    left = line_dedup.drop_lines(docs).collect()
    stays = [x.strip("\t\v\f\r ") for r in left for x in (r.text or "").split("\n")]
    assert sum(bool(x) for x in stays) == sum(w[6] for w in want) and stays.count("}") == 1
    assert {100, 101} <= {r.doc_id for r in left} and 102 not in {r.doc_id for r in left}


def test_hot_segment(spark, tmp_path):
    """Hundreds of lines share a segment; pairs are also found where only probes meet the index."""
    rng = random.Random(4)
    head = words(rng, 6)[:24]
    rows = [(i, "\n".join(head + f"{rng.randrange(10**6):06d}" + "q" * 14 for _ in range(10))) for i in range(40)]
    rows += [(200 + i, t) for i, t in enumerate(["ab" + head + "xyz" * 6, "b" + head + "xyz" * 6, "a" + head + "xyz" * 6 + "é", head + "xyz" * 6])]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = line_dedup.judged_lines(spark.read.parquet(str(tmp_path / "d")))
    got = got.select("place.id", "place.line_no", "first.id", "first.line_no", "copies", "n_links", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(short_line_truth(rows), key=repr)


def test_many_lines_in_a_document(spark, tmp_path):
    lines = [hashlib.md5(str(i % 20_000).encode()).hexdigest() for i in range(40_000)]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    left = line_dedup.drop_lines(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert [r.text for r in left] == ["\n".join(lines[:20_000])]


def passage_truth(texts, size):
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - size + 1):
            seen[t[i : i + size]] += 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append((bytes(b for b, g in zip(t, gone) if not g), len(re.findall(rb"\x01+", bytes(gone)))))
    return out


def test_passages_odd(odd, nothing):
    docs = odd.filter("doc_id is null or doc_id not in (9, 10)")
    rows = docs.collect()
    for size, span in ((200, 120), (40, 20)):
        got = suffix_dedup.drop_repeats(docs, passage=size, span=span).collect()
        want = passage_truth([(r.text or "").encode() for r in rows], size)
        assert sorted((repr(r.text), bytes(r.kept), len(r.spans)) for r in got) == sorted((repr(r.text), *w) for r, w in zip(rows, want))
    assert suffix_dedup.drop_repeats(nothing).collect() == []
    text = suffix_dedup.drop_repeats(docs, as_text=True)
    assert set(text.columns) == set(odd.columns) and dict(text.dtypes)["kept"] == "string"


@pytest.mark.parametrize("seed", range(3))
def test_passages_spliced(spark, tmp_path, seed):
    """Texts made of shared pieces, with edits, in several tasks."""
    rng = random.Random(seed)
    pieces = [words(rng, rng.randint(5, 60)) for _ in range(12)]
    texts = []
    for _ in range(40):
        t = " ".join(rng.choice(pieces) if rng.random() < 0.5 else words(rng, 20) for _ in range(rng.randint(1, 6)))
        texts.append(t.replace("ab", "aß", 1) if rng.random() < 0.3 else t)
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = suffix_dedup.drop_repeats(spark.read.parquet(str(tmp_path / "d")), keep=["doc_id"]).collect()
    want = passage_truth([t.encode() for t in texts], 200)
    assert {r.doc_id: (bytes(r.kept), len(r.spans)) for r in got} == dict(enumerate(want))


def test_parts_of_suffixes_are_small():
    """A part's suffixes are a few MB, and its blobs are views of the batch they came in."""
    assert suffix_dedup.PART_ROWS * suffix_dedup.SUFFIX.itemsize <= 8 << 20
    values = np.zeros(50_000, suffix_dedup.SUFFIX)
    values["w1"] = np.arange(50_000) // 2 * 7
    values["row"], values["start"] = np.arange(50_000) % 11, np.arange(50_000)
    half = lambda v: b"".join(v[c].tobytes() for c in v.dtype.names)
    batch = pa.RecordBatch.from_arrays([pa.array([3, 3, 4]), pa.array([False, False, False]), pa.array([half(values[:25_000]), half(values[25_000:49_999]), half(values[49_999:])], pa.binary())], names=["part", "known", "blob"])
    data = batch.column(2).buffers()[2]
    parts = list(suffix_dedup._by_part(iter([batch])))
    assert [(p, len(k), len(b)) for p, k, b in parts] == [(3, 0, 2), (4, 0, 1)]
    assert all(data.address <= b.address and b.address + b.size <= data.address + data.size for _, _, blobs in parts for b in blobs)
    found = [b for out in suffix_dedup._judged(5)(iter([batch])) for b in out.column(2).to_pylist()]
    assert sum(len(b) for b in found) == 49_998 * suffix_dedup.PLACE.itemsize


def test_passages_of_long_texts(spark, tmp_path):
    rng = random.Random(9)
    long = words(rng, 3000)
    rows = [(0, long), (1, "other " + long[700:9000]), (2, words(rng, 400))]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = suffix_dedup.drop_repeats(spark.read.parquet(str(tmp_path / "d")), keep=["doc_id"]).collect()
    assert {r.doc_id: (bytes(r.kept), len(r.spans)) for r in got} == dict(enumerate(passage_truth([t.encode() for _, t in rows], 200)))


def grams(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar_truth(rows):
    rows = ordered(rows)
    sets = [grams(t) for _, t in rows]
    classes = {}
    for k, s in enumerate(sets):
        classes.setdefault(s if s else k, []).append(k)
    heads = [v[0] for v in classes.values()]
    links = {(a, b) for a in heads for b in heads if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    root = {h: h for h in heads}
    for _ in heads:
        for a, b in links:
            root[a] = min(root[a], root[b])
    out = []
    for v in classes.values():
        for k in v:
            h = v[0]
            out.append((rows[k][0], rows[h][0], len(v), sum(a == h for a, _ in links), rows[root[h]][0], root[h] == k))
    return out


def test_similar(spark, tmp_path, odd, nothing):
    rng = random.Random(4)
    bases = [words(rng, 100) for _ in range(5)]

    def touched(text):
        w = text.split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "changed"
        return " ".join(w)

    rows = [(i, touched(rng.choice(bases)) if i % 4 else words(rng, 50)) for i in range(160)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    columns = ["doc_id", "class_id", "copies", "n_links", "group_id", "kept"]
    for docs, plain in ((spark.read.parquet(str(tmp_path / "d")), rows), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        got = jaccard.similar_documents(docs).select(*columns).collect()
        want = similar_truth(plain)
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        assert jaccard.drop_similar(docs).count() == sum(w[5] for w in want)
    assert jaccard.drop_similar(odd).columns == odd.columns
    assert jaccard.similar_documents(nothing).collect() == []


def test_components_of_chains(spark):
    rng = random.Random(2)
    nodes = list(range(300))
    rng.shuffle(nodes)
    edges = [(a, b) for a, b in zip(nodes, nodes[1:]) if nodes.index(a) % 100 != 99]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    for at in range(0, 300, 100):
        assert {got[n] for n in nodes[at : at + 100]} == {min(nodes[at : at + 100])}


def test_banding():
    bands, rows = jaccard.bands_for(0.8)
    assert bands * rows <= jaccard.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL


def test_sieve_loses_no_partner(spark):
    from plaintide.llm.common import sieve

    rows, keys = spark.range(2000).withColumnRenamed("id", "k"), spark.range(0, 2000, 7).withColumnRenamed("id", "k")
    got = {r.k: r._maybe for r in sieve(rows, keys, "k").collect()}
    assert len(got) == 2000 and all(got[k] for k in range(0, 2000, 7)) and sum(got.values()) < 320
    assert not any(r._maybe for r in sieve(rows, keys.filter("k < 0"), "k").collect())


def test_a_worker_remembers_for_one_operator(monkeypatch):
    from plaintide.llm import common

    monkeypatch.setattr(common, "_remembered", {})
    first = common.worker_memory(("packing", "a"), dict)
    assert common.worker_memory(("packing", "a"), list) is first
    common.worker_memory(("toxicity",), dict)
    assert list(common._remembered) == [("toxicity",)] and common.worker_memory(("packing", "a"), list) is not first
