"""N-gram Jaccard join by MinHash banding.

Documents with the same set of word n-grams form a class; everything after that works on
classes.  The numbers of bands and rows follow from the recall asked for at the
threshold.  Classes that meet in a bucket are candidates.  They are verified on their full
sets: sets travel to pairs of blocks of similar classes, where all pairs are compared at
once and links are counted.  A group of many near copies moves its sets a few times, not
once per pair, and no table holds its pairs.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from plaintide.llm.common import fresh, row_texts, sieve, written

N = 5
THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 128
BLOCK = 512  # classes that are compared with as many others at a time
BLOCK_GRAMS = 1 << 20
WORDS_KEPT = 250_000
MIX = np.uint64(0x9E3779B97F4A7C15)
SKETCH = "row bigint, size int, c1 bigint, c2 bigint, bands array<bigint>"


def bands_for(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows with which ``most`` hashes still find a pair at the threshold with this recall."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall; allow more hashes")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Texts to sorted arrays of the 64-bit names of their distinct word n-grams."""

    def __init__(self, n: int):
        self.n = n
        self.factors = _mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
        self._clear()

    def _clear(self) -> None:
        self.known: defaultdict = defaultdict()
        self.known.default_factory = self.known.__len__
        self.hashes = np.zeros(0, np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        if len(self.known) > WORDS_KEPT:
            self._clear()
        words = text.split()
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        missing = len(self.known) - len(self.hashes)
        if missing:
            back = reversed(self.known)
            new = [xxhash.xxh64_intdigest(next(back)) for _ in range(missing)][::-1]
            self.hashes = np.concatenate([self.hashes, np.array(new, np.uint64)]) if missing > 1000 else np.append(self.hashes, np.array(new, np.uint64))
        h = self.hashes[numbers]
        if len(h) < self.n:  # a short text is one gram
            return _mixed((h * self.factors[: len(h)]).sum(keepdims=True) + np.uint64(len(h))) if len(h) else h
        grams = sum(h[i : len(h) - self.n + 1 + i] * self.factors[i] for i in range(self.n))
        return np.unique(_mixed(grams))


class MinHash:
    """Band keys of a set."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(97)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**64, bands * rows, np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**64, bands * rows, np.uint64)
        self.factors = rng.integers(0, 2**64, rows, np.uint64) | np.uint64(1)
        self.salt = rng.integers(0, 2**64, bands, np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 2**64 - 1, np.uint64)
        for at in range(0, len(grams), 1024):
            np.minimum(least, (np.multiply.outer(self.a, grams[at : at + 1024]) + self.b[:, None]).min(1), out=least)
        return _mixed((least.reshape(self.bands, self.rows) * self.factors).sum(1) ^ self.salt)


def sketches(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(row, size, c1, c2, bands) of (row, text): c1, c2 name the set; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, minhash = Shingles(n), MinHash(bands, rows)
        for batch in batches:
            size, c1, c2, keys = [], [], [], []
            for text in batch.column(1):
                grams = shingles(text.as_py())
                size.append(len(grams))
                c1.append(grams.sum())
                c2.append(_mixed(grams ^ MIX).sum())
                keys.append(minhash(grams) if len(grams) else grams)
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)))
            names = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (c1, c2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), *names, lists], names=["row", "size", "c1", "c2", "bands"])

    return texts.mapInArrow(run, SKETCH)


def _labelled(classes: DataFrame) -> DataFrame:
    """(cls, size, keys, label) of classes that share a bucket with another.

    ``label`` is a class few buckets away that similar classes have in common: each takes
    the smallest class of its buckets, twice.
    """
    same = Window.partitionBy("key")
    met = classes.select("cls", "size", F.explode("bands").alias("key"))
    met = met.withColumns({"label": F.min("cls").over(same), "last": F.max("cls").over(same)}).filter(F.col("label") < F.col("last"))
    members = written(met.groupBy("cls", "size").agg(F.collect_list("key").alias("keys"), F.min("label").alias("label")))
    again = members.select("cls", F.explode("keys").alias("key"), "label").withColumn("label", F.min("label").over(same))
    return members.drop("label").join(again.groupBy("cls").agg(F.min("label").alias("label")), "cls")


def _placed(members: DataFrame) -> DataFrame:
    """(cls, places): the pairs of blocks in which each class is compared.

    Classes of one label are dealt into blocks of bounded size.  Two blocks are compared
    when a bucket has classes of both; every pair of classes has one place.
    """
    sums = members.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_GRAMS)).alias("parts"))
    blocks = members.join(sums, "label").select("cls", "keys", F.struct("label", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part")).alias("block"))
    blocks = written(blocks)
    touched = blocks.select(F.explode("keys").alias("key"), "block").distinct()
    a, b = touched.alias("a"), touched.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.block") <= F.col("b.block")))
    pairs = pairs.select(F.col("a.block").alias("one"), F.col("b.block").alias("two")).distinct()
    place = F.struct("one", "two").cast("string").alias("place")
    sides = pairs.select(F.col("one").alias("block"), F.struct(place, F.lit(0).alias("side")).alias("at"))
    sides = sides.union(pairs.filter(F.col("one") != F.col("two")).select("two", F.struct(place, F.lit(1).alias("side"))))
    return blocks.join(sides.groupBy("block").agg(F.collect_list("at").alias("places")), "block").select("cls", "places")


def shared_grams(one: list[np.ndarray], two: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of ``one`` with all of ``two``, exactly.

    Only grams that both sides have count, ``width`` of them at a time as columns of 0 and 1.
    """
    sizes = [np.array([len(x) for x in side]) for side in (one, two)]
    flat = [np.concatenate(side) for side in (one, two)]
    common = np.intersect1d(*flat)
    rows, columns = [], []
    for grams, size in zip(flat, sizes):
        at = np.minimum(np.searchsorted(common, grams), max(len(common) - 1, 0))
        hit = common[at] == grams if len(common) else np.zeros(len(grams), bool)
        rows.append(np.repeat(np.arange(len(size)), size)[hit])
        columns.append(at[hit])
    out = np.zeros((len(one), len(two)), np.float32)
    for start in range(0, len(common), width):
        tables = []
        for k in range(2):
            table = np.zeros((len(sizes[k]), min(width, len(common) - start)), np.float32)
            own = (columns[k] >= start) & (columns[k] < start + width)
            table[rows[k][own], columns[k][own] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


def _links(place: list[dict[int, np.ndarray]], threshold: float) -> list[tuple[int, int, int]]:
    """(cls, number of links, smallest class connected here) of the linked classes of a place."""
    sides = [sorted(p.items()) for p in (place if place[1] else place[:1] * 2)]
    ids = [np.array([c for c, _ in side]) for side in sides]
    sizes = [np.array([len(x) for _, x in side]) for side in sides]
    both = shared_grams(*[[x for _, x in side] for side in sides])
    near = both >= threshold * (sizes[0][:, None] + sizes[1][None] - both)
    near &= ids[0][:, None] != ids[1][None]
    roots = [i.copy() for i in ids]
    far = np.iinfo(np.int64).max
    while True:
        left = np.minimum(roots[0], np.where(near, roots[1][None], far).min(1))
        right = np.minimum(roots[1], np.where(near, left[:, None], far).min(0))
        if (left == roots[0]).all() and (right == roots[1]).all():
            break
        roots = [left, right] if place[1] else [np.minimum(left, right)] * 2
    counts = [near.sum(1), near.sum(0)]
    return [(int(c), int(n), int(r)) for k in range(2 if place[1] else 1) for c, n, r in zip(ids[k], counts[k], roots[k]) if n]


def _verified(texts: DataFrame, placed: DataFrame, n: int, threshold: float) -> DataFrame:
    """(cls, n, root) of linked classes, for each place: all pairs of its two blocks, on full sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in batches:
            grams = pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), grams], names=["cls", "places", "grams"])

    wanted = placed.withColumnRenamed("cls", "row")
    found = sieve(texts, wanted, "row").filter("_maybe").join(wanted, "row").select("row", "text", "places")
    found = found.mapInArrow(sets, "cls bigint, places array<struct<place:string,side:int>>, grams binary")
    rows = found.select("cls", F.explode("places").alias("at"), "grams").select("at.place", "at.side", "cls", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, [{}, {}]
        for batch in batches:
            out = []
            for place, side, cls, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if place != here:
                    out += _links(held, threshold) if held[0] else []
                    here, held = place, [{}, {}]
                held[side][cls] = np.frombuffer(grams.as_py(), np.uint64)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["cls", "n", "root"])
        if out := _links(held, threshold) if held[0] else []:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["cls", "n", "root"])

    return rows.repartition("place").sortWithinPartitions("place").mapInArrow(run, "cls bigint, n bigint, root bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (x, y): root is the smallest node it is connected with.

    Each round hangs the larger neighbours of a node, then the smaller ones and itself, on
    the smallest; rounds end when nothing moves.
    """
    now = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    now = written(now.filter(F.col("u") != F.col("v")))
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))
        now = written(hung.filter(F.col("u") != F.col("v")).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = state


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL,
) -> DataFrame:
    """One row per document: row, id, class_id, copies, n_links, group_id, kept.

    Words are runs between white space; a text of fewer than ``n`` words is one gram.  Texts
    without words (null, empty) are classes of their own without links.  ``class_id`` is the id
    of the first document with the same set of grams, ``copies`` how many have it, ``n_links``
    the number of other classes with Jaccard similarity of at least ``threshold``, found with
    probability ``recall`` at the threshold and more above it.  ``group_id`` is the id of the first
    document connected by links, and ``kept`` marks it.  First is the smallest id, null ids last,
    then the smallest row, so repeated rows are copies.  Extra columns don't matter; an empty
    table gives no rows.  ``docs`` must be a table, as its rows are numbered by position.
    """
    texts = row_texts(docs, text)
    sketch = written(sketches(texts, n, *bands_for(threshold, recall)))
    ids = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"))
    rows = sketch.select("row", "size", "c1", "c2").join(ids, "row")
    first = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    classes = written(rows.filter("size > 0").groupBy("size", "c1", "c2").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies")))
    heads = classes.select(F.col("first.row").alias("row")).join(sketch, "row").select(F.col("row").alias("cls"), "size", "bands")
    links = written(_verified(texts, _placed(_labelled(heads)), n, threshold))
    degree = links.groupBy("cls").agg(F.sum("n").alias("n_links"))
    # a component is headed by its first document, not by its smallest row
    member = components(links.select(F.col("cls").alias("x"), F.col("root").alias("y")))
    named = member.join(classes.select(F.col("first.row").alias("node"), "first"), "node")
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    groups = named.join(heads, "root").select(F.col("node").alias("cls"), "head")
    classes = classes.withColumn("cls", F.col("first.row")).join(degree, "cls", "left").join(groups, "cls", "left")
    out = rows.join(classes, ["size", "c1", "c2"], "left")
    alone = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    return out.withColumns({"own": F.coalesce("first", alone), "top": F.coalesce("head", "first", alone)}).select(
        "row", F.col("id").alias(id_col), F.col("own.id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("top.id").alias("group_id"), (F.col("top.row") == F.col("row")).alias("kept"),
    )


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of linked documents, all columns as they were."""
    (row,) = fresh(docs, "_row")
    stays = similar_documents(docs, id_col, text, **options).filter("kept").select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(stays, row, "left_semi").select(*docs.columns)
