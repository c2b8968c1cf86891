"""Ranked lexical search: one automaton of all item terms reads every document.

The terms of the items become one Aho-Corasick automaton whose words have a blank on both
sides as guards.  A document is folded to one byte per step (separators become blanks,
A-Z lower case, bytes of other characters stay), so a match is a whole term, and term
frequencies are counted while the text is read: no index of documents is built.  Each task
keeps the best documents of every item; the few that are left are ranked by Spark.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from plaintide.llm.common import written

#: All that isn't a digit, a letter of ASCII or a character beyond ASCII parts terms.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or bytes((c,)).isalnum() else 32 for c in range(256))
BLOCK_BYTES = 8_000_000  # of the terms of the items that one automaton holds
CELLS = 1 << 20  # scores, or shares of scores, held at a time
SLICES = 64


def folded(text: str) -> str:
    """The terms of a text with a blank before, between and behind them, a character per byte."""
    return b" ".join([b"", *text.encode().translate(FOLD).split(), b""]).decode("latin-1")


def terms(text: Column) -> Column:
    """All terms of a text, with repeats; null has none."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lower, F.lit("")), SEPARATORS), lambda t: t != "")


def _item_blocks(items: DataFrame, item: str, text: str, block_bytes: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Items by number, their terms with repeats counted and the blocks they are dealt into.

    The bytes of every block are added up and blocks are made smaller until none holds more than
    four times ``block_bytes``, unless a single item does.
    """
    numbered = written(items.select(F.monotonically_increasing_id().alias("row"), F.col(item).alias("item_id"), F.col(text).alias("text")))
    found = numbered.select("row", F.explode(terms(F.col("text"))).alias("term")).groupBy("row", "term").agg(F.count(F.lit(1)).alias("times"))
    found = written(found)
    sizes = written(found.groupBy("row").agg(F.sum(F.octet_length("term") + 16).alias("bytes")))
    whole, largest, n = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    dealt = max(1, min(n, -(-whole // block_bytes)))
    while True:
        block = F.pmod(F.xxhash64("row"), F.lit(dealt)).alias("block")
        blocks = [(r["block"], r["bytes"]) for r in sizes.groupBy(block).agg(F.sum("bytes").alias("bytes")).collect()]
        if max((size for _, size in blocks), default=0) <= max(4 * block_bytes, largest):
            return numbered.drop("text"), found.withColumn("block", block), sorted(b for b, _ in blocks)
        dealt *= 2


def _scan(docs: DataFrame, words) -> DataFrame:
    """(doc_id, n, terms, times) of each document: its length in terms, and how often it has which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, w in enumerate(words.value):
            automaton.add_word(f" {w.encode().decode('latin-1')} ", k)
        automaton.make_automaton()
        find, number = automaton.iter if words.value else lambda text: (), itemgetter(1)
        for batch in batches:
            sizes, which, times = [], [], []
            for value in batch.column(1):
                text = folded(value.as_py())
                found = Counter(map(number, find(text)))
                sizes.append(text.count(" ") - 1 if len(text) > 2 else 0)
                which.append(np.fromiter(found.keys(), "<u4", len(found)).tobytes())
                times.append(np.fromiter(found.values(), "<u4", len(found)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(which, pa.binary()), pa.array(times, pa.binary())], names=["doc_id", "n", "terms", "times"]
            )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms binary, times binary")


def _document_frequencies(counted: DataFrame, n_terms: int) -> DataFrame:
    """(term, df), added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for value in batch.column(0):
                df[np.frombuffer(value.as_buffer(), "<u4")] += 1  # a document names a term once
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], names=["term", "df"])

    return counted.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


class Best:
    """The ``k`` best documents of each item so far: by score, then id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.id, self.null = np.zeros(0, np.int64), np.zeros(0, bool)
        self.least = np.zeros(items, np.int64)  # the k-th best score, 0 while there are fewer

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """``scores`` has a row per document and a column per item."""
        doc, item = np.nonzero((scores > 0) & (scores >= self.least))
        if not len(doc):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[doc, item]])
        id_, null = np.concatenate([self.id, ids[doc]]), np.concatenate([self.null, nulls[doc]])
        order = np.lexsort([id_, null, -score, item])
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        stays = order[place < self.k]
        self.item, self.score, self.id, self.null = item[place < self.k], score[stays], id_[stays], null[stays]
        last = order[place == self.k - 1]
        self.least[item[place == self.k - 1]] = score[last]


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1)))"""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _ranked(counted: DataFrame, model, k: int) -> DataFrame:
    """(row, slice, doc_id, score): the best documents of each item that a task has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, first, sizes, of_item, repeats, rows, n_docs, all_terms = model.value
        best = Best(len(rows), k)
        docs_at_once = max(1, CELLS // max(1, len(rows)))
        for batch in batches:
            ids = batch.column(0)
            nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            which = [np.frombuffer(v.as_buffer(), "<u4") for v in batch.column(2)]
            times = [np.frombuffer(v.as_buffer(), "<u4") for v in batch.column(3)]
            shares = np.array([int(sizes[w].sum()) for w in which])
            m = np.array([75 + 25 * n * n_docs // all_terms if all_terms else 100 for n in batch.column(1).to_pylist()], np.int64)
            at = 0
            while at < len(which):
                take = max(1, min(docs_at_once, int(np.searchsorted(np.cumsum(shares[at:]), CELLS))))
                part = slice(at, at + take)
                doc = np.repeat(np.arange(len(which[part])), [len(w) for w in which[part]])
                term, tf = np.concatenate(which[part]), np.concatenate(times[part]).astype(np.int64)
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[part][doc]))
                scores = np.zeros((len(which[part]), len(rows)), np.int64)
                post = _spread(first[term], sizes[term])
                np.add.at(scores.reshape(-1), np.repeat(doc, sizes[term]) * len(rows) + of_item[post], np.repeat(value, sizes[term]) * repeats[post])
                best.add(scores, ids[part], nulls[part])
                at += take
        slice_ = np.full(len(best.item), TaskContext.get().partitionId() % SLICES)
        out = [pa.array(rows[best.item]), pa.array(slice_), pa.array(best.id, mask=best.null), pa.array(best.score)]
        yield pa.RecordBatch.from_arrays(out, names=["row", "slice", "doc_id", "score"])

    return counted.mapInArrow(run, "row bigint, slice bigint, doc_id bigint, score bigint")


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents that score highest for each item.

    Terms are runs of digits, ASCII letters in lower case and characters beyond ASCII; a null text has
    none.  Equal scores go by ascending id, null ids last.  Items and documents count by row, so
    repeated rows rank each; an item without terms, or that no document shares a term with, has no
    rows, and neither has an empty table.  ``doc`` is a whole number.  Other columns don't matter.

    Items are dealt into blocks of about ``block_bytes``, each broadcast and read past all documents,
    so what is broadcast is bounded for any number of items.  ``docs`` is read once for each block.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered, found, blocks = _item_blocks(items, item, item_text, block_bytes)
    ranked = None
    for block in blocks or [0]:
        table = found.filter(F.col("block") == block).orderBy("term", "row").select("term", "row", "times").toPandas()
        words, of_term = _numbered(table.term.tolist())
        numbers, of_item = np.unique(table.row.to_numpy(np.int64), return_inverse=True)
        counted = written(_scan(rows, spark.sparkContext.broadcast(words)))
        n_docs, all_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(words), np.int64)
        for r in _document_frequencies(counted, len(words)).collect():
            df[r.term] = r.df
        sizes = np.bincount(of_term, minlength=len(words)).astype(np.int64)
        model = (weights(df, n_docs), np.cumsum(sizes) - sizes, sizes, of_item, table.times.to_numpy(np.int64), numbers, n_docs, all_terms)
        part = _ranked(counted.filter(F.octet_length("terms") > 0), spark.sparkContext.broadcast(model), k)
        ranked = part if ranked is None else ranked.unionByName(part)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = Window.partitionBy("row", "slice").orderBy(*best)  # the tasks' lists first, in slices
    ranked = ranked.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*best))).filter(F.col("rank") <= k)
    return ranked.join(numbered, "row").select("item_id", "rank", "doc_id", "score")


def _numbered(sorted_terms: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct terms and, for each place of the list, the number of its term."""
    number = {t: k for k, t in enumerate(dict.fromkeys(sorted_terms))}
    return list(number), np.array([number[t] for t in sorted_terms], np.int64)
