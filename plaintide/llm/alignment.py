"""Alignment of two tokenizers over the distinct texts of a corpus.

Documents are shuffled by full text, so each distinct text is encoded and aligned once and
counts with its number of copies.  Where tokens of both sides end at one byte they are
linked; the corpus-wide counts of linked id pairs then give each text its measures, and
those go to all its documents.

Both tokenizers part a text before a blank that follows something else than a blank and
precedes something else than white space (``parts_at_blanks`` checks it of the files), so the
alignment of a text is that of its chunks, and a task aligns each distinct chunk once.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaintide.llm.common import fresh, sieve, written

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BLANK = "▁"  # stands for a blank in pieces
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
ROOM_CHUNKS, ROOM_CHARS = 400_000, 8_000_000  # distinct chunks that a task remembers, and their characters
AT_ONCE = 400_000  # characters of texts that are put together at a time
HOT_PAIRS = 1 << 16


def byte_of_letter() -> dict[str, int]:
    """The byte that a letter of a byte-level vocabulary stands for: printable ones are themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """The two tokenizers with the bytes and the spelt number of every id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = byte_of_letter()
        entries = {i: e for e, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [bytes(letters[c] for c in entries.get(i, "")) for i in range(max(entries, default=-1) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes.fromhex(p[3:5]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.alone = not parts_at_blanks(a_path, pieces)
        spelt = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], object)
        self.inner = spelt(max(len(self.bytes_a), len(pieces)), ",")
        self.last_a, self.last_b = spelt(len(self.bytes_a), "|"), spelt(len(pieces), ";")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in a], self.b.encode(texts, num_threads=1)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the tokens that end together, on both sides, their last byte and the spelt tokens in order."""
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        place = np.searchsorted(ends_b, ends_a)
        at_a = np.flatnonzero(ends_b[np.minimum(place, len(b) - 1)] == ends_a)
        at_b = place[at_a]
        spelt = np.empty(len(a) + len(b), object)
        group_a, group_b = np.searchsorted(at_a, np.arange(len(a))), np.searchsorted(at_b, np.arange(len(b)))
        words_a, words_b = self.inner[a], self.inner[b]
        words_a[at_a], words_b[at_b] = self.last_a[a[at_a]], self.last_b[b[at_b]]
        spelt[np.arange(len(a)) + np.concatenate([[0], at_b + 1])[group_a]] = words_a
        spelt[np.arange(len(b)) + (at_a + 1)[group_b]] = words_b
        return at_a, at_b, ends_a[at_a], spelt

    def same(self, a: Sequence[int], b: Sequence[int], text: str) -> bool:
        """Do the bytes of both sides spell the blank and the text?"""
        want = b" " + text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want


def parts_at_blanks(a_path: str, pieces: Sequence[str]) -> bool:
    """May texts be cut at ``CUT``: byte-level words on one side, blanks only at the front of pieces on the other?"""
    with open(a_path, encoding="utf-8") as file:
        parts = json.load(file)
    cut = parts.get("pre_tokenizer") or {}
    plain = parts.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    return plain and not any(BLANK in p.lstrip(BLANK) for p in pieces)


@functools.lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, each without the blank before it."""
    chunks = text.split(" ")
    if all(chunks) and not any(c[0].isspace() for c in chunks):
        return chunks
    chunks = CUT.split(" " + text)
    chunks[0] = chunks[0][1:]
    return chunks


class Aligned:
    """Alignments of distinct chunks: token and link counts, linked pairs, spelt groups."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.known: defaultdict = defaultdict()
        self.known.default_factory = self.known.__len__
        self.spelt: list[str | None] = []  # None: the bytes of a side differ
        self.counts = np.zeros((0, 3), np.int64)  # tokens of both sides, links
        self.links = np.zeros((0, 2), np.uint32)
        self.chars = 0

    def _joined(self, chunks: list[str]) -> list[tuple]:
        """Alignments of chunks that are encoded as one text."""
        text = " ".join(chunks)
        (a,), (b,) = self.pair.encode([text])
        if not self.pair.same(a, b, text):
            return [self._whole(c) for c in chunks] if len(chunks) > 1 else [(None, (0, 0, 0), np.zeros((0, 2), np.uint32))]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        at_a, at_b, ends, spelt = self.pair.groups(a, b)
        last = np.searchsorted(ends, np.cumsum([len(c.encode()) + 1 for c in chunks]))  # a chunk's last link
        counts = np.diff(np.stack([at_a[last], at_b[last], last], 1) + 1, axis=0, prepend=0)
        links = np.stack([a[at_a], b[at_b]], 1).astype(np.uint32)
        stops = np.cumsum(counts[:, 0] + counts[:, 1]).tolist()
        links = np.split(links, np.cumsum(counts[:-1, 2]))
        return [("".join(spelt[i:j])[:-1], c, x) for i, j, c, x in zip([0, *stops], stops, counts.tolist(), links)]

    def _whole(self, chunk: str) -> tuple:
        return self._joined([chunk])[0]

    def learn(self) -> None:
        """Align the chunks that were numbered since."""
        new = list(islice(self.known, len(self.spelt), None))
        if not new:
            return
        self.chars += sum(map(len, new))
        odd = [self.pair.alone or not c or c[0].isspace() or c[-1] == " " for c in new]
        plain, found = [c for c, x in zip(new, odd) if not x], []
        at = 0
        while at < len(plain):
            stop, chars = at, 0
            while stop < len(plain) and stop - at < 500 and chars < 20_000:
                chars += len(plain[stop])
                stop += 1
            found += self._joined(plain[at:stop])
            at = stop
        plain = iter(found)
        found = [self._whole(c) if x else next(plain) for c, x in zip(new, odd)]
        self.spelt += [f[0] for f in found]
        self.counts = np.concatenate([self.counts, np.array([f[1] for f in found], np.int64)])
        self.links = np.concatenate([self.links, *[f[2] for f in found]])

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """Per text: tokens of both sides, groups, the digest of the groups, its links as rows of two ids."""
        numbers = [[self.known[c] for c in ([t] if self.pair.alone else chunks_of(t))] for t in texts]
        self.learn()
        first = np.cumsum(self.counts[:, 2]) - self.counts[:, 2]
        for text, of in zip(texts, numbers):
            spelt = [self.spelt[k] for k in of]
            if None in spelt:  # one chunk differs; the whole text decides
                whole, (n_a, n_b, n), links = self._whole(text)
                yield n_a, n_b, n, whole and hashlib.sha256(whole.encode()).hexdigest() or "", links
                continue
            counts = self.counts[of]
            n_a, n_b, n = counts.sum(0).tolist()
            ends = np.cumsum(counts[:, 2])
            links = self.links[np.repeat(first[of] - ends + counts[:, 2], counts[:, 2]) + np.arange(n)]
            yield n_a, n_b, n, hashlib.sha256(";".join(spelt).encode()).hexdigest(), links
        if len(self.known) > ROOM_CHUNKS or self.chars > ROOM_CHARS:
            self.clear()


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``AT_ONCE`` characters of a text column."""
    start = chars = 0
    for i, t in enumerate(batch.column(column)):
        chars += len(t.as_py())
        if chars >= AT_ONCE:
            yield batch.slice(start, i + 1 - start)
            start, chars = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def align_distinct(texts: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE) -> DataFrame:
    """Each row of (text, copies, name) aligned: copies, name, n_a, n_b, n_groups, groups_sha256, pairs, times, shared.

    ``pairs`` holds the distinct linked pairs as 64-bit ids ``a * 2**32 + b``, ``times`` how often each is
    linked in the text, ``shared`` the text where it has several copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = Aligned(tokenizers(a, b))
        for whole in batches:
            for batch in _batches(whole, 0):
                texts, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = list(aligned.texts(texts))
                pairs, times = zip(*(np.unique((x[4][:, 0].astype(np.int64) << 32) | x[4][:, 1], return_counts=True) for x in out))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1), batch.column(2), *[pa.array([x[i] for x in out], pa.int64()) for i in range(3)], pa.array([x[3] for x in out], pa.string()),
                        pa.array([p.astype("<i8").tobytes() for p in pairs], pa.binary()), pa.array([t.astype("<u4").tobytes() for t in times], pa.binary()),
                        pa.array([t if c > 1 else None for t, c in zip(texts, copies)], pa.string()),
                    ],
                    names=["copies", "name", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times", "shared"],
                )

    return texts.select("text", "copies", "name").mapInArrow(
        run, "copies bigint, name bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs binary, times binary, shared string"
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair over all copies; is it the most frequent one of its second id?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            seen, of = np.unique(np.concatenate(pairs), return_inverse=True)
            sums = np.zeros(len(seen), np.int64)
            np.add.at(sums, of, np.concatenate(counts))
            return seen, sums

        for batch in batches:
            for copies, p, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                pairs.append(np.frombuffer(p, "<i8"))
                counts.append(np.frombuffer(t, "<u4").astype(np.int64) * copies)
                held += len(pairs[-1])
                if held > 2_000_000:
                    seen, sums = merged()
                    pairs, counts, held = [seen], [sums], len(seen)
                    if held > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums)], names=["pair", "n"])
                        pairs, counts, held = [], [], 0
        if pairs:
            seen, sums = merged()
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums)], names=["pair", "n"])

    linked = aligned.filter("n_groups > 0").select("copies", "pairs", "times")
    counts = written(linked.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, room: int) -> int:
    """The least power of two that at most ``room`` pairs reach."""
    sizes = counts.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("size")).count().collect()
    floor, seen = 64, 0
    for size, n in sorted(((r["size"], r["count"]) for r in sizes), reverse=True):
        seen += n
        if seen > room:
            break
        floor = size
    return 1 << min(floor, 62)


def measures(aligned: DataFrame, counts: DataFrame, hot: int = HOT_PAIRS) -> DataFrame:
    """(name, n_best, count_sum) of each text with tokens.

    At most ``hot`` pairs, the most frequent ones, are broadcast and looked up where the texts are;
    they hold most links, and no pair that is left is hot.  The others are joined by pair.
    """
    floor = _frequent(counts, hot)
    table = counts.filter(F.col("n") >= floor).orderBy("pair").toPandas()
    known = counts.sparkSession.sparkContext.broadcast(
        (table.pair.to_numpy(np.int64), table.n.to_numpy(np.int64), table.best.to_numpy(bool))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = [(np.frombuffer(p, "<i8"), np.frombuffer(t, "<u4").astype(np.int64)) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                of = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
                pair, times = np.concatenate([p for p, _ in rows]), np.concatenate([t for _, t in rows])
                place = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
                hit = pairs[place] == pair if len(pairs) else np.zeros(len(pair), bool)
                n_best, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                np.add.at(total, of[hit], times[hit] * n[place[hit]])
                np.add.at(n_best, of[hit], times[hit] * best[place[hit]])
                rest = np.concatenate([[0], np.cumsum(np.bincount(of[~hit], minlength=len(rows)))])
                left = pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.StructArray.from_arrays([pa.array(pair[~hit]), pa.array(times[~hit])], ["pair", "times"]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_best), pa.array(total), left], names=["name", "n_best", "count_sum", "rest"])

    linked = aligned.filter("n_groups > 0").select("name", "pairs", "times")
    found = written(linked.mapInArrow(run, "name bigint, n_best bigint, count_sum bigint, rest array<struct<pair:bigint,times:bigint>>"))
    rest = found.select("name", F.inline("rest")).join(counts.filter(F.col("n") < floor), "pair")
    rest = rest.groupBy("name").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    return found.join(rest, "name", "left").select(
        "name", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum")
    )


def align(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", a: str = BYTE_BPE, b: str = PIECE_BPE, hot: int = HOT_PAIRS) -> DataFrame:
    """``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    A null or empty text, and one that either tokenizer doesn't spell back byte by byte, has no
    tokens: zeros and an empty digest.  Repeated rows count each time in the pair counts and
    have one row each; null ids are carried.  Kept columns called like a new one are replaced; other
    columns don't matter; an empty table gives no rows.  No token is empty, so one pair ends at each
    common byte and there are as many links as groups.
    """
    added = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    keep = [c for c in keep if c.lower() not in added]
    kept = {c: f"_keep_{i}" for i, c in enumerate(keep)}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(c).alias(n) for c, n in kept.items()], F.col(text).alias("text"))
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("name"))
    aligned = written(align_distinct(texts, a, b))
    counts = written(pair_counts(aligned))
    found = aligned.drop("copies", "pairs", "times", "shared").join(measures(aligned, counts, hot), "name", "left")
    several = aligned.filter("copies > 1").select(F.col("shared").alias("text"), "name")
    marked = sieve(rows, several, "text")
    single = marked.filter("not _maybe").select(*kept.values(), F.col("row").alias("name"))
    joined = marked.filter("_maybe").join(several, "text", "left").select(*kept.values(), F.coalesce("name", "row").alias("name"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return single.unionByName(joined).join(found, "name", "left").select(
        *[F.col(n).alias(c) for c, n in kept.items()], zero("n_a"), zero("n_b"), zero("n_groups"), F.coalesce("n_groups", F.lit(0)).cast("bigint").alias("n_links"),
        zero("n_best"), zero("count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
