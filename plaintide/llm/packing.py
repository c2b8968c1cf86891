"""Order-preserving packing into training sequences by dynamic programming.

Documents are laid end to end.  A window is cut where a document ends, where a sentence
ends, or, inside a sentence longer than a window, at fixed steps; the cuts that together
cost least are found.  A window costs its padding, a fixed amount, and a penalty for the
kind of cut that ends it.  As the padding grows by one for each token less, the best start
of a window is the front of a monotone queue over the last ``width`` tokens.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from plaintide.llm.common import worker_memory

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
STOPS = (".", "!", "?", "\n", "。", "！", "？", "…")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"  # a run of them behind letters is parted from these; an apostrophe needn't be
BETWEEN = "|"  # one token, which comes of no other text
LATIN = re.compile("[a-z\xdf-\xf6\xf8-\u024f]+").fullmatch  # letters that the tokenizer takes as they are, once folded
ROOM_CHUNKS, ROOM_PARTS = 1_600_000, 900_000  # distinct ones that a Python worker remembers
SENTENCE_END, HARD_CUT, WINDOW = 8.0, 64.0, 16.0  # costs in tokens of padding


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


@functools.lru_cache(maxsize=2)
def _word_tokenizer(path: str):
    """The tokenizer without its folding and splitting, for folded words between blanks, and which ids end a word.

    None where the file is of another kind.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    suffix = parts["model"].get("end_of_word_suffix")
    if parts["model"].get("type") != "BPE" or not suffix:
        return None
    parts |= {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]}}
    ends = np.zeros(max(parts["model"]["vocab"].values()) + 1, bool)
    ends[[i for t, i in parts["model"]["vocab"].items() if t.endswith(suffix)]] = True
    return Tokenizer.from_str(json.dumps(parts)), ends


def worker_chunks(path: str) -> Chunks:
    """The chunks of this Python worker, which the tasks that it runs one after the other share."""
    return worker_memory(("packing", path), lambda: Chunks(path))


def _numbers() -> defaultdict:
    """Numbers keys in the order in which they are first asked for."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def _pieces(chunk: str) -> tuple[str, ...]:
    """A chunk in parts that the tokenizer would part as well: letters, and marks behind them."""
    chunk = chunk.rstrip("\n")
    body = chunk.rstrip(MARKS)
    tail = chunk[len(body) :]
    # it folds case; this saves encoding both forms
    folded = body.lower() if body.isascii() else unicodedata.normalize("NFC", body).lower()
    if not folded.isalpha():
        return (chunk,)
    if LATIN(folded):
        body = folded
    return (body, tail) if tail else (body,)


class Chunks:
    """Token ids of runs between blanks; each part of one is encoded once while there is room.

    The tokenizer drops white space and nothing it does reaches over white space.  Parts are
    encoded many at a time: folded words by the merges alone, others with a token between them
    that none of them has.
    """

    def __init__(self, path: str, room: int = ROOM_CHUNKS, room_parts: int = ROOM_PARTS):
        self.tokenizer, self.words = _tokenizer(path), _word_tokenizer(path)
        self.room, self.room_parts = room, room_parts
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.clear_parts()
        self.clear()

    def clear(self) -> None:
        self.known = _numbers()
        self.ids, self.sizes, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)

    def clear_parts(self) -> None:
        self.parts = _numbers()
        self.part_ids, self.part_sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def make_room(self) -> None:
        """Forget what is beyond the bounds; chunk numbers given before are void then."""
        if len(self.known) > self.room:
            self.clear()
        if len(self.parts) > self.room_parts:
            self.clear_parts()

    def numbers(self, text: str) -> np.ndarray:
        pieces = text.replace("\n", "\n ").split(" ")
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Folded words, encoded many at a time; the last id of a word tells its end."""
        tokenizer, ends = self.words
        joined = [" ".join(words[i : i + 300]) for i in range(0, len(words), 300)]
        stream = np.fromiter(chain.from_iterable(e.ids for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)), np.uint32)
        return stream, np.diff(np.flatnonzero(ends[stream]), prepend=-1)

    def _encode_plain(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts without the mark between them."""
        joined = [f" {BETWEEN} ".join(parts[i : i + 200]) + f" {BETWEEN}" for i in range(0, len(parts), 200)]
        stream = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)), np.uint32)
        mark = stream == self.between[0]
        return stream[~mark], np.diff(np.flatnonzero(mark), prepend=-1) - 1

    def _encode_odd(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in parts]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(i) for i in ids], np.int64)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and how many each has."""
        kind = np.array([2 if BETWEEN in p else 0 if self.words and p.islower() and LATIN(p) else 1 for p in parts])
        ids, sizes, first, at = [], np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), 0
        for k, encode in enumerate((self._encode_words, self._encode_plain, self._encode_odd)):
            of = np.flatnonzero(kind == k)
            if len(of):
                stream, sizes[of] = encode([parts[i] for i in of.tolist()])
                first[of] = at + np.cumsum(sizes[of]) - sizes[of]
                ids.append(stream)
                at += len(stream)
        return np.concatenate(ids)[_spans(first, sizes)], sizes

    def look_up(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks, and of each its first place, its length, whether a sentence ends."""
        new = list(islice(self.known, len(self.sizes), None))
        if new:
            split = list(map(_pieces, new))
            counts = np.fromiter(map(len, split), np.int64, len(split))
            parts = np.fromiter(map(self.parts.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
            if len(self.parts) > len(self.part_sizes):
                ids, sizes = self._encode(list(islice(self.parts, len(self.part_sizes), None)))
                self.part_ids, self.part_sizes = np.concatenate([self.part_ids, ids]), np.concatenate([self.part_sizes, sizes])
            first = np.cumsum(self.part_sizes) - self.part_sizes
            ids = self.part_ids[_spans(first[parts], self.part_sizes[parts])]
            ends = np.concatenate([[0], np.cumsum(self.part_sizes[parts])])[np.concatenate([[0], np.cumsum(counts)])]
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, np.diff(ends)])
            self.ends = np.concatenate([self.ends, np.fromiter((c.endswith(STOPS) for c in new), bool, len(new))])
        return self.ids, np.cumsum(self.sizes) - self.sizes, self.sizes, self.ends


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, width: int) -> list[int]:
    """Numbers of the chosen cuts, from the first to the last.

    ``cuts`` ascends and neighbours are at most ``width`` apart.  A window whose length is a
    power of two needs no padding.
    """
    places, costs = cuts.tolist(), penalty.tolist()
    number = np.full(places[-1] + 1, -1, np.int64)
    number[cuts] = np.arange(len(cuts))
    full: dict[int, list[int]] = {}
    for size in (1 << k for k in range((width - 1).bit_length())):  # a window of ``width`` is full anyway
        later = np.flatnonzero(cuts >= size)
        start = number[cuts[later] - size]
        for j, i in zip(later[start >= 0].tolist(), start[start >= 0].tolist()):
            full.setdefault(j, []).append(i)
    best, back = [0.0] * len(places), [0] * len(places)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    for j in range(1, len(places)):
        at = places[j]
        while queue[0][1] < at - width:
            queue.popleft()
        least, from_ = queue[0][0] + width - at, queue[0][2]
        for i in full.get(j, ()):
            if best[i] < least:
                least, from_ = best[i], i
        best[j], back[j] = least + costs[j] + WINDOW, from_
        key = best[j] + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, at, j))
    chosen, j = [], len(places) - 1
    while j:
        chosen.append(j)
        j = back[j]
    return [0, *reversed(chosen)]


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(counts)
    return np.repeat(starts - total + counts, counts) + np.arange(total[-1] if len(total) else 0)


def _windows(docs: list[np.ndarray], chunks: Chunks, end_id: int, width: int):
    """Ids of all documents in a row, each document's end, and the chosen cuts."""
    ids, first, sizes, stops = chunks.look_up()
    words = np.concatenate(docs)
    counts = sizes[words]
    places = np.cumsum(counts)  # ends of words without the id that ends a document
    words_of = np.array([len(d) for d in docs])
    doc_of = np.repeat(np.arange(len(docs)), words_of)
    ends = places[np.cumsum(words_of) - 1] + np.arange(1, len(docs) + 1)
    stream = np.empty(int(ends[-1]), "<u4")
    text = np.ones(len(stream), bool)
    text[ends - 1] = False
    stream[text], stream[ends - 1] = ids[_spans(first[words], counts)], end_id
    at_stop = stops[words]
    sentence = (places + doc_of)[at_stop]
    cuts = np.unique(np.concatenate([[0], sentence, ends]))
    gaps = np.diff(cuts)
    wide = np.flatnonzero(gaps > width)
    step = max(1, width // 8)
    hard = [np.arange(cuts[i] + step, cuts[i + 1], step) for i in wide]
    cuts = np.unique(np.concatenate([cuts, *hard]))
    penalty = np.full(len(cuts), HARD_CUT)
    penalty[np.isin(cuts, sentence)] = SENTENCE_END
    penalty[np.isin(cuts, ends)] = 0.0
    return stream, ends, cuts[best_cuts(cuts, penalty, width)]


def pack(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", width: int = 2048, end_id: int = 1,
    tokenizer: str = WORD_BPE, block_chars: int = 4_000_000,
) -> DataFrame:
    """One row per piece: ``keep``, start, length, ids, doc_tokens, sequence_id, offset, padded.

    A document is the ids of its text and ``end_id``; null and empty texts are that id alone.
    Every id lies in exactly one piece.  Pieces of a sequence lie one after the other, in the
    order of the documents; the sequence is padded from its tokens to ``padded``, that is
    ``width``, or not at all when its length is a power of two.  Repeated rows are packed
    each; null ids and extra columns are carried only when named in ``keep``.  An empty
    table gives no rows.  ``block_chars`` bounds what one run of the cutting holds (a longer
    text is a block by itself); at most one short sequence ends each block.  Blocks
    don't move between tasks, and a task that is run again gives the same rows.
    """
    keep = [c for c in keep if c not in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded")]
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    more = [("start", LongType()), ("length", LongType()), ("ids", BinaryType()), ("doc_tokens", LongType()), ("sequence_id", LongType()), ("offset", LongType()), ("padded", IntegerType())]
    schema = StructType([*rows.schema.fields[:-1], *[StructField(n, t) for n, t in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, held, numbers, chars = worker_chunks(tokenizer), [], [], 0
        chunks.make_room()
        sequence = TaskContext.get().partitionId() << 36

        def emit() -> pa.RecordBatch:
            nonlocal sequence
            stream, ends, cuts = _windows(numbers, chunks, end_id, width)
            marks = np.unique(np.concatenate([cuts, ends]))
            start, length = marks[:-1], np.diff(marks)
            doc = np.searchsorted(ends, start, "right")
            window = np.searchsorted(cuts, start, "right") - 1
            used = np.diff(cuts)
            padded = np.where(used & (used - 1) == 0, used, width)
            doc_start = np.concatenate([[0], ends[:-1]])
            flat, at = stream.tobytes(), marks.tolist()
            kept = [pa.concat_arrays([b.column(i) for b in held]).take(pa.array(doc)) for i in range(len(keep))]
            out = [
                start - doc_start[doc], length, pa.array([flat[4 * a : 4 * b] for a, b in zip(at, at[1:])], pa.binary()),
                np.diff(np.concatenate([[0], ends]))[doc], sequence + window, start - cuts[window], padded[window].astype(np.int32),
            ]
            sequence += len(used)
            held.clear()
            numbers.clear()
            chunks.make_room()
            return pa.RecordBatch.from_arrays([*kept, *[pa.array(c) if isinstance(c, np.ndarray) else c for c in out]], schema=None, names=schema.names)

        for batch in batches:
            start = 0
            for i, t in enumerate(batch.column(len(keep))):
                value = t.as_py()
                numbers.append(chunks.numbers(value))
                chars += len(value) + 8
                if chars >= block_chars:
                    held.append(batch.slice(start, i + 1 - start))
                    start, chars = i + 1, 0
                    yield emit()
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield emit()

    return rows.mapInArrow(run, schema)
