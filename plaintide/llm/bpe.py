"""Byte-level BPE by merge replay over a corpus shard.

The distinct words of a shard are laid out as one sequence of bytes.  An inverted index
maps every pair of neighbouring tokens, named by the rank of its merge, to the positions
where it stands.  Merges are then applied in rank order, each at all its positions at
once, and only pairs that touch a merged position are looked up again.  Words don't
influence each other, so replaying the shards side by side gives the same tokens as one
replay over the whole corpus, without moving a byte between tasks.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

NONE = np.int32(2**31 - 1)
SHARD_CHARS = 3_000_000
# The white space of the pattern.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+").findall
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token, by its bytes."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in a row, and where each starts and how long it is."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


class Merges:
    """Ranks of tokens, and the rank of the token that two neighbours make."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.size = max(self.ranks.values()) + 1
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()] + [NONE], np.int32)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        square = np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)
        self.of_bytes = self.rank_of(*square).reshape(256, 256)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; NONE where there is none or a side is -1."""
        key = np.where((a < 0) | (b < 0), np.int64(-1), a.astype(np.int64) * self.size + b)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NONE)


@functools.lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def _one_word(table: Merges, word: bytes) -> list[int]:
    """A word that is a token is that token; else the leftmost pair of lowest rank merges until none is left."""
    if word in table.ranks:
        return [table.ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((table.ranks.get(parts[k] + parts[k + 1], int(NONE)), k) for k in range(len(parts) - 1))
        if rank == NONE:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [table.ranks[p] for p in parts]


def _runs(ranks: np.ndarray, positions: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions by rank, for ranks that are merges."""
    order = np.argsort(ranks, kind="stable")
    ranks, positions = ranks[order], positions[order]
    cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
    for k, start in enumerate(cuts):
        if ranks[start] != NONE:
            yield int(ranks[start]), positions[start : cuts[k + 1] if k + 1 < len(cuts) else None]


def replay(table: Merges, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words, one after the other, and the number of tokens of each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lengths.sum())
    ends = np.cumsum(lengths)
    token = np.full(n + 1, -1, np.int32)  # the last place stands for "no neighbour"
    data = np.frombuffer(b"".join(words), np.uint8)
    token[:n] = table.of_byte[data]
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[ends[lengths > 0] - 1] = n
    before[(ends - lengths)[lengths > 0]] = n
    rank = np.full(n + 1, NONE, np.int32)
    if n > 1:
        rank[: n - 1] = table.of_bytes[data[:-1], data[1:]]
    rank[after == n] = NONE
    index = {r: [p] for r, p in _runs(rank[:n], np.arange(n, dtype=np.int32))}
    heap = list(index)
    heapq.heapify(heap)
    again: set[int] = {i for i, w in enumerate(words) if w in table.ranks}
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = at[rank[at] == r]
        at.sort()
        if at.size > 1:
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if follows.any():  # as in "aaa": of overlapping pairs, every other one from the left
                place = np.arange(at.size)
                at = at[(place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0]
        elif not at.size:
            continue
        right = after[at]
        token[at], token[right], rank[right] = r, -1, NONE
        after[at] = after[right]
        before[after[at]] = at
        touched = np.concatenate([at, before[at]])
        touched = touched[touched < n]
        new = table.rank_of(token[touched], token[after[touched]])
        rank[touched] = new
        some = new != NONE
        if not some.any():
            continue
        for s, p in _runs(new[some], touched[some]):
            if s in index:
                index[s].append(p)
            else:
                index[s] = [p]
                heapq.heappush(heap, s)
            if s <= r:  # a merge of lower rank appears: its words are done one by one
                again.update(np.searchsorted(ends, p, "right").tolist())
    alive = token[:n] >= 0
    sums = np.concatenate([[0], np.cumsum(alive)])
    counts = sums[ends] - sums[ends - lengths]
    tokens = token[:n][alive]
    if again:
        tokens, counts = _replaced(tokens, counts, {i: _one_word(table, words[i]) for i in again})
    return tokens, counts


def _replaced(tokens: np.ndarray, counts: np.ndarray, by: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens with those of some words exchanged."""
    where = np.array(sorted(by))
    parts, last, starts = [], 0, np.cumsum(counts) - counts
    for i in where.tolist():
        parts += [tokens[last : starts[i]], np.array(by[i], np.int32)]
        last = starts[i] + counts[i]
    counts = counts.copy()
    counts[where] = [len(by[i]) for i in where.tolist()]
    return np.concatenate([*parts, tokens[last:]]), counts


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after the other."""
    total = np.cumsum(counts)
    return np.repeat(starts - total + counts, counts) + np.arange(total[-1] if len(total) else 0)


def _numbers() -> defaultdict:
    """Numbers keys in the order in which they are first asked for."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


class Shard:
    """Documents as numbers of distinct chunks, until there is enough to replay.

    A chunk is a run of white space and what follows it up to the next white space.  No
    match of the pattern reaches over a chunk's end, so only distinct chunks are split.
    Chunks that follow a single blank, nearly all, are known without it.
    """

    def __init__(self, path: str, pattern: str):
        self.table, self.split = merges(path), regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.chunks = _numbers()
        self.docs: list[np.ndarray] = []
        self.texts: list[str] = []
        self.chars = 0

    def add(self, text: str) -> None:
        pieces = text.split(" ")
        pieces[0] += " "  # the first has no blank before it; no other piece has one in it
        self.docs.append(np.fromiter(map(self.chunks.__getitem__, pieces), np.uint32, len(pieces)))
        self.texts.append(text)
        self.chars += len(text)

    def _mend(self) -> None:
        """Cut texts again in which a blank has more white space beside it."""
        odd = [k for c, k in self.chunks.items() if not c or c[0].isspace() or c[-1:].isspace() and (c[-1] != " " or c[-2:-1].isspace())]
        odd_chunks = np.zeros(len(self.chunks), bool)
        odd_chunks[odd] = True
        for i in [i for i, d in enumerate(self.docs) if odd_chunks[d].any()] if odd else []:
            pieces = [c[1:] if c[0] == " " and c[1:2].strip() else c + " " for c in CHUNK(self.texts[i])]
            self.docs[i] = np.fromiter(map(self.chunks.__getitem__, pieces), np.uint32, len(pieces))

    def _split(self, chunk: str) -> list[str]:
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ",.":
            return [" " + chunk[:-1], chunk[-1]]
        return self.split(chunk[:-1] if chunk[-1:] == " " else " " + chunk)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all distinct chunks, one after the other, and how many each chunk has."""
        known = _numbers()
        split = list(map(self._split, self.chunks))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        of_chunk = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        tokens, counts = replay(self.table, [w.encode() for w in known])
        longs = np.concatenate([[0], np.cumsum(counts[of_chunk])])
        ends = np.cumsum(sizes)
        return tokens[gather((np.cumsum(counts) - counts)[of_chunk], counts[of_chunk])], longs[ends] - longs[ends - sizes]

    def encoded(self) -> Iterator[np.ndarray]:
        """The tokens of each document."""
        self._mend()
        tokens, counts = self.tokens()
        tokens, starts = tokens.astype("<u4"), np.cumsum(counts) - counts
        return (tokens[gather(starts[k], counts[k])] for k in self.docs)


def _by_shard(docs: DataFrame, keep: Sequence[str], text: str, out: StructField, value, ranks: str, pattern: str, shard_chars: int) -> DataFrame:
    """The columns ``keep`` and ``value`` of a shard's tokens, an Arrow array, as the column ``out``."""
    keep = [c for c in keep if c.lower() != out.name.lower()]
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(out.name))
    width = range(len(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = Shard(ranks, pattern), []

        def emit() -> pa.RecordBatch:
            kept = [pa.concat_arrays([b.column(i) for b in held]) for i in width]
            batch = pa.RecordBatch.from_arrays([*kept, value(shard.encoded())], names=[*keep, out.name])
            held.clear()
            shard.clear()
            return batch

        for batch in batches:
            start = 0
            for i, t in enumerate(batch.column(len(keep))):
                shard.add(t.as_py())
                if shard.chars >= shard_chars:
                    held.append(batch.slice(start, i + 1 - start))
                    start = i + 1
                    yield emit()
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield emit()

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], out]))


def encode(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", ids: str = "ids",
    ranks: str = BYTE_BPE, pattern: str = public_tokenizers.PATTERN, shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """The columns ``keep`` and the tokens of each text, packed as little-endian 32-bit integers.

    A null or empty text has no tokens.  Every row is encoded by itself, so repeated rows
    and null ids stay as they are; a kept column called ``ids`` is replaced.  An empty table
    stays empty.  ``shard_chars`` bounds what one replay holds, apart from a single text
    that is longer.
    """
    packed = lambda tokens: pa.array((t.tobytes() for t in tokens), pa.binary())
    return _by_shard(docs, keep, text, StructField(ids, BinaryType()), packed, ranks, pattern, shard_chars)


def token_lengths(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", out: str = "n_tokens",
    ranks: str = BYTE_BPE, pattern: str = public_tokenizers.PATTERN, shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """As ``encode``, but only the number of tokens of each text."""
    sizes = lambda tokens: pa.array((len(t) for t in tokens), pa.int64())
    return _by_shard(docs, keep, text, StructField(out, LongType()), sizes, ranks, pattern, shard_chars)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", ranks: str = BYTE_BPE) -> DataFrame:
    """Add the bytes that the packed tokens in ``ids`` stand for; null stays null.

    Bytes, not text: tokens may end inside a character.  An unknown token is an error.  A
    column called ``out`` is replaced.
    """
    rows = encoded.drop(out)
    schema = StructType([*rows.schema.fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, starts, lengths = token_bytes(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                numbers = (None if x is None else np.frombuffer(x, "<u4") for x in part.column(ids).to_pylist())
                texts = [None if k is None else tokens[gather(starts[k], lengths[k])].tobytes() for k in numbers]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)
