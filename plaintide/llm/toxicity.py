"""Toxicity by maximum-scoring segments.

Every word has a log-odds score of standing in a toxic rather than a clean text.  Class
counts of a word are smoothed by a Dirichlet prior whose mean is the score of its
longest shorter prefix, down to the rate of all words, so that unseen forms of a known
stem score like the stem.  A linear scan finds all maximal scoring segments of a text.
Their scores are turned into expected numbers of such segments in clean text of that
length (extreme-value law with parameters fitted on clean texts), and the evidence of
all significant segments gives the score of the document.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plaintide.llm.common import worker_memory

EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), 0xBF, 0xA1, 0xAB, 0xBB, *range(0x2010, 0x2027)]))
PREFIXES = (3, 4, 5, 6)
DRIFT = 1.0  # taken off each token's score, so that segments in clean text stay short
STEP = 0.05  # width of the bins in which token scores are counted
PASSAGES = "array<struct<start:int,end:int,score:double,expected:double>>"


def held_out(id_col: str) -> Column:
    """Rows kept for testing: crc32 of the id as text is divisible by 5 (null: as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _part(id_col: str) -> Column:
    """Which of four parts of the labelled rows a document belongs to: part 0 calibrates."""
    return F.pmod(F.xxhash64(F.lit("part"), F.col(id_col)), F.lit(4))


class Words:
    """Distinct words and texts as arrays of their numbers."""

    def __init__(self):
        self.known: defaultdict = defaultdict()
        self.known.default_factory = self.known.__len__

    def numbers(self, text: str) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def _buckets(word: str, size: int) -> list[int]:
    """The word's features, most general first: its prefixes and itself, hashed."""
    word = word.strip(EDGES) or word
    parts = [word[:k] for k in PREFIXES if k < len(word)]
    return [zlib.crc32(f"{len(p)}:{p}".encode()) % size for p in parts] + [zlib.crc32(word.encode()) % size]


@dataclass
class Model:
    """Counts by hashed feature, the law of segment scores in clean text, a logistic curve."""

    toxic: np.ndarray
    clean: np.ndarray
    weight: float
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    shift: float = -8.0

    def word_score(self, word: str) -> float:
        base = (float(self.toxic[-1]) + 1) / (float(self.toxic[-1]) + float(self.clean[-1]) + 2)
        share = base
        for b in _buckets(word, len(self.toxic) - 1):
            toxic, clean = float(self.toxic[b]), float(self.clean[b])
            share = (toxic + self.weight * share) / (toxic + clean + self.weight)
        return math.log(share / (1 - share)) - math.log(base / (1 - base))

    def expected(self, score: float, n: int) -> float:
        """How many segments of this score a clean text of ``n`` words has on average."""
        return self.scale * max(n, 1) * math.exp(-self.rate * score)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.shift))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), each position visited once.

    A segment is one that no longer or shorter neighbour improves: the scan keeps
    candidates with their sums before and after, and merges a candidate into the last one
    that starts lower as long as that one also ends lower.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[float, float, int, int, int]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        low, high, start = total[i], total[i + 1], i
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][0] >= low:
                j = held[j][4]
            if j < 0 or held[j][1] >= high:
                break
            low, start = held[j][0], held[j][2]
            link = held[j][4]
            del held[j:]
            j = link
        held.append((low, high, start, i + 1, j))
    return [(start, end, float(high - low)) for low, high, start, end, _ in held]


def damped(scores: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Positive scores divided by how often the word has come up so far."""
    high = np.flatnonzero(scores > 0)
    order = high[np.argsort(numbers[high], kind="stable")]
    new = np.concatenate([np.ones(min(len(order), 1), bool), numbers[order][1:] != numbers[order][:-1]])
    place = np.arange(len(order))
    out = scores.copy()
    out[order] /= place - np.maximum.accumulate(np.where(new, place, 0)) + 1
    return out


def judged(found: list[tuple[int, int, float]], scores: np.ndarray, numbers: np.ndarray) -> list[tuple[int, int, float, int]]:
    """The segments with the scores by which their significance is judged, and their strongest words.

    One odd word that fills a passage is weak evidence, however often it stands there: its
    repeats within the segment are damped, and the best run that is left counts.  Nothing outside
    the segment matters, and what a segment begins with is never worth less for being repeated.
    """
    out = []
    for a, b, s in found:
        inside = numbers[a:b]
        if b - a > 1 and len(np.unique(inside)) < b - a:
            total = np.concatenate([[0.0], np.cumsum(damped(scores[a:b] + DRIFT, inside) - DRIFT)])
            s = float((total - np.minimum.accumulate(total)).max())
        out.append((a, b, s, int(inside[np.argmax(scores[a:b])])))
    return out


class Scorer:
    """Texts to token scores and words; the score is the log-odds less DRIFT, kept by word while there is room."""

    def __init__(self, model: Model, room: int = 250_000):
        self.model, self.room = model, room
        self.words, self.scores = Words(), np.zeros(0)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words.known) > self.room:
            self.words, self.scores = Words(), np.zeros(0)
        numbers = self.words.numbers(text)
        if len(self.words.known) > len(self.scores):
            new = _last(self.words.known, len(self.scores))
            self.scores = np.concatenate([self.scores, [self.model.word_score(w) for w in new]])
        return self.scores[numbers] - DRIFT, numbers

    def passages(self, text: str) -> tuple[list[tuple[int, int, float, int]], int]:
        """All maximal segments as they are judged, and the number of words."""
        scores, numbers = self(text)
        return judged(segments(scores), scores, numbers), len(scores)


def _last(known: dict, since: int) -> list[str]:
    """The keys added after the first ``since``."""
    back = reversed(known)
    return [next(back) for _ in range(len(known) - since)][::-1]


def _evidence(model: Model, found: list[tuple[int, int, float, int]], n: int) -> tuple[float, list]:
    """Sum of -ln(expected) over segments expected less than once, and these segments.

    Of segments with the same strongest word the best counts in full, the next a half, then a third:
    a further passage adds to the evidence, wherever it stands, and never takes from it.
    """
    kept, by_word = [], defaultdict(list)
    for a, b, s, word in found:
        if (e := model.expected(s, n)) < 1:
            kept.append((a, b, s, e))
            by_word[word].append(-math.log(max(e, 1e-300)))
    return sum(x / k for same in by_word.values() for k, x in enumerate(sorted(same, reverse=True), 1)), kept


def _count(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents by class and feature.  Tasks send one row per feature they met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(("toxicity",), dict)  # what another operator left in this worker goes
        toxic, clean = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for batch in batches:
            words, seen = Words(), {0: [], 1: []}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].append(np.unique(words.numbers(text)))
            features = [_buckets(w, size) for w in words.known]
            flat = np.array([b for f in features for b in f], np.int64)
            word_of = np.repeat(np.arange(len(features)), [len(f) for f in features])
            for label, counts in ((1, toxic), (0, clean)):
                if seen[label] and len(flat):
                    per_word = np.bincount(np.concatenate(seen[label]), minlength=len(features))
                    counts[:size] += np.bincount(flat, per_word[word_of], minlength=size).astype(np.int64)
                    counts[size] += per_word.sum()
        at = np.flatnonzero(toxic + clean)
        yield pa.RecordBatch.from_pydict({"bucket": at, "toxic": toxic[at], "clean": clean[at]})

    sums = rows.mapInArrow(run, "bucket bigint, toxic bigint, clean bigint").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, *counts = (column.to_numpy() for column in batch.columns)
            arrays = [at.astype(np.int32), *(c.astype(np.float32) for c in counts)]
            yield pa.RecordBatch.from_pydict({n: [x.tobytes()] for n, x in zip(("bucket", "toxic", "clean"), arrays)})

    toxic, clean = np.zeros(size + 1, np.float32), np.zeros(size + 1, np.float32)
    for row in sums.mapInArrow(packed, "bucket binary, toxic binary, clean binary").collect():  # 12 bytes a feature met
        at = np.frombuffer(row["bucket"], np.int32)
        toxic[at], clean[at] = np.frombuffer(row["toxic"], np.float32), np.frombuffer(row["clean"], np.float32)
    return toxic, clean


def _rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 under the counted scores."""
    if not len(scores) or scores.max() <= 0 or (scores * counts).sum() >= 0:
        return 1.0
    share, low, high = counts / counts.sum(), 1e-6, 1.0
    excess = lambda r: float((share * np.exp(r * scores)).sum()) - 1
    while excess(high) < 0 and high < 50:
        high *= 2
    for _ in range(60):
        low, high = (low, mid) if excess(mid := (low + high) / 2) > 0 else (mid, high)
    return high


def _logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a small ridge."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - n * p) - 1e-2 * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
    max_labelled: int = 50_000, features: int = 1 << 20, weight: float = 2.0,
) -> Model:
    """Learn from labelled rows that aren't held out.

    About ``max_labelled`` rows, chosen by a hash of the id, are used: this bounds the table
    of labels that is broadcast.  An id labelled twice is toxic if any label says so; null
    ids and labels don't count.  ``features`` bounds the model, whatever the vocabulary.
    Three quarters of the rows give the word counts, the rest the law of clean scores and
    the curve.  Without labels of both classes the model calls everything clean.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).filter(~held_out(id_col))
    known = usable.groupBy(id_col).agg(F.max(label).alias("_y"))
    n = known.count()
    share = int(min(1.0, max_labelled / max(n, 1)) * (1 << 20))
    known = known.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < share).select(F.col(id_col).alias("_id"), F.col("_y").cast("int").alias("_y"))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = texts.join(F.broadcast(known), "_id")
    toxic, clean = _count(rows.filter(_part("_id") != 0).select("_t", "_y"), features)
    model = Model(toxic, clean, weight)
    if not toxic[-1] or not clean[-1]:
        return model
    held = rows.filter(_part("_id") == 0).select("_t", "_y")
    sent = held.sparkSession.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, counts = Scorer(sent.value), defaultdict(int)
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not y:
                    for b, c in zip(*np.unique(np.floor(scorer(t)[0] / STEP + 0.5).astype(int), return_counts=True)):
                        counts[int(b)] += int(c)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(counts.keys(), pa.int64()), "n": pa.array(counts.values(), pa.int64())})

    got = held.mapInArrow(bins, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    model.rate = _rate(got["bin"].to_numpy(float) * STEP, got["n"].to_numpy(float))
    rate = model.rate

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, sums = Scorer(sent.value), [0.0, 0]
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not y:
                    found, n = scorer.passages(t)
                    top = max((s for _, _, s, _ in found), default=0.0)
                    sums = [sums[0] + max(n, 1) * math.exp(-rate * top), sums[1] + 1]
        yield pa.RecordBatch.from_pydict({"mass": [sums[0]], "n": [sums[1]]})

    mass, clean_docs = held.mapInArrow(best, "mass double, n bigint").agg(F.sum("mass"), F.sum("n")).first()
    model.scale = clean_docs / mass if mass else 1.0
    law = (model.rate, model.scale)

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value
        mine.rate, mine.scale = law
        scorer, counts = Scorer(mine), defaultdict(int)
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, _ = _evidence(mine, *scorer.passages(t))
                counts[(min(int(x * 4), 400), y)] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_pydict({"x": pa.array([k[0] for k in keys], pa.int64()), "y": pa.array([k[1] for k in keys], pa.int64()), "n": pa.array(counts.values(), pa.int64())})

    grid = held.mapInArrow(curve, "x bigint, y bigint, n bigint").groupBy("x").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("y")).toPandas()
    if len(grid):
        model.slope, model.shift = _logistic(grid["x"].to_numpy(float) / 4, grid["n"].to_numpy(float), grid["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of every document, score (0 to 1), predicted (1 from 0.5), passages.

    ``passages`` holds each significant segment: first word, word after the last, score, and
    how many such segments a clean text of that length has on average.  Words are runs
    between white space.  A null or empty text has no passages and the lowest score.  Rows
    are scored one by one, so repeated rows and null ids stay.  Kept columns that are called
    like a result are replaced.  An empty table gives no rows.
    """
    names = [c for c in keep if c.lower() not in ("score", "predicted", "passages")]
    rows = docs.select(*names, *([] if text in names else [F.col(text)]))
    results = T._parse_datatype_string(f"score double, predicted int, passages {PASSAGES}")
    schema = T.StructType([*rows.select(*names).schema.fields, *results.fields])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(("toxicity",), dict)
        scorer = Scorer(sent.value)
        for batch in batches:
            out, found = [], []
            for t in batch.column(text):
                evidence, kept = _evidence(scorer.model, *scorer.passages(t.as_py() or ""))
                out.append(scorer.model.probability(evidence))
                found.append([{"start": a, "end": b, "score": s, "expected": e} for a, b, s, e in kept])
            results = [pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32()), pa.array(found, pa.list_(passage))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *results], names=schema.names)

    return rows.mapInArrow(run, schema)
