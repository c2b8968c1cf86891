"""Repeated passages by prefix-free parsing.

A rolling hash over eight bytes picks triggers: the first smallest hash among the next
``SPAN`` positions.  Every start of a passage has one trigger within reach, and equal
passages have it at the same place, so triggers cut all texts into phrases (runs of
starts with one trigger) that agree wherever the texts agree.  The dictionary holds the
phrases by name: the bytes after the trigger (``g``) and all bytes that passages from this
phrase cover (``k``).  Sorting the parse by (g, k) brings equal contexts next to each
other: a phrase whose neighbour is equal is repeated as a whole, and one without an equal
``g`` can't be.  Only phrases between the two, at the edges of repeats, are spread into
single suffixes, whose sorted names tell which have an equal neighbour.

Names are 128 bits of two polynomial hashes.  Which of two unequal passages comes first
doesn't matter here, so names are sorted in place of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plaintide.llm.common import fresh, row_texts, sieve, written

PASSAGE = 200
SPAN = 96  # starts that share a trigger, at most; a phrase's length must fit a byte
GRAM = 8
PIECE = 1 << 20  # starts of one text that are parsed at a time
GATHER_BYTES = 24 << 20
PART_ROWS = 1 << 18  # suffixes that are put in order together, about
EMIT_ROWS = 1 << 19  # suffixes that a task holds before it sends them on, about
ENTRY = np.dtype([("row", "<i8"), ("start", "<u4"), ("more", "u1")])
SUFFIX = np.dtype([("w1", "<u8"), ("w2", "<u4"), ("row", "<i8"), ("start", "<u4")])
PLACE = np.dtype([("row", "<i8"), ("start", "<u4")])
FULL, EDGE, MODEL = 0, 1, 2


class Hashes:
    """Two polynomial hashes modulo 2**64 of any substring, from running sums."""

    def __init__(self):
        rng = np.random.default_rng(20240607)
        self.values = [rng.integers(0, 2**64, 256, np.uint64) | np.uint64(1) for _ in range(2)]
        self.bases = [6364136223846793005, 11400714819323198485]
        self.powers: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64),) * 2] * 2

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        if len(self.powers[which][0]) <= len(data):
            n = max(1 << 12, 2 * len(data))
            base = self.bases[which]
            ups = [np.full(n, b & (2**64 - 1), np.uint64) for b in (base, pow(base, -1, 2**64))]
            for u in ups:
                u[0] = 1
            self.powers[which] = tuple(np.cumprod(u) for u in ups)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[which][data] * self.powers[which][0][: len(data)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hashes of the bytes from start to end, mixed so that all bits count."""
        h = (sums[end] - sums[start]) * self.powers[which][1][start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def windows(self, data: np.ndarray, start: np.ndarray, size: int, which: int) -> np.ndarray:
        """Hashes of the ``size`` bytes from each start, piece by piece."""
        out = np.empty(len(start), np.uint64)
        piece = start // PIECE
        for i in np.unique(piece).tolist():
            own = piece == i
            at = start[own] - i * PIECE
            out[own] = self.between(self.sums(data[i * PIECE : (i + 1) * PIECE + size], which), at, at + size, which)
        return out


def _triggers(data: np.ndarray, starts: int, span: int) -> np.ndarray:
    """For each of the first ``starts`` positions, its trigger: the first smallest gram hash within ``span``."""
    n = starts + span - 1
    gram = data[: n + GRAM - 1].astype(np.uint64)
    for k in (1, 2, 4):
        gram = gram[:-k] | (gram[k:] << np.uint64(8 * k))
    mixed = gram[:n] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    least = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: -(span - width)], least[span - width :])
    return (least[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(data: np.ndarray, hashes: Hashes, passage: int, span: int):
    """(g, k, first start, number of further starts) of the phrases of a text, piece by piece."""
    for at in range(0, len(data) - passage + 1, PIECE):
        part = data[at : at + PIECE + passage - 1]
        starts = len(part) - passage + 1
        trigger = _triggers(part, starts, span)
        first = np.flatnonzero(np.diff(trigger, prepend=-1))
        last = np.append(first[1:], starts) - 1
        trigger = trigger[first]
        a, b = hashes.sums(part, 0), hashes.sums(part, 1)
        g = hashes.between(a, trigger, trigger + passage - span + 1, 0)
        k = hashes.between(b, first, last + passage, 1) + (trigger - first).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        yield g, k, first + at, last - first


def _parsed(texts: DataFrame, passage: int, span: int) -> DataFrame:
    """(g, k, n, entries): the phrases of all texts, equal ones of about GATHER_BYTES merged.

    ``entries`` packs (row, start, further starts) of each occurrence; there are as many as
    the bytes that one task gathers allow, however often a phrase occurs.
    """

    def emit(parts: list) -> pa.RecordBatch:
        g, k = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        entries = np.concatenate([p[2] for p in parts])
        order = np.lexsort((k, g))
        g, k, entries = g[order], k[order], entries[order]
        new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])]))
        count = np.diff(np.append(new, len(g)))
        offsets = np.append(new, len(g)).astype(np.int32) * ENTRY.itemsize
        packed = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets), pa.py_buffer(entries.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64)), pa.array(k[new].view(np.int64)), pa.array(count.astype(np.int32)), packed], names=["g", "k", "n", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts, seen = Hashes(), [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for g, k, first, more in phrases(data, hashes, passage, span):
                    entries = np.empty(len(g), ENTRY)
                    entries["row"], entries["start"], entries["more"] = row, first, more
                    parts.append((g, k, entries))
                seen += len(data)
                if seen > GATHER_BYTES and parts:
                    yield emit(parts)
                    parts, seen = [], 0
        if parts:
            yield emit(parts)

    return texts.mapInArrow(run, "g bigint, k bigint, n int, entries binary")


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unpack (state, entries) into (row, state and entries of that row)."""
    for batch in batches:
        packed = [np.frombuffer(e.as_buffer(), ENTRY) for e in batch.column(1)]
        if not packed:
            continue
        entries = np.concatenate(packed)
        state = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(p) for p in packed])
        order = np.argsort(entries["row"], kind="stable")
        rows = entries["row"][order]
        new = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        spans = (entries["start"].astype(np.int64) << 10 | entries["more"].astype(np.int64) << 2 | state)[order]
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(rows)).astype(np.int32)), pa.array(spans))
        yield pa.RecordBatch.from_arrays([pa.array(rows[new]), lists], names=["row", "spans"])


def _starts(spans: np.ndarray) -> np.ndarray:
    """All starts of the phrases in ``spans``, one after the other."""
    first, more = spans >> 10, spans >> 2 & 255
    total = np.cumsum(more + 1)
    return np.repeat(first - total + more + 1, more + 1) + np.arange(total[-1] if len(total) else 0)


def _runs(w1: np.ndarray, w2: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of suffix names, the run of equal names of each, and whether a run is repeated.

    A run is repeated when it has more than one suffix, or one that stands for several (row -1).
    """
    order = np.lexsort((w2, w1))
    a, b = w1[order], w2[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    run = np.cumsum(new) - 1
    repeated = (np.bincount(run) > 1) | (np.bincount(run, row[order] < 0) > 0)
    return order, run, repeated


def _packed(part: np.ndarray, known: bool, columns: list[np.ndarray]) -> list[tuple[int, bool, bytes]]:
    """Rows (part, known, packed columns), one for each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    columns = [c[order] for c in columns]
    return [(int(part[i]), known, b"".join(c[i:j].tobytes() for c in columns)) for i, j in zip(cuts, [*cuts[1:], len(part)])]


def _suffixes(passage: int, parts: int):
    """(part, known, blob) of the single suffixes of edge phrases and of their models.

    Suffixes that a task finds to be repeated are known: one record, without a row, tells
    the others.
    """

    def emit(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        w1, w2, row, start = (np.concatenate(c) for c in out)
        order, run, repeated = _runs(w1, w2, row)
        twice = repeated[run]
        alone, members = order[~twice], order[twice]
        heads = members[np.flatnonzero(np.diff(run[twice], prepend=-1))]
        names = np.concatenate([alone, heads])
        rows = np.concatenate([row[alone], np.full(len(heads), -1)])
        found = _packed((w1[names] % np.uint64(parts)).astype(np.int64), False, [w1[names], w2[names], rows, start[names].astype("<u4")])
        members = members[row[members] >= 0]
        found += _packed(row[members] % parts, True, [row[members], start[members].astype("<u4")])
        part, known, blob = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(known), pa.array(blob, pa.binary())], names=["part", "known", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, out, held = Hashes(), [[], [], [], []], 0
        for batch in batches:
            for row, text, lists in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2)):
                spans = np.concatenate([np.asarray(s, np.int64) for s in lists.as_py()])
                spans = spans[spans & 3 != FULL]
                if not len(spans):
                    continue
                start, data = _starts(spans), np.frombuffer(text.as_buffer(), np.uint8)
                model = np.repeat(spans & 3 == MODEL, (spans >> 2 & 255) + 1)
                out[0].append(hashes.windows(data, start, passage, 0))
                out[1].append((hashes.windows(data, start, passage, 1) >> np.uint64(32)).astype("<u4"))
                out[2].append(np.where(model, -1, row))
                out[3].append(start)
                held += len(start)
                if held >= EMIT_ROWS:
                    yield emit(out)
                    out, held = [[], [], [], []], 0
        if held:
            yield emit(out)

    return run


def _views(column: pa.Array) -> Iterator[pa.Buffer]:
    """The bytes of each row without a copy; Arrow's scalars copy theirs."""
    _, offsets, data = column.buffers()
    width = "<i8" if pa.types.is_large_binary(column.type) else "<i4"
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].tolist()
    return (data.slice(a, b - a) for a, b in zip(ends, ends[1:]))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Buffer], list[pa.Buffer]]]:
    """(part, known blobs, other blobs) of rows that come sorted by part; blobs are views of the batch, not copies."""
    here, known, blobs = None, [], []
    for batch in batches:
        for part, is_known, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _views(batch.column(2))):
            if part != here and here is not None:
                yield here, known, blobs
                known, blobs = [], []
            here = part
            (known if is_known else blobs).append(blob)
    if here is not None:
        yield here, known, blobs


def _columns(blobs: list[pa.Buffer], kind: np.dtype) -> list[np.ndarray]:
    """The columns of packed records, each over all blobs."""
    out = []
    for name in kind.names:
        field, at = kind.fields[name]
        out.append(np.concatenate([np.frombuffer(b, field, b.size // kind.itemsize, at * (b.size // kind.itemsize)) for b in blobs]))
    return out


def _judged(parts: int):
    """(part, known, blob) of the repeated suffixes: all suffixes of a name are in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, known, blobs in _by_part(batches):
            found = [(part, True, b.to_pybytes()) for b in known]
            if blobs:
                w1, w2, row, start = _columns(blobs, SUFFIX)
                order, run, repeated = _runs(w1, w2, row)
                members = order[repeated[run] & (row[order] >= 0)]
                found += _packed(row[members] % parts, True, [row[members], start[members]])
            if found:
                at, is_known, blob = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(is_known), pa.array(blob, pa.binary())], names=["part", "known", "blob"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, starts): the repeated suffixes of each text, all of which are in one part."""
    for _, known, _ in _by_part(batches):
        row, start = _columns(known, PLACE)
        order = np.argsort(row, kind="stable")
        row, start = row[order], start[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([np.ones(min(len(row), 1), bool), row[1:] != row[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(start))
        yield pa.RecordBatch.from_arrays([pa.array(row[new]), lists], names=["row", "starts"])


def _repeats(spans: np.ndarray, starts: np.ndarray, passage: int) -> np.ndarray:
    """(start, end) of the maximal runs of bytes that repeated passages cover."""
    start = np.union1d(_starts(spans[spans & 3 == FULL]), starts)
    if not len(start):
        return np.zeros((0, 2), np.int64)
    breaks = np.flatnonzero(start[1:] > start[:-1] + passage)
    return np.stack([start[np.append(0, breaks + 1)], start[np.append(breaks, len(start) - 1)] + passage], 1)


def repeated_passages(texts: DataFrame, passage: int = PASSAGE, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """For (row, text): (row, spans) of phrases that repeat or may, and (row, starts) of the repeated suffixes of the latter."""
    parsed = written(_parsed(texts, passage, span))
    # triggers are counted as numbers, contexts only of triggers with several; only entries that may repeat are moved, by a join that Spark can split
    mark = F.xxhash64("entries")
    triggers = parsed.groupBy("g").agg(F.sum("n").alias("ng"), F.min("k").alias("low"), F.max("k").alias("high"))
    triggers = written(triggers.filter(F.col("ng") > 1))
    single = triggers.filter("low = high").select("g", F.col("low").alias("k"), F.col("ng").alias("nk"), F.lit(None).cast("bigint").alias("model"))
    several = triggers.filter("low != high").select("g")
    contexts = sieve(parsed, several, "g").filter("_maybe").groupBy("g", "k").agg(F.sum("n").alias("nk"), F.min(mark).alias("model"))
    shared = written(single.unionByName(contexts.join(several, "g", "left_semi")))
    ordered = sieve(parsed, shared, "g").filter("_maybe").drop("_maybe").join(shared, ["g", "k"])
    states = F.array_compact(F.array(
        F.when(F.col("nk") > 1, FULL).otherwise(EDGE),
        F.when((F.col("nk") > 1) & (mark == F.col("model")), MODEL),
    ))
    flagged = ordered.select(F.explode(states).alias("state"), "entries")
    # of a context's occurrences, one entry of one task's suffices as the model
    flagged = flagged.select("state", F.when(F.col("state") == MODEL, F.substring("entries", 1, ENTRY.itemsize)).otherwise(F.col("entries")).alias("entries"))
    spans = written(flagged.mapInArrow(_by_row, "row bigint, spans array<bigint>").groupBy("row").agg(F.collect_list("spans").alias("spans")))
    not_full = lambda x: x.bitwiseAND(F.lit(3)) != FULL
    edges = spans.withColumn("edges", F.filter(F.flatten("spans"), not_full)).filter(F.size("edges") > 0)
    edges = edges.select("row", F.array("edges").alias("spans"), F.aggregate("edges", F.lit(0).cast("bigint"), lambda n, x: n + F.shiftright(x, 2).bitwiseAND(F.lit(255)) + 1).alias("n"))
    parts = (edges.agg(F.sum("n")).first()[0] or 0) // PART_ROWS + 1
    found = sieve(texts, edges, "row").filter("_maybe").join(edges, "row").select("row", "text", "spans")
    suffixes = found.mapInArrow(_suffixes(passage, parts), "part bigint, known boolean, blob binary")
    judged = suffixes.repartition("part").sortWithinPartitions("part").mapInArrow(_judged(parts), suffixes.schema)
    return spans, written(judged.repartition("part").sortWithinPartitions("part").mapInArrow(_gathered, "row bigint, starts array<bigint>"))


def drop_repeats(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, passage: int = PASSAGE, span: int = SPAN, as_text: bool = False) -> DataFrame:
    """The columns ``keep`` (default: all), spans (start, end in bytes) that were cut, and kept (the bytes left).

    Each byte covered by a ``passage``-byte string that also starts anywhere else, in the same
    document too, is cut; strings are judged on the input.  A null text counts as empty, and
    texts shorter than ``passage`` stay whole.  Repeated rows repeat each other's bytes: all of
    them are cut.  With ``as_text``, ``kept`` is text without the characters that were cut in two.
    Columns of ``docs`` called ``spans`` or ``kept`` are replaced; an empty table
    gives no rows.  ``docs`` must be a table, as its rows are numbered by position.
    """
    texts = row_texts(docs, text)
    spans, repeated = repeated_passages(texts, passage, span)
    row, body, starts, phrase = fresh(docs, "_row", "_body", "_starts", "_phrases")
    names = [c for c in keep or docs.columns if c.lower() not in ("spans", "kept")]
    whole = docs.select(*names, F.monotonically_increasing_id().alias(row), *([] if text in names else [F.col(text).alias(body)]))
    body = text if text in names else body
    marks = spans.join(repeated, "row", "left").select(F.col("row").alias(row), F.col("spans").alias(phrase), F.col("starts").alias(starts))
    # texts without a phrase to cut stay where they are
    sifted = sieve(whole, spans.select(F.col("row").alias(row)), row)
    cut = sifted.filter("_maybe").drop("_maybe").join(marks, row, "left")
    joined = cut.unionByName(sifted.filter("not _maybe").drop("_maybe"), allowMissingColumns=True).drop(row)
    span_type = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    results = T._parse_datatype_string(f"spans array<struct<start:bigint,end:bigint>>, kept {'string' if as_text else 'binary'}")
    schema = T.StructType([*joined.select(*names).schema.fields, *results.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, kept = [], []
            for value, spans, more in zip(batch.column(body), batch.column(phrase), batch.column(starts)):
                data = (value.as_py() or "").encode()
                runs = np.zeros((0, 2), np.int64)
                if spans.is_valid:
                    flat = [np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in v.as_py() or [])]) for v in (spans, pa.scalar([more.as_py() or []]))]
                    runs = _repeats(*flat, passage)
                cut.append([{"start": a, "end": b} for a, b in runs.tolist()])
                ends = [0, *runs.ravel().tolist(), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])))
            columns = [batch.column(n) for n in names]
            left = pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.list_(span_type)), left], names=[*names, "spans", "kept"])

    return joined.mapInArrow(run, schema)
