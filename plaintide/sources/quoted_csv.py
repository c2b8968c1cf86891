"""CSV with quoted line ends, read by many tasks per file.

A line end ends a record exactly when an even number of quotes stands before it in its file.
The first scan makes one row per block: whether its quotes are odd in number and how many
records begin in it, for both parities it may start with.  Running sums over the
blocks of a file tell which parity it was and how many records came before.  The second
scan reads the lines again, with their numbers.  A line that is a record by itself stays
where it is; only the lines of longer records are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BLOCK = "file string, block bigint, odd int, begun_0 bigint, begun_1 bigint"
LINE = "file string, block bigint, line_no bigint, line string, odd_before int, odd_after int, begun_0 bigint, begun_1 bigint"


def _block_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line): lines as they are cut at line feeds; ``block`` is the byte at which a task's part begins."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _runs(batch: pa.RecordBatch) -> list[tuple[str, int, int, int]]:
    """(file, block, first row, end) of the runs of rows of one block."""
    if not batch.num_rows:
        return []
    block = batch.column(1).to_numpy()
    file = batch.column(0).dictionary_encode()
    code = file.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(code) != 0)) + 1
    return [(file.dictionary[code[a]].as_py(), int(block[a]), a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)])]


def _counted(batches: Iterator[pa.RecordBatch]):
    """For each run of lines: file, block, line number of the first, slice, parities before and after, records begun so far.

    Parities and records count from the start of the block; the last pair are arrays for
    an even and an odd start.
    """
    here, odd, at, begun = None, 0, 0, [0, 0]
    for batch in batches:
        quotes = pc.count_substring(batch.column(2), '"').to_numpy()
        filled = ~pc.is_in(batch.column(2), pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        for file, block, a, b in _runs(batch):
            if (file, block) != here:
                here, odd, at, begun = (file, block), 0, 0, [0, 0]
            after = (odd + np.cumsum(quotes[a:b])) & 1
            before = np.concatenate([[odd], after[:-1]])
            counts = [begun[p] + np.cumsum((before == p) & filled[a:b]) for p in (0, 1)]
            yield file, block, at, batch.slice(a, b - a), before, after, counts
            odd, at, begun = int(after[-1]), at + b - a, [int(c[-1]) for c in counts]


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block; a block is read by one task, in order."""
    found: dict[tuple[str, int], tuple[int, int, int]] = {}
    for file, block, _, _, _, after, counts in _counted(batches):
        found[file, block] = (int(after[-1]), int(counts[0][-1]), int(counts[1][-1]))
    if found:
        keys, values = zip(*found.keys()), zip(*found.values())
        types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip([*keys, *values], types)]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "odd", "begun_0", "begun_1"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines with their numbers and parities."""
    for _, _, at, part, before, after, counts in _counted(batches):
        numbers = [np.arange(at, at + part.num_rows, dtype=np.int64), before.astype(np.int32), after.astype(np.int32), *counts]
        number, before, after, even, odd = map(pa.array, numbers)
        columns = [part.column(0), part.column(1), number, part.column(2), before, after, even.cast(pa.int64()), odd.cast(pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "line_no", "line", "odd_before", "odd_after", "begun_0", "begun_1"])


def blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, starts_odd, records_before, file_rank), a row per block of the input."""
    found = _block_lines(spark, path).mapInArrow(_summary, BLOCK)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    begun = F.when(F.col("starts_odd") == 0, F.col("begun_0")).otherwise(F.col("begun_1"))
    known = found.withColumn("starts_odd", parity.cast("int")).withColumn("begun", begun)
    known = known.withColumn("records_before", F.coalesce(F.sum("begun").over(earlier), F.lit(0)))
    # a row per file, as in the listing Spark's own reader makes
    ranks = known.select("file").distinct().withColumn("file_rank", F.row_number().over(Window.orderBy("file")) - 1)
    return known.join(ranks, "file").select("file", "block", "starts_odd", "records_before", "file_rank")


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_rank, record_no, record): the records of all files, from 1 in each file, without empty lines.

    Quotes must enclose whole cells and be doubled within them, as writers of CSV do; a quote
    that isn't closed takes the rest of its file into one record, as it does in a reader of whole files.
    Records end in a line feed, with or without a carriage return before it.
    """
    lines = _block_lines(spark, path).mapInArrow(_marked, LINE).join(blocks(spark, path), ["file", "block"])
    begun = F.when(F.col("starts_odd") == 0, F.col("begun_0")).otherwise(F.col("begun_1"))
    placed = lines.select(
        "file_rank", (F.col("records_before") + begun).alias("record_no"), "block", "line_no", "line",
        (F.col("odd_before") != F.col("starts_odd")).alias("inside"), (F.col("odd_after") != F.col("starts_odd")).alias("open"),
    )
    alone = placed.filter(~F.col("inside") & ~F.col("open") & ~F.col("line").isin("", "\r")).select("file_rank", "record_no", "line")
    parts = placed.filter(F.col("inside") | F.col("open")).groupBy("file_rank", "record_no")
    joined = parts.agg(F.sort_array(F.collect_list(F.struct("block", "line_no", "line"))).alias("lines"))
    joined = joined.select("file_rank", "record_no", F.array_join("lines.line", "\n").alias("line"))
    return alone.unionByName(joined).select("file_rank", "record_no", F.regexp_replace("line", "\r$", "").alias("record"))


def read_quoted(spark: SparkSession, path: str | list[str], names: list[str], ordinal: str | None = None, ordinal_bits: int = 40) -> DataFrame:
    """The rows of all files below their headers, all cells as text, columns by position as ``names``.

    ``ordinal`` names a column that is unique and ascends by file name and record.
    """
    rows = records(spark, path).filter("record_no > 1")
    cells = [f"_c{i}" for i in range(len(names))]
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    parsed = rows.withColumn("_cells", F.from_csv("record", ", ".join(f"{c} STRING" for c in cells), options))
    number = [(F.shiftleft(F.col("file_rank").cast("bigint"), ordinal_bits) + F.col("record_no")).alias(ordinal)] if ordinal else []
    return parsed.select(*[F.col(f"_cells.{c}").alias(n) for c, n in zip(cells, names)], *number)
