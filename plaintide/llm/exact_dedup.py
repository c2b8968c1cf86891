"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed size.  Equal blocks sort next to each other and
get one integer name; then pairs of neighbouring names are sorted and named in turn,
until every document has a single name.  Two documents share their last name exactly
when their texts are equal: content is compared, no digest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaintide.llm.common import row_texts, sieve, written

#: The characters that don't count.
BLANKS = r"[\x20\x09-\x0D]+"
GATHER_BYTES = 16 << 20
NONE = -1  # the name that stands for no neighbour
BLOCKS = "block binary, rows array<bigint>, places array<int>"


def _blocks(size: int):
    """Cut texts into blocks and merge equal blocks of about GATHER_BYTES of text.

    A block that a third of all documents share then leaves each task as a few rows.
    """

    def emit(held: dict) -> pa.RecordBatch:
        rows, places = [[r for r, _ in v] for v in held.values()], [[p for _, p in v] for v in held.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.binary()), pa.array(rows, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
            ["block", "rows", "places"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        seen = 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                data = text.as_py()
                for place, at in enumerate(range(0, len(data) or 1, size)):
                    held.setdefault(data[at : at + size], []).append((row, place))
                seen += len(data) + 64
                if seen > GATHER_BYTES:
                    yield emit(held)
                    held, seen = {}, 0
        if held:
            yield emit(held)

    return cut


def _named_blocks(texts: DataFrame, size: int) -> DataFrame:
    """(row, place, name): distinct blocks are sorted and named, then names go back to where the blocks stand.

    A block is one row when it gets its name, however many texts share it; the lists of
    places of a common block meet that row in a join, which Spark can split.  A block whose
    hash no other has equals no other, so it gets a name where it is read and doesn't move.
    """
    blocks = texts.mapInArrow(_blocks(size), BLOCKS).withColumn("hash", F.xxhash64("block"))
    shared = written(blocks.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    # below zero, so that they differ from the names of blocks that are sorted and from NONE
    own = NONE - 1 - F.monotonically_increasing_id()
    held = written(sieve(blocks, shared, "hash").select(F.when(F.col("_maybe"), F.col("block")).alias("block"), "rows", "places", own.alias("name")))
    # Names differ from run to run of a task, so they are fixed by a table before use.
    common, alone = held.filter(F.col("block").isNotNull()).drop("name"), held.filter(F.col("block").isNull()).select("name", "rows", "places")
    known = written(common.select("block").distinct().sortWithinPartitions("block").withColumn("name", F.monotonically_increasing_id()))
    named = common.join(known, "block").select("name", "rows", "places")
    return (
        named.unionByName(alone)
        .select("name", F.explode(F.arrays_zip("rows", "places")).alias("o"))
        .select(F.col("o.rows").alias("row"), F.col("o.places").alias("place"), "name")
    )


def _named_pairs(names: DataFrame) -> DataFrame:
    """(row, place, name) one level up.  A last name without a neighbour pairs with NONE."""
    half = F.shiftright("place", 1)
    pairs = names.groupBy("row", half.alias("place")).agg(
        F.min(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("a"),
        F.coalesce(F.min(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(NONE)).alias("b"),
    )
    known = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
    # Names differ from run to run of a task, so they are fixed by a table before use.
    known = written(known.withColumn("name", F.monotonically_increasing_id()))
    return pairs.join(known, ["a", "b"]).select("row", "place", "name")


def identities(texts: DataFrame, block_size: int = 2048) -> DataFrame:
    """(row, level, name) for (row, text): equal (level, name) exactly for equal texts.

    ``level`` is the number of rounds, which follows from the length.  An empty text is
    one empty block.  There are as many rounds as doublings from ``block_size`` bytes to
    the longest text.
    """
    names = written(_named_blocks(texts, block_size))
    last = names.groupBy("row").agg(F.max("place").alias("last"))
    rounds = F.ceil(F.log2(F.col("last") + 1.0)).cast("int")
    names = written(names.join(last, "row").select("row", "place", "name", rounds.alias("rounds")))
    top = names.agg(F.max("rounds")).first()[0] or 0
    done = []
    for level in range(top + 1):
        done.append(names.filter(F.col("rounds") == level).select("row", F.lit(level).alias("level"), "name"))
        if level < top:
            longer = names.filter(F.col("rounds") > level)
            left = longer.filter(F.col("place") == 0).select("row", "rounds")
            names = written(_named_pairs(longer.drop("rounds")).join(left, "row"))
    return reduce(DataFrame.unionByName, done)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_size: int = 2048) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``;
    null counts as empty, and all empty texts are one group.  Of equal texts the one with
    the most code points stays, then the smallest id (null ids last), then the first row:
    repeated rows are a group of their own.  Other columns are ignored, whatever their
    name.  An empty table gives an empty result.  ``docs`` must be a table or a plan without
    shuffles, as rows are numbered by position.
    """
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, "")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars"), F.sha2(plain.cast("binary"), 256).alias("sha"),
    )
    marked = rows.join(identities(row_texts(docs.select(plain.alias("text"))), block_size), "row")
    marked = written(marked)
    best = F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), "id", "row")
    groups = marked.groupBy("level", "name").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return marked.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
