"""Shared helpers: work tables, row ids, internal column names."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaintide.session import shared_folder

SIEVE_WORD_BITS = 20


def work_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else Spark's warehouse; an error where no machine but the driver's has it."""
    return shared_folder(spark)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: later reads don't depend on lost executors."""
    path = f"{work_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Add a number that is unique to each row, so repeated ids and nulls do no harm.

    The number follows from partition and position.  Two scans of one table give the
    same numbers; a result of shuffles must be written first.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


_remembered: dict = {}


def worker_memory(owner: tuple, make: Callable[[], object]):
    """What a Python worker keeps from task to task; it goes when another owner's tasks ask for theirs.

    Spark hands a worker from one job to the next, so without this the memory of an operator that has
    ended would stay in the executor as long as the worker lives.
    """
    if owner not in _remembered:
        _remembered.clear()
        _remembered[owner] = make()
    return _remembered[owner]


def _bit(key: str) -> tuple[Column, Column]:
    """Word and mask of a key's bit among 2**26."""
    h = F.xxhash64(key)
    return F.shiftrightunsigned(h, 64 - SIEVE_WORD_BITS), F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))


def sieve(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Add ``_maybe``: false only for rows whose ``key`` is not in ``keys``.

    A bit map of fixed size is broadcast, at most 2**20 rows of 64 bits, whatever the
    number of keys.  It saves a shuffle of rows without a partner; a join decides.
    """
    word, mask = _bit(key)
    bits = keys.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    marked = df.withColumns({"_word": word, "_mask": mask}).join(F.broadcast(bits), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) != 0, F.lit(False))
    return marked.withColumn("_maybe", hit).drop("_word", "_mask", "_bits")


def row_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, text) of every document, null as empty."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
