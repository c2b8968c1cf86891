"""The most frequent terms of a corpus without shuffling the counts of all terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from plaintide.operators.ids import most_frequent
from plaintide.session import written

BUCKET_BITS = 20


def bucketed(occurrences: DataFrame, bits: int = BUCKET_BITS, term: str = "term") -> DataFrame:
    """Add the hash bucket of each term as ``_bucket``."""
    return occurrences.withColumn("_bucket", F.xxhash64(term).bitwiseAND(F.lit((1 << bits) - 1)))


def bucket_map(buckets: DataFrame, bits: int = BUCKET_BITS) -> Column:
    """A bit per bucket as one value of ``2**bits / 8`` bytes, set for the rows of ``buckets``."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bucket").bitwiseAND(F.lit(63)).cast("int"))
    filled = buckets.groupBy(F.shiftright("_bucket", 6).alias("id")).agg(F.bit_or(one).alias("_bits"))
    every = buckets.sparkSession.range(max(1, 1 << (bits - 6))).join(filled, "id", "left")
    ordered = F.sort_array(F.collect_list(F.struct("id", F.coalesce("_bits", F.lit(0)).alias("bits"))))
    return every.agg(ordered["bits"].alias("bits")).scalar()


def in_map(bits: Column) -> Column:
    """Is the row's ``_bucket`` set?"""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bucket").bitwiseAND(F.lit(63)).cast("int"))
    return F.get(bits, F.shiftright("_bucket", 6).cast("int")).bitwiseAND(one) != 0


def frequent_terms(
    occurrences: DataFrame,
    count: Callable[[DataFrame], DataFrame],
    qualify: Callable[[DataFrame], DataFrame],
    n: int | None,
    total: str = "total",
    bits: int = BUCKET_BITS,
    terms: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Exact counts of the terms that can be among the ``n`` most frequent, and these ``n``.

    ``occurrences`` has a row per occurrence with the column ``term``, and is read two or three
    times, so it should come of a table; ``terms`` may give the same terms at less cost, for the
    counts by bucket.  ``count`` turns occurrences into counts, ``qualify`` turns
    counts into one row per allowed term with its ``total`` occurrences; the smaller term wins a tie.

    Occurrences are counted by hash bucket first: at most ``2**bits`` numbers leave a task.  A
    term can't be more frequent than its bucket, so with a lower bound for the n-th
    largest total, only terms of buckets that reach it are counted by themselves.
    The bound is guessed from the buckets.  When the n-th term found reaches the guess, no
    term outside can get in.  Otherwise that term's total is a true bound, and a second
    count with it is final; without ``n`` allowed terms everything is counted.
    This is a job: the counts are written, and all that follows reads them.
    """
    if n is None:
        counts = written(count(occurrences))
        return counts, qualify(counts)
    hashed = bucketed(occurrences, bits)
    plain = hashed if terms is None else bucketed(terms, bits)
    buckets = written(plain.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")))
    guess = buckets.orderBy(F.desc("_n")).limit(2 * n).agg(F.min("_n").alias("least"), F.count(F.lit(1)).alias("found")).first()
    floor = guess.least if guess.found == 2 * n else 1
    while True:
        wanted = hashed if floor <= 1 else hashed.filter(in_map(bucket_map(buckets.filter(F.col("_n") >= floor), bits)))
        counts = written(count(wanted.drop("_bucket")))
        best = written(most_frequent(written(qualify(counts)), n, total, "term"))
        last = best.agg(F.min(total).alias("least"), F.count(F.lit(1)).alias("found")).first()
        if floor <= 1 or last.found == n and last.least >= floor:
            return counts, best
        floor = last.least if last.found == n else 1
