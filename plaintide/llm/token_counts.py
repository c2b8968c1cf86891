"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their number of tokens.  Sums over all longer lengths then
answer, for any context limit, how many documents and tokens lie above it, what is left
when each document is cut at the limit, and which share of documents fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from plaintide.llm import bpe

BUCKET_BITS = 12


def histogram(docs: DataFrame, text: str = "text", by: Sequence[str] = (), ranks: str = bpe.BYTE_BPE) -> DataFrame:
    """(by..., length, n_docs): documents by number of tokens, counted in each task first."""
    lengths = bpe.token_lengths(docs, by, text, "length", ranks)
    return lengths.groupBy(*by, "length").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each length as a context limit: what lies at, above and under it.

    Adds docs_above, tokens_above, docs_total, tokens_total, truncated_total (tokens left when
    every document is cut at the limit), lost_tokens and share_fitting.  Between two
    lengths all but the truncated total stay the same (see ``at_limit``).  Sums run inside
    buckets of 4096 lengths and then over the buckets.
    """
    tokens = F.col("length") * F.col("n_docs")
    bucketed = hist.withColumn("_b", F.shiftright("length", BUCKET_BITS))
    totals = bucketed.groupBy(*by, "_b").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    later = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = totals.select(
        *by, "_b", F.sum("_d").over(whole).alias("docs_total"), F.sum("_t").over(whole).alias("tokens_total"),
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_d"), F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_t"),
    )
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    above = bucketed.withColumn("_id", F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("_it", F.coalesce(F.sum(tokens).over(inside), F.lit(0)))
    match = [above[c].eqNullSafe(totals[c]) for c in [*by, "_b"]]
    docs_above, tokens_above = F.col("_id") + F.col("_d"), F.col("_it") + F.col("_t")
    lost = tokens_above - F.col("length") * docs_above
    return above.join(totals, match).select(
        *[above[c] for c in by], "length", "n_docs", docs_above.alias("docs_above"), tokens_above.alias("tokens_above"),
        "docs_total", "tokens_total", (F.col("tokens_total") - lost).alias("truncated_total"), lost.alias("lost_tokens"),
        ((F.col("docs_total") - docs_above) / F.col("docs_total")).alias("share_fitting"),
    )


def at_limit(curve: DataFrame, limit: int) -> DataFrame:
    """The totals for any limit (one row, none for an empty table)."""
    above = F.col("length") > limit
    docs, tokens = F.sum(F.when(above, F.col("n_docs")).otherwise(0)), F.sum(F.when(above, F.col("length") * F.col("n_docs")).otherwise(0))
    return curve.groupBy("docs_total", "tokens_total").agg(docs.alias("docs_above"), tokens.alias("tokens_above")).withColumn(
        "truncated_total", F.col("tokens_total") - F.col("tokens_above") + limit * F.col("docs_above")
    )


def quantile(curve: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents don't exceed."""
    return curve.filter(F.col("docs_total") - F.col("docs_above") >= F.col("docs_total") * F.lit(share)).agg(F.min("length").alias("length"))


def token_counts(docs: DataFrame, text: str = "text", by: Sequence[str] = (), ranks: str = bpe.BYTE_BPE) -> DataFrame:
    """``limits`` of the histogram of ``docs``.

    A null or empty text has length 0.  Repeated rows count each time; null values in
    ``by`` are a group.  An empty table gives no rows.  Other columns don't matter.
    """
    return limits(histogram(docs, text, by, ranks), by)
