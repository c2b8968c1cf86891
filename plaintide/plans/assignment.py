"""Nearest centres and moving centres: jobs for any number of centres and for new reviews."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from plaintide.operators import clusters
from plaintide.operators.ids import dense_id, small_rank, top_ids
from plaintide.session import written


def assign_to_centers(
    df: DataFrame, centers: DataFrame, ident: str = "review_id", vector: str = "embedding", cluster: str = "cluster_id",
    name: str = "distance_to_cluster_center", max_numbers: int = clusters.MAX_CENTER_NUMBERS,
) -> DataFrame:
    """``df`` with the nearest centre and its distance, for any number of centres; the lower id wins a tie.

    Up to ``max_numbers`` numbers the centres travel as one value, as in
    ``clusters.nearest_center``.  More are dealt into blocks of that size by their place in the order
    of ids.  Each block goes past the ids and vectors of all rows by itself, and leaves
    (id, distance, centre) behind; the least of these per id is the answer, merged in one shuffle.
    ``ident`` is unique and the centres' ids are integers; ``df`` should be a table.
    """
    table = written(centers.select(F.col(cluster).alias(cluster), "center"))
    n, numbers = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("center")), F.lit(0))).first()
    if numbers <= max_numbers:
        return clusters.nearest_center(df, table, vector, cluster, name)
    per_block = max(1, max_numbers * n // numbers)
    placed = written(dense_id(table, cluster, "_place").withColumn("_block", F.floor((F.col("_place") - 1) / per_block)))
    bare = df.select(ident, vector)
    found = []
    for block in range(-(-n // per_block)):
        part = placed.filter(F.col("_block") == block).select(cluster, "center")
        best = clusters.nearest_center(bare, part, vector, cluster, name)
        found.append(written(best.select(ident, F.struct(F.col(name).alias("distance"), F.col(cluster).alias("id")).alias("_best"))))
    least = functools.reduce(DataFrame.unionByName, found).groupBy(ident).agg(F.min("_best").alias("_best"))
    return df.join(least, ident).withColumns({cluster: F.col("_best.id"), name: F.col("_best.distance")}).drop("_best").select(
        *[c for c in df.columns if c not in (cluster, name)], cluster, name
    )


def _key(seed: int, step: int, ident: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{step}:"), F.col(ident).cast("string")).cast("binary"))


def _hex_share(share: float) -> str:
    """Digests below this text are a ``share`` of all; one above all digests for 1."""
    return "g" if share >= 1 else f"{int(share * 16**8):08x}".rstrip("0") or "0"


def first_centers(df: DataFrame, k: int, ident: str = "review_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """A state (cluster_id, center, n) of the ``k`` rows that the hash of their id draws, seen 0 times."""
    drawn = top_ids(df.select(_key(seed, 0, ident).alias("_key"), ident), k, "_key", ident).select(ident, "_key")
    ranked = small_rank(drawn, "cluster_id", "_key", ident).select((F.col("cluster_id") - 1).alias("cluster_id"), ident)
    center = F.col(vector).cast("array<double>").alias("center")
    return ranked.join(df.select(ident, center), ident).select("cluster_id", "center", F.lit(0).cast("bigint").alias("n"))


def move_centers(state: DataFrame, rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The state after a batch: each centre goes to the mean of all rows it has seen, weighted by their number.

    ``rows`` may be reviews that came later: old centres move by what is new.  Sums per centre
    are merged in the tasks, so a large cluster is no hot key.
    """
    near = clusters.nearest_center(rows.select(vector), state.select("cluster_id", "center"), vector)
    mean = clusters.cluster_centers(near, vector).withColumnRenamed("center", "_mean")
    seen = near.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_b"))
    joined = state.join(mean.join(seen, "cluster_id"), "cluster_id", "left")
    step = F.col("_b") / (F.col("n") + F.col("_b"))
    moved = F.when(F.col("_b") > 0, F.zip_with("center", "_mean", lambda c, m: c + (m - c) * step)).otherwise(F.col("center"))
    return joined.select("cluster_id", moved.alias("center"), (F.col("n") + F.coalesce("_b", F.lit(0))).alias("n"))


def reseed(state: DataFrame, batch: DataFrame, key: Column, ident: str, vector: str = "embedding", ratio: float = 0.01) -> DataFrame:
    """Centres that have seen less than ``ratio`` of what the busiest has seen start again from rows of the batch.

    They count as often as the least busy of the others, so they neither jump nor stick.
    """
    busiest = F.col("_most") * ratio
    marked = written(state.withColumn("_most", state.agg(F.max("n")).scalar()).withColumn("_starved", F.col("n") < busiest).drop("_most"))
    starved = marked.filter("_starved")
    n = starved.count()
    if not n:
        return marked.drop("_starved")
    others = marked.filter("not _starved").agg(F.min("n")).scalar()
    drawn = top_ids(batch.select(key.alias("_key"), ident), n, "_key", ident)
    drawn = small_rank(drawn.select("_key", ident), "_nth", "_key", ident).join(batch.select(ident, F.col(vector).cast("array<double>").alias("_new")), ident)
    placed = small_rank(starved.select("cluster_id"), "_nth", "cluster_id").join(drawn.select("_nth", "_new"), "_nth")
    fresh = marked.join(placed.select("cluster_id", "_new"), "cluster_id", "left").withColumn("_others", others)
    return fresh.select(
        "cluster_id", F.coalesce("_new", "center").alias("center"), F.when(F.col("_new").isNotNull(), F.col("_others")).otherwise(F.col("n")).alias("n")
    )


def minibatch_kmeans(
    df: DataFrame, start: DataFrame, ident: str = "review_id", vector: str = "embedding", share: float = 0.1, steps: int = 100,
    tol: float = 1e-3, patience: int | None = 3, ratio: float = 0.01, reseed_every: int | None = None, seed: int = 42,
) -> DataFrame:
    """The state (cluster_id, center, n) after mini-batches of ``share`` of the rows.

    ``start`` is such a state: ``first_centers``, or that of an earlier run.  The rows of a batch are
    those whose digest of seed, step and id is small, so results don't depend on partitions.
    The run ends when the centres together move less than ``tol`` for ``patience`` batches in a
    row, at ``steps`` at the latest.  Every ``reseed_every`` steps starved centres start again.
    Each step writes its state, which cuts the lineage.
    """
    state, calm = written(start.select("cluster_id", F.col("center").cast("array<double>").alias("center"), F.col("n").cast("bigint").alias("n"))), 0
    for step in range(1, steps + 1):
        key = _key(seed, step, ident)
        batch = df.filter(key < _hex_share(share)).select(ident, vector)
        after = written(move_centers(state, batch, vector))
        if reseed_every and step % reseed_every == 0:
            after = written(reseed(after, batch, key, ident, vector, ratio))
        if patience is not None:
            gap = F.aggregate(F.zip_with("center", "_old", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
            old = state.select("cluster_id", F.col("center").alias("_old"))
            moved = after.join(old, "cluster_id").agg(F.coalesce(F.sum(gap), F.lit(0.0))).first()[0]
            calm = calm + 1 if moved**0.5 < tol else 0
        state = after
        if patience is not None and calm >= patience:
            break
    return state
