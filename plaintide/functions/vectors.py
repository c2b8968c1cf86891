"""Expressions over numeric arrays: ranking, norms, distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(
        total(
            F.zip_with(
                a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
            )
        )
    )


def ranked(probabilities: Column, labels: Sequence[str], k: int) -> Column:
    """The k most probable classes as (rank, label, confidence); ties by label id."""
    names = F.array(*[F.lit(x) for x in labels])
    keyed = F.transform(
        probabilities,
        lambda p, i: F.struct((-p).alias("order"), i.alias("id"), p.alias("confidence")),
    )
    return F.transform(
        F.slice(F.sort_array(keyed), 1, k),
        lambda x, i: F.struct(
            (i + 1).cast("int").alias("rank"),
            F.get(names, x["id"]).alias("label"),
            x["confidence"].alias("confidence"),
        ),
    )
