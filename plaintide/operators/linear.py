"""Linear text classifiers as tables: a row of weights per term, and one without a term for the intercepts.

Weights are joined to the terms of the rows, so neither terms nor weights pass through the
driver, and a model is written, read and inspected like any other table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaintide.operators.scoring import with_softmax


def class_term_counts(docs: DataFrame, vocabulary: DataFrame, label: str) -> DataFrame:
    """(label, term, n): occurrences of each term of the vocabulary in the ``_terms`` of each class."""
    terms = docs.select(F.col(label).alias("label"), F.explode("_terms").alias("term")).join(vocabulary.select("term"), "term")
    return terms.groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))


def _of_labels(labels: Sequence[str], value: Column) -> Column:
    """Sums of ``value`` over the rows of each label, in their order."""
    return F.array(*[F.coalesce(F.sum(F.when(F.col("label") == x, value)), F.lit(0)).cast("double") for x in labels])


def naive_bayes(
    counts: DataFrame, sizes: DataFrame, labels: Sequence[str], n_terms: Column, smoothing: Sequence[float] = (1.0,)
) -> DataFrame:
    """(smoothing, term, weights): multinomial naive Bayes for each smoothing, from one table of counts.

    ``counts`` are those of ``class_term_counts``, ``sizes`` has (label, n) with the rows of each class.
    A weight is the log of (n + a) / (all n of the class + a * terms), an intercept the log
    of (rows of the class + 1) / (rows + classes).
    """
    totals = counts.agg(_of_labels(labels, F.col("n")).alias("t")).scalar()
    per_term = counts.groupBy("term").agg(_of_labels(labels, F.col("n")).alias("_n")).withColumns({"_totals": totals, "_terms": n_terms})
    each = F.explode(F.array(*[F.lit(float(a)) for a in smoothing])).alias("smoothing")
    a = F.col("smoothing")
    weights = per_term.select(each, "*").select(
        a, "term", F.zip_with("_n", "_totals", lambda n, t: F.log((n + a) / (t + a * F.col("_terms")))).alias("weights")
    )
    rows = sizes.agg(_of_labels(labels, F.col("n")).alias("_n"))
    whole = F.aggregate("_n", F.lit(0.0), lambda s, n: s + n)
    intercepts = rows.select(each, "_n").select(
        a, F.lit(None).cast("string").alias("term"), F.transform("_n", lambda n: F.log((n + 1) / (whole + len(labels)))).alias("weights")
    )
    return weights.unionByName(intercepts)


def class_scores(
    ids: DataFrame, vectors: DataFrame, model: DataFrame, labels: Sequence[str], name: str, ident: str = "review_id", by: str | None = None
) -> DataFrame:
    """``ids`` with the class probabilities in label order, a row per value of ``by`` in the model.

    ``vectors`` has (id, term, weight).  Sums are merged in the tasks first, so a frequent
    term is no hot group, and the join's sides are Spark's choice.  A row without a known term
    gets the intercepts alone.
    """
    key = by or "_model"
    model = model if by else model.withColumn(key, F.lit(0))
    known = vectors.select(ident, "term", "weight").join(model.filter(F.col("term").isNotNull()), "term")
    sums = known.groupBy(ident, key).agg(*[F.sum(F.col("weight") * F.get("weights", F.lit(i))).alias(f"_z{i}") for i in range(len(labels))])
    intercepts = model.filter(F.col("term").isNull()).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), "weights"))).alias("i")).scalar()
    every = ids.withColumn("_each", F.explode(intercepts)).withColumns({key: F.col("_each.key"), "_base": F.col("_each.weights")}).drop("_each")
    logits = [F.get("_base", F.lit(i)) + F.coalesce(f"_z{i}", F.lit(0.0)) for i in range(len(labels))]
    scored = with_softmax(every.join(sums, [ident, key], "left"), logits, name)
    return scored.drop("_base", *[f"_z{i}" for i in range(len(labels))], *([] if by else [key]))


def best_fit(scored: DataFrame, key: str, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """(key, accuracy, macro_f1, rows, chosen) of every model on its scored rows.

    The largest macro-F1 over labels that occur as true or predicted label is chosen, of several
    models the one with the largest key, that is, the strongest penalty or smoothing.
    """
    cells = scored.groupBy(key, true, pred).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col(true).alias("label"), F.col("n").alias("support"), zero.alias("drawn"), hit.alias("hit")),
        F.struct(F.col(pred).alias("label"), zero.alias("support"), F.col("n").alias("drawn"), zero.alias("hit")),
    )
    sums = cells.select(key, F.inline(sides)).groupBy(key, "label").agg(*[F.sum(c).alias(c) for c in ("support", "drawn", "hit")])
    fits = sums.groupBy(key).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg(2 * F.col("hit") / (F.col("support") + F.col("drawn"))).alias("macro_f1"), F.sum("support").alias("rows")
    )
    place = F.row_number().over(Window.orderBy(F.desc("macro_f1"), F.desc(key)))  # a row per model
    return fits.withColumn("chosen", place == 1)
