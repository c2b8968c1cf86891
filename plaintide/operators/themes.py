"""Cluster themes and recommended actions, from rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plaintide import rules
from plaintide.functions import labels
from plaintide.operators.once import once
from plaintide.schema import LABELED_FIRST_COLUMNS, reorder, require_columns

THEME_TEXTS = [
    "top_keywords", "major_issue", "representative_review_1",
    "representative_review_2", "representative_review_3",
]


def theme_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster_theme").agg(F.count(F.lit(1)).alias("count"))


def label_themes(df: DataFrame) -> DataFrame:
    """Theme of every cluster: the rule with most keywords in its keywords, issue and
    reviews, plus a bonus when the rule is about its issue; the first rule wins a tie."""
    require_columns(df, ["cluster_id", "cluster_size", "top_keywords", "major_issue"])
    lowered = [F.lower(F.coalesce(c, F.lit(""))) if c in df.columns else F.lit("") for c in THEME_TEXTS]
    issue = F.lower(F.coalesce("major_issue", F.lit("")))
    names = {theme: f"_theme_{i}" for i, (theme, _, _) in enumerate(rules.THEME_RULES)}
    scores = {}
    for theme, words, issues in rules.THEME_RULES:
        bonus = F.when(F.col("_issue").isin(issues), rules.ISSUE_BONUS).otherwise(0) if issues else F.lit(0)
        scores[names[theme]] = labels.keyword_hits(F.col("_combined"), words) + bonus
    best = F.col("theme_confidence_score")
    combined = once(df, {"_combined": F.concat_ws(" ", *lowered), "_issue": issue})
    labeled = (
        once(combined, scores)
        .withColumn("theme_confidence_score", F.greatest(*names.values()))
        .withColumn(
            "cluster_theme",
            labels.first_best({t: F.col(c) for t, c in names.items()}, best, rules.DEFAULT_THEME),
        )
        .drop("_combined", "_issue", *names.values())
    )
    return reorder(labeled, LABELED_FIRST_COLUMNS)


def recommended_action(theme: Column, issue: Column, keywords: Column) -> Column:
    """Action of the first rule with a word in the theme, else in all three texts."""
    parts = [F.lower(F.coalesce(c, F.lit("nan"))) for c in (theme, issue, keywords)]
    combined = F.concat_ws(" ", *parts)
    branches = [(labels.any_keyword(parts[0], words), action) for words, action in rules.THEME_ACTIONS]
    branches += [(labels.any_keyword(combined, words), action) for words, action in rules.FALLBACK_ACTIONS]
    first = reduce(lambda case, b: case.when(*b), branches[1:], F.when(*branches[0]))
    return first.otherwise(rules.DEFAULT_ACTION)
