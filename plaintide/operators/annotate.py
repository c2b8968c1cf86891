"""Keyword labels, missing-label fill, review flags and corrections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from plaintide import rules
from plaintide.functions import labels, text
from plaintide.operators.once import once
from plaintide.schema import BOOTSTRAP_COLUMNS, require_columns

SUBSTRING, WORD = "substring", "word"


def with_keyword_label(
    df: DataFrame,
    label_col: str,
    score_col: str,
    rules_table: Mapping[str, Sequence[str]] = rules.ISSUE_KEYWORDS,
    text_col: str = "review_text",
    mode: str = SUBSTRING,
) -> DataFrame:
    """Label with the most keywords in the text, the first one on a tie."""
    names = {label: f"_hits_{label}" for label in rules_table}
    return (
        with_keyword_hits(df, rules_table, names, text_col, mode)
        .withColumn(score_col, F.greatest(*names.values()))
        .withColumn(
            label_col,
            labels.first_best({k: F.col(v) for k, v in names.items()}, F.col(score_col), "other"),
        )
        .drop(*names.values())
    )


def _lowered(df: DataFrame, text_col: str) -> DataFrame:
    return once(df, {"_lower": F.lower(F.coalesce(text_col, F.lit("")))})


def _by_words(mode: str) -> bool:
    if mode not in (SUBSTRING, WORD):
        raise ValueError(f"mode is {SUBSTRING!r} or {WORD!r}, not {mode!r}")
    return mode == WORD


def _searched(df: DataFrame, rules_table: Mapping[str, Sequence[str]], text_col: str) -> DataFrame:
    """Rows with ``_found``: the phrases of all rules in the text, which is split once."""
    keywords = [k for words in rules_table.values() for k in words]
    split = once(df, {"_words": text.words(F.coalesce(text_col, F.lit("")))})
    return once(split, {"_found": labels.phrases_found(F.col("_words"), keywords)}).drop("_words")


def with_keyword_hits(
    df: DataFrame,
    rules_table: Mapping[str, Sequence[str]],
    names: Mapping[str, str],
    text_col: str = "review_text",
    mode: str = SUBSTRING,
) -> DataFrame:
    """One count column per label, from a text lowered once.

    In mode ``word`` 'os' isn't found in 'those': texts are split once and all keywords of
    all labels looked up together.
    """
    if _by_words(mode):
        counts = {names[label]: labels.phrase_hits(F.col("_found"), words) for label, words in rules_table.items()}
        return once(_searched(df, rules_table, text_col), counts).drop("_found")
    counts = {names[label]: labels.keyword_hits(F.col("_lower"), words) for label, words in rules_table.items()}
    return once(_lowered(df, text_col), counts).drop("_lower")


def with_first_match(
    df: DataFrame, label_col: str = "issue_label", text_col: str = "review_text", mode: str = SUBSTRING,
    rules_table: Mapping[str, Sequence[str]] = rules.FIRST_MATCH_KEYWORDS,
) -> DataFrame:
    """Label of the first rule with any keyword in the text, as a substring or in mode ``word`` as whole words."""
    if _by_words(mode):
        found = _searched(df, rules_table, text_col)
        return once(found, {label_col: labels.first_phrase(F.col("_found"), rules_table)}).drop("_found")
    label = labels.first_match(F.col("_lower"), rules_table)
    return once(_lowered(df, text_col), {label_col: label}).drop("_lower")


def fill_issue_label(df: DataFrame, label_col: str = "issue_label", text_col: str = "review_text") -> DataFrame:
    """Normalise the label; where it is blank or 'nan', take the keyword label."""
    label = F.col("_label")
    return (
        with_keyword_label(df, "_rule", "_score", text_col=text_col)
        .withColumn("_label", text.normalized_label(F.col(label_col)))
        .withColumn(label_col, F.when(label.isin("", "nan"), F.col("_rule")).otherwise(label))
        .drop("_rule", "_score", "_label")
    )


def flag_for_review(df: DataFrame) -> DataFrame:
    """Starting labels for annotators, with a flag and the reason to look again.

    Of several reasons the strongest one is given.
    """
    require_columns(df, ["review_text", "sentiment_label", "rule_issue_label"])
    manual, guess = F.col("manual_issue_label"), F.col("keyword_guess_label")
    reason = (
        F.when(
            (F.col("sentiment_label") == "positive") & manual.isin(rules.POSITIVE_DOUBTFUL),
            rules.REASON_POSITIVE,
        )
        .when(
            (F.col("sentiment_label") == "negative") & manual.isin(rules.NEGATIVE_DOUBTFUL),
            rules.REASON_NEGATIVE,
        )
        .when((F.col("keyword_guess_score") > 0) & (guess != manual), rules.REASON_CONFLICT)
        .when(manual == "other", rules.REASON_OTHER)
        .otherwise("")
    )
    flagged = (
        with_keyword_label(df, "keyword_guess_label", "keyword_guess_score", rules.GUESS_KEYWORDS)
        .withColumn("rule_issue_label", text.normalized_label(F.col("rule_issue_label")))
        .withColumn("manual_issue_label", labels.one_of(F.col("rule_issue_label"), rules.ISSUES))
        .withColumn("review_reason", reason)
        .withColumn("needs_review", F.when(F.col("review_reason") != "", "yes").otherwise("no"))
    )
    return flagged.select(*[c for c in BOOTSTRAP_COLUMNS if c in flagged.columns])


def apply_corrections(
    df: DataFrame, corrections: DataFrame, key: str = "review_id", label_col: str = "manual_issue_label",
    order: str | None = None,
) -> DataFrame:
    """Replace labels by the reviewed ones.

    Of several corrections of a review the last in ``order`` holds, or the greatest
    label when there is no such column; a correction without a label is none.
    """
    known = corrections.filter(F.col("corrected_label").isNotNull())
    last = F.max_by("corrected_label", F.struct(order, "corrected_label")) if order else F.max("corrected_label")
    fixed = known.groupBy(key).agg(last.alias("_corrected"))
    return (
        df.join(fixed, key, "left")
        .withColumn(label_col, F.coalesce("_corrected", label_col))
        .select(*df.columns)
    )
