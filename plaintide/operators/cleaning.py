"""From raw review rows to the clean review table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plaintide import rules
from plaintide.functions import labels, text
from plaintide.operators.ids import dense_id
from plaintide.operators.once import once
from plaintide.schema import require_columns, select_existing

KEPT = ["product_name", "brand", "price", "rating", "review_text", "review_votes"]
MIN_LENGTH = 5


def normalize_na(
    df: DataFrame, columns: Sequence[str] | None = None, words: Sequence[str] = rules.NA_WORDS
) -> DataFrame:
    """Turn the missing-value words of text columns into nulls."""
    wanted = set(columns or [name for name, kind in df.dtypes if kind == "string"])
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(list(words)), F.col(f"`{c}`")).alias(c) if c in wanted else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def standardize_columns(df: DataFrame) -> DataFrame:
    """Rename the raw columns; the text and the rating must be there."""
    return require_columns(df.withColumnsRenamed(rules.RAW_COLUMNS), ["review_text", "rating"])


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per ``key`` in the unique ``order``.

    Copies collapse in the tasks that read them and rows meet under a digest, so a text
    that fills a third of the table is no hot key.  A row travels as one value: whoever
    reads the result twice, as the id job does, reads one shuffle.
    """
    best = F.min_by(F.struct(*df.columns), F.col(order)).alias("_first")
    return df.groupBy(_digest(F.col(key)).alias("_digest")).agg(best).select("_first.*")


def dedup_first(df: DataFrame, key: str = "review_text", order: str = "ordinal") -> DataFrame:
    """Keep the first row of every set of rows with the same ``key``."""
    return first_rows(df, key, order)


def long_enough(df: DataFrame, column: str = "review_text", minimum: int = MIN_LENGTH) -> DataFrame:
    """Strictly longer than ``minimum`` characters."""
    return df.filter(F.length(column) > minimum)


def cleaned(df: DataFrame, order: str = "ordinal", extra: Sequence[str] = ()) -> DataFrame:
    """Stateless part: known columns, clean text, short rows dropped."""
    columns = [order, *[c for c in KEPT if c in df.columns], *extra]
    return long_enough(once(df.select(*columns), {"review_text": text.clean_text(F.col("review_text"))}))


def clean_reviews(raw: DataFrame, order: str = "ordinal") -> DataFrame:
    """The whole cleaning job on raw columns plus a unique integer ``order``.

    Texts are cleaned in one scan; first rows are shuffled once by digest and, with
    their ids, once by id bucket.  Numbers may come as text: a rating that is none gets
    no label and, like the others, null.
    """
    named = standardize_columns(raw)
    rows = cleaned(named, order)
    textual = [c for c in ("price", "rating", "review_votes") if dict(named.dtypes).get(c) == "string"]
    numeric = "rating" not in textual
    result = (
        dense_id(first_rows(rows, "review_text", order), order, "review_id")
        .withColumn("sentiment_label", labels.rating_sentiment(F.col("rating"), numeric))
        .withColumn("date", F.lit(None).cast("date"))
        .withColumn("issue_label", F.lit(None).cast("string"))
        .withColumns({c: text.parse_double(F.col(c)) for c in textual})
    )
    return select_existing(
        result, ["review_id", *KEPT, "sentiment_label", "date", "issue_label"]
    )


def usable_reviews(
    df: DataFrame, text_col: str = "review_text", label_col: str = "sentiment_label"
) -> DataFrame:
    """Rows with a label and a text that is not blank; the text is stripped."""
    known = df.dropna(subset=[text_col, label_col])
    return once(known, {text_col: text.strip(F.col(text_col))}).filter(F.col(text_col) != "")


def labeled_rows(
    df: DataFrame, text_col: str, label_col: str, valid: Sequence[str]
) -> DataFrame:
    """Rows with a text and one of the valid labels, after normalising the label."""
    normalized = {
        text_col: text.strip(F.coalesce(F.col(text_col), F.lit("nan"))),
        label_col: text.normalized_label(F.col(label_col)),
    }
    return once(df, normalized).filter((F.col(text_col) != "") & F.col(label_col).isin(list(valid)))


def by_sentiment(df: DataFrame, sentiment: str = "negative") -> DataFrame:
    """Rows of one sentiment; ``all`` keeps every row."""
    return df if sentiment.lower() == "all" else df.filter(F.col("sentiment_label") == sentiment)
