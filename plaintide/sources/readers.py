"""Reading reviews, tables and label maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from plaintide import rules
from plaintide.functions.text import parse_double
from plaintide.operators.cleaning import normalize_na
from plaintide.sources.quoted_csv import read_quoted

BOM = "﻿"
FILE_BITS = 40


def read_reviews(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType | None = None,
    multi_line: bool = True,
    ordinal: str | None = None,
    split: bool = False,
) -> DataFrame:
    """CSV with a header; cells may hold quoted line ends, columns are found by name.

    Missing-value words become null and the columns named in ``schema`` get its
    types (null where a cell does not fit).  Spark's reader takes a file with line ends inside cells as
    one task; with ``split`` a file is read by many tasks, if its quotes enclose whole cells
    and its columns are those of the first file.  ``ordinal`` names a
    column that is unique and ascends by file name and position, with gaps.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    names = [c.removeprefix(BOM) for c in raw.columns]
    if split:
        raw = read_quoted(spark, path, names, ordinal, FILE_BITS)
    elif ordinal:
        raw = _numbered(raw, ordinal)
    names += [ordinal] if ordinal else []
    typed = normalize_na(raw.toDF(*names), [c for c in names if c != ordinal])
    if schema is None:
        return typed
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    kinds = {f.name: f.dataType for f in schema.fields}
    return typed.select(
        *[_cast(f"`{c}`", kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in names]
    )


def _cast(column: str, kind: T.DataType):
    c = F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return parse_double(c).cast(kind)
    if isinstance(kind, T.IntegralType):
        # Whole numbers may be written as 3 or 3.0.
        return F.coalesce(c.try_cast(kind), parse_double(c).try_cast(kind))
    return c if isinstance(kind, T.StringType) else c.try_cast(kind)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """A unique number that ascends by file name and by position in the file.

    It is made of the rank of the file, the byte at which the row's block starts and the
    row's place in its task; a block that doesn't end its file fills a task alone, and a
    row is a byte at least, so numbers of later blocks are larger.  The rows stay
    where they are; the ranks, a row per file, come from the listing Spark already has.
    """
    files = sorted(df.inputFiles())
    ranks = df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "_file STRING, _rank BIGINT")
    at = df.select(
        "*", F.input_file_name().alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )
    number = F.shiftleft(F.col("_rank"), FILE_BITS) + F.col("_start") + F.col("_row")
    return at.join(ranks, "_file").select(*[F.col(f"`{c}`") for c in df.columns], number.alias(name))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table another job wrote."""
    return spark.read.parquet(path)


def read_label_mapping(spark: SparkSession, folder: str, default: Sequence[str] = tuple(rules.ISSUES)) -> DataFrame:
    """(label_id, label) from ``label_mapping.json`` in ``folder``, or the default."""
    fallback = spark.createDataFrame(list(enumerate(default)), "label_id INT, label STRING")
    try:
        mapping = (
            spark.read.schema("id2label MAP<STRING, STRING>")
            .option("multiLine", True)
            .json(f"{folder.rstrip('/')}/label_mapping.json")
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return fallback
        raise
    known = mapping.select(F.explode("id2label")).select(
        F.col("key").cast("int").alias("label_id"), F.col("value").alias("label")
    )
    return fallback if known.isEmpty() else known
