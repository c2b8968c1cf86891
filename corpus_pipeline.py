"""From raw documents to packed training sequences: five stages, each a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plaintide.llm import jaccard, line_dedup, packing, suffix_dedup, toxicity
from plaintide.llm.common import fresh, work_folder


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels beside them, doesn't call toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (row,) = fresh(docs, "_row")
    clash = [c for c in docs.columns if c.lower() in ("score", "predicted", "passages")]
    if not clash:
        return toxicity.score(docs, model, keep=docs.columns).filter("predicted = 0").select(*docs.columns)
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    stays = toxicity.score(rows, model, keep=[row]).filter("predicted = 0")
    return rows.join(stays.select(row), row, "left_semi").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier line go; a document left blank goes."""
    return counted(line_dedup.drop_lines(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.drop_similar(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that occur more than once go; a document left blank goes."""
    clash = {c: f"_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in ("spans", "kept")}
    cut = suffix_dedup.drop_repeats(docs.withColumnsRenamed(clash), as_text=True)
    cut = cut.filter((F.size("spans") == 0) | (F.btrim("kept", F.lit(" \t\n\r\v\f")) != ""))
    cut = cut.withColumn("text", F.when(F.size("spans") > 0, F.col("kept")).otherwise(F.col("text"))).drop("spans", "kept")
    return counted(cut.withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences, a row per piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", without_near_copies),
    ("suffix_dedup", without_repeated_passages),
    ("packing", packed),
]
#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{work_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
