"""Session helpers: a tuned builder and tables in the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "plaintide", master: str | None = None, **conf: str) -> SparkSession:
    """A session for local runs; on a cluster the submitter's settings stay in force."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else Spark's warehouse; a cluster shares both.

    An unset checkpoint folder with a warehouse on local disk is an error on a cluster, whose
    machines would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = named or spark.conf.get("spark.sql.warehouse.dir")
    local = spark.sparkContext.master.startswith("local")
    if not (named or local) and (folder.startswith(("file:", "/")) or "://" not in folder):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return folder.rstrip("/")


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back, for jobs that read a table many times.

    Cuts the lineage so that a lost executor costs a re-read.  Operators don't call it:
    building a DataFrame starts no job.  ``codec`` is for tables of texts, which ``zstd`` makes smaller
    than the session's own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
