"""The stateless operators on a stream of reviews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plaintide.functions import labels, text
from plaintide.operators import scoring
from plaintide.operators.annotate import with_first_match


def _cleaned(stream: DataFrame) -> DataFrame:
    return stream.withColumn("review_text", text.clean_text(F.col("review_text")))


def rejected_reviews(stream: DataFrame, ident: str = "ordinal") -> DataFrame:
    """(id, reason) of the reviews that have no text once they are cleaned."""
    return scoring.rejects(_cleaned(stream), ident)


def scored_reviews(stream: DataFrame) -> DataFrame:
    """Clean, label and triage reviews as they arrive; no state is kept."""
    labeled = with_first_match(scoring.not_blank(_cleaned(stream))).withColumn("rating_label", labels.rating_sentiment(F.col("rating")))
    probable = scoring.rating_sentiment_probabilities(scoring.keyword_issue_probabilities(labeled))
    return scoring.score_feedback(probable).drop("issue_probs", "sentiment_probs")


def _appended(rows: DataFrame, path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def start_scoring(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append scored reviews to a table at ``path``."""
    return _appended(scored_reviews(stream), path, checkpoint, available_now)


def start_rejects(
    stream: DataFrame, path: str, checkpoint: str, ident: str = "ordinal", available_now: bool = True
) -> StreamingQuery:
    """Append the rejects to a table at ``path``; with :func:`start_scoring` no review is lost."""
    return _appended(rejected_reviews(stream, ident), path, checkpoint, available_now)


def run_batches(start: Callable[[], StreamingQuery], stop_after: int | None = None) -> None:
    """Run a query to its end, or stop it once ``stop_after`` batches are done; its checkpoint lets it go on."""
    query = start()
    while not query.awaitTermination(1):
        done = query.lastProgress
        if stop_after is not None and done and done["batchId"] + 1 >= stop_after:
            query.stop()
            return


def feedback_stream(
    spark: SparkSession, source: str, schema: StructType, out: str, ident: str = "ordinal", files_per_batch: int = 1, stop_after: int | None = None
) -> None:
    """Score the Parquet files below ``source`` that no earlier run has read, in batches of some files.

    Scored rows go to ``out``/feedback, rejects to ``out``/feedback_rejects.  Sources and sinks keep
    what they have done below ``out``/checkpoints, so a run that was stopped goes on where
    it was, and no row is written twice or lost.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    run_batches(lambda: start_scoring(stream, f"{out}/feedback", f"{out}/checkpoints/feedback"), stop_after)
    run_batches(lambda: start_rejects(stream, f"{out}/feedback_rejects", f"{out}/checkpoints/feedback_rejects", ident), stop_after)
