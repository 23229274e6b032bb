"""Structured Streaming: new answers without repeats, and windows over events.

The study's loop skips a key whose file is there already; here a stream drops keys that it has
seen within the watermark. Batch and stream share the operators, since these take any DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

ANSWER = "key string, model string, stage string, question string, answer string, generated_at timestamp"


def answer_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Answers as they arrive in a folder, one JSON value a file."""
    return spark.readStream.schema(ANSWER).option("multiLine", True).option("maxFilesPerTrigger", max_files).json(path)


def new_answers(answers: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each key once; state is kept for as long as a repeat may come late."""
    return answers.withWatermark("generated_at", delay).dropDuplicatesWithinWatermark(["key"])


def flagged(answers: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """key, categories, n_words of each answer."""
    return answers.select(
        "key", "generated_at", T.categories_present(F.lower("answer"), lexicon).alias("categories"), F.size(T.simple_words(F.col("answer"))).alias("n_words")
    )


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """A stream's watermark needs a time with zone; a batch is as it is."""
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Events, users' values by window and type; late rows beyond ``delay`` are left out."""
    events = _timed(events, delay)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        events.groupBy(window.alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "max_value")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """A user's events with pauses below ``gap``."""
    events = _timed(events, delay)
    return (
        events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
    )


def write_once(stream: DataFrame, path: str, checkpoint: str):
    """Appends what has arrived and stops; exactly once by the checkpoint folder."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
