"""Log and chunk ingestion as Structured Streaming.

Backpressure, retries and exactly-once files come from the engine: a bounded number of files a
trigger, a checkpoint, and a batch sink that replaces what a repeated batch wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.operators.stores import LOG_DAYS, sanitized

MESSAGE_LIMIT = 4000


def clean_logs(lines: DataFrame, event_time: str = "createdAt") -> DataFrame:
    """Log rows ready to store: messages clipped, metadata without secrets. Batch or stream."""
    m = F.coalesce("message", F.lit(""))
    return lines.withColumns({"message": F.when(F.length(m) <= MESSAGE_LIMIT, m).otherwise(F.concat(F.substring(m, 1, MESSAGE_LIMIT), F.lit("…"))), "meta": sanitized(F.col("meta"))})


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def store_stream(lines: DataFrame, path: str, checkpoint: str):
    """Append cleaned logs; each micro-batch owns a folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return clean_logs(lines).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def level_counts(lines: DataFrame, window: str = "1 day") -> DataFrame:
    """Counts by level and window. In append or update mode windows leave the state after the
    retention period; complete mode keeps every window."""
    return lines.withWatermark("createdAt", f"{LOG_DAYS} days").groupBy(F.window("createdAt", window), "level").agg(F.count("*").alias("n"))


def once(lines: DataFrame, delay: str = "1 hour", key: str = "id", event_time: str = "createdAt") -> DataFrame:
    """Each line once, though its source delivers at least once: copies that come within `delay` of
    each other are dropped. State holds the keys of that time only. Lines without a key or time go."""
    return lines.where(F.col(key).isNotNull() & F.col(event_time).isNotNull()).withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def closed_windows(lines: DataFrame, window: str = "1 day", delay: str = "1 hour", key: str = "id") -> DataFrame:
    """day, level, n: counts of each line once, by window and level, for append mode.

    A window is written when the watermark has passed its end, once and for good, and then leaves the
    state, so a stream of any length holds the windows and keys within `delay` and one window.
    """
    counts = once(lines, delay, key).groupBy(F.window("createdAt", window), "level").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "level", "n")


def store_windows(counts: DataFrame, path: str, checkpoint: str):
    """Append closed windows; files of a batch that is run again are not counted twice."""
    return counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest_stream(items: DataFrame, path: str, checkpoint: str, to_chunks, index: str | None = None):
    """Issues as they arrive: each micro-batch becomes chunks that take the place of their pages.

    A date may come in several batches, and a repeated batch changes nothing. index: a folder of
    index segments in which the dates of a batch are replaced, so that no other date is tokenised.
    """
    from fascicle.operators.segments import replace_dates
    from fascicle.sources.tables import merge_pages

    def write(batch: DataFrame, _: int) -> None:
        dates = merge_pages(to_chunks(batch), path)
        if index and dates:
            table = batch.sparkSession.read.parquet(path)
            replace_dates(table.where(F.col("date").cast("string").isin(dates)), index, dates)

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
