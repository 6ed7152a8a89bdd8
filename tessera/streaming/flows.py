"""The same operators on streams: new documents, log actions, late references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.frontmatter import parse_documents


def parsed_stream(documents: DataFrame) -> DataFrame:
    """Front-mattered documents parsed as they arrive; the batch operator, unchanged."""
    return parse_documents(documents)


def action_counts(events: DataFrame, time: str = "ts", action: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Actions per tumbling window; events later than ``late`` behind the newest are dropped by the watermark.

    Works on a stream and on a table, where every event counts.
    """
    stamped = events.withColumn("__at", F.col(time).cast("timestamp"))
    return (
        stamped.withWatermark("__at", late)
        .groupBy(F.window("__at", window).alias("w"), F.col(action).alias("action"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("w.start").alias("window_start"), "action", "n_events")
    )


def first_seen(records: DataFrame, key: str, time: str) -> DataFrame:
    """key, first_seen: the earliest time of each key; on a stream in update mode the state is one row per key."""
    return records.groupBy(key).agg(F.min(time).alias("first_seen"))


def validated(stream: DataFrame, rules: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Runs batch rules on each micro-batch and appends their issues; a repeated batch replaces its own rows."""

    def each(batch: DataFrame, batch_id: int) -> None:
        found = rules(batch).withColumn("batch_id", F.lit(batch_id))
        (
            found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink)
        )

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
