"""The same event operators on unbounded input.

Late rows are dropped by the watermark; with `delay` at least the greatest
lateness the results equal the batch results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_slices(events: DataFrame, at: str = "ts", length: str = "6 seconds", delay: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Rows, distinct users by sketch, and value sums per time slice; sliding if `slide` is given."""
    sliced = events.withWatermark(at, delay).groupBy(F.window(at, length, slide) if slide else F.window(at, length))
    out = sliced.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return out.select(F.col("window.start").alias("slice_start"), "n", "total", "first_at", "last_at")


def sessions(events: DataFrame, by: str, at: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each key, closed by a gap (an extension: the batch operators have no sessions)."""
    grouped = events.withWatermark(at, delay).groupBy(F.session_window(at, gap), by)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("from_at"), F.col("session_window.end").alias("to_at"), "n")


def without_repeats(events: DataFrame, keys: list[str], at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """One row per key among those within the watermark; state is dropped behind it."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def running_users(events: DataFrame, by: str = "user_id", at: str = "ts") -> DataFrame:
    """Records, first and last time and value sum of each key, updated as rows come.  Texts are not kept: state stays small."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.sum("value").alias("total"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write all that is there and stop: a bounded run of a stream, restartable from its checkpoint."""
    if mode == "append":
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
