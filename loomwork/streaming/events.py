"""Windowed counts over events with late data, and running means of response metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours", *, time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """start, key, n, total for every window; works on streams (events later than late are dropped) and on tables alike."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", *, time: str = "ts", key: str = "user_id") -> DataFrame:
    """start, end, key, n of runs of events with no gap."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def running_means(responses: DataFrame, keys: Sequence[str], metrics: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's sums and counts to path under its batch number; means() reads them back. A batch that is run again overwrites its own part, so each response counts once."""

    def part(batch: DataFrame, number: int) -> None:
        sums = [a for m in metrics for a in (F.sum(m).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n"))]
        batch.groupBy(*keys).agg(*sums).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return responses.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def means(parts: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(*[(F.sum(f"{m}_sum") / F.sum(f"{m}_n")).alias(m) for m in metrics])
