"""Streams: trailing message counts and repeatable loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.sources.loading import append_new


def windowed_counts(events: DataFrame, by: str, time: str, length: str = "24 hours", slide: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows per key and sliding window; state is bounded by the watermark, later rows are left out."""
    stamped = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return stamped.groupBy(F.window("_at", length, slide).alias("w"), by).agg(F.count(F.lit(1)).alias("rows")).select(by, F.col("w.start")
        .alias("start"), F.col("w.end").alias("end"), "rows")


def over_limit(counts: DataFrame, most: int = 20) -> DataFrame:
    """Keys with more than ``most`` rows in a window."""
    return counts.filter(F.col("rows") > most)


def load_stream(stream: DataFrame, path: str, key: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append each batch's new keys to ``path``; a batch that is run again adds nothing. Takes what there is, then ends."""

    def load(batch: DataFrame, _: int) -> None:
        append_new(prepare(batch) if prepare else batch, path, key)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent(df: DataFrame, time: str, now, seconds: int = 15) -> DataFrame:
    """Rows at most ``seconds`` old."""
    return df.filter(F.col(time) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {seconds} seconds"))
