"""The time-bin operators over unbounded input: Structured Streaming with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, time: str, rule: str, aggregates: dict[str, tuple[str, str]], keys: list[str] | None = None, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates by window and keys: new -> (column, function). State older than the watermark is dropped."""
    from tessera.nulls import aggregate

    window = F.window(F.col(time).cast("timestamp"), rule, slide) if slide else F.window(F.col(time).cast("timestamp"), rule)
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    made = rows.groupBy(window.alias("w"), *(keys or [])).agg(*[aggregate(how, F.col(c)).alias(n) for n, (c, how) in aggregates.items()])
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(keys or []), *aggregates)


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], aggregates: dict[str, tuple[str, str]], late: str = "10 minutes") -> DataFrame:
    from tessera.nulls import aggregate

    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    made = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[aggregate(how, F.col(c)).alias(n) for n, (c, how) in aggregates.items()])
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)
