"""Progress of long encodes: totals and speed from events of (processed, total)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds between two events that a speed is taken from, at least.
LEAST = 0.2


def speed(events: DataFrame, key: str, at: str = "at", processed: str = "processed", total: str = "total") -> DataFrame:
    """``events`` and speed (bytes a second since the event before, null if too close) and eta (seconds left)."""
    w = Window.partitionBy(key).orderBy(at)
    gap, done = F.col(at) - F.lag(at).over(w), F.col(processed) - F.lag(processed).over(w)
    timed = events.withColumn("speed", F.when((gap >= LEAST) & (done >= 0), done / gap))
    return timed.withColumn("eta", F.when(F.col("speed") > 0, (F.col(total) - F.col(processed)) / F.col("speed")))


def running(steps: DataFrame, key: str, at: str = "at", done: str = "done", total: str = "total") -> DataFrame:
    """``steps`` (``done`` bytes each) and processed, the running total, and share, its part of the whole in percent."""
    so_far = F.sum(done).over(Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("processed", so_far).withColumn("share", F.col("processed") * 100.0 / F.greatest(F.col(total), F.lit(1)))


def stage_profile(timed: DataFrame, *keys: str) -> DataFrame:
    """keys, stage, blocks, nanoseconds: time spent in each stage, from rows (stage, ns)."""
    return timed.groupBy(*keys, "stage").agg(F.count(F.lit(1)).alias("blocks"), F.sum("ns").alias("nanoseconds"))
