"""Counters of running jobs, in one piece or per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counters(events: DataFrame, by: list[str]) -> DataFrame:
    """Per job: scanned, mismatched, failed, and what follows from them.

    ``outcome`` is one of ok, mismatched, failed. The share done is rounded half up and 0 for an empty job; failed
    files count as done.
    """
    c = events.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "mismatched").alias("mismatched"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    done = F.col("total") - F.col("failed")
    percent = F.when(F.col("total") == 0, 0).otherwise(F.floor(done * 100 / F.col("total") + 0.5)).cast("bigint")
    return c.withColumns({"ok": F.greatest(F.lit(0).cast("bigint"), F.col("total") - F.col("mismatched") - F.col("failed")), "percent": percent})


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts per tumbling window of ``ts``; with ``late`` a stream drops what comes later than that."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width).alias("w"), "outcome").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "outcome", "n")


def outcome(kind):
    """The outcome that an event type stands for."""
    return F.when(kind == "error", "failed").when(kind == "purchase", "mismatched").otherwise("ok")
