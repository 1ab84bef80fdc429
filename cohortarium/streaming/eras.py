"""Eras over a stream: the batch operator's unending counterpart.

An era is a session window of a person whose gap is the pad; events later than the watermark's delay are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_eras(events: DataFrame, pad_days: int, delay: str = "7 days", key: str = "person_id", time: str = "start_time") -> DataFrame:
    """(key, era_start, era_end, n_events) of events (key, time) whose gaps are shorter than a day more than the pad."""
    sessions = events.withWatermark(time, delay).groupBy(key, F.session_window(time, f"{pad_days + 1} days").alias("w"))
    return sessions.agg(F.min(time).alias("era_start"), F.max(time).alias("era_end"), F.count("*").alias("n_events")).select(key, "era_start", "era_end", "n_events")
