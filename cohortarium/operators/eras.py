"""Folding of overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(rows: DataFrame, pad: int = 0, key: str = "person_id") -> DataFrame:
    """(key, start_date, end_date) with intervals united that begin at most ``pad`` days after all before them ended.

    One shuffle by key serves both windows and the aggregation.
    """
    order = Window.partitionBy(key).orderBy("start_date", "end_date")
    before = F.max("end_date").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.date_add(before, pad) >= F.col("start_date"), 0).otherwise(1)
    numbered = rows.select(key, "start_date", "end_date").withColumn("_begins", begins).withColumn("_era", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_era").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date")).drop("_era")
