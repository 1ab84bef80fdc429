"""Inclusion statistics: how many events, or people by their best event, meet which rules.

Everything follows from one mask an event; the counts of rules follow from the histogram of masks, not from the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_RULES = 62


def masks(index: DataFrame, met: DataFrame, n_rules: int) -> DataFrame:
    """index with inclusion_rule_mask; met: person_id, event_id, inclusion_rule_id, distinct."""
    if n_rules > MOST_RULES:
        raise ValueError(f"a mask holds {MOST_RULES} rules at most")
    bits = met.groupBy("person_id", "event_id").agg(F.bit_or(F.expr("shiftleft(1L, inclusion_rule_id)")).alias("inclusion_rule_mask"))
    return index.join(bits, ["person_id", "event_id"], "left").withColumn("inclusion_rule_mask", F.coalesce("inclusion_rule_mask", F.lit(0).cast("long")))


def best_events(masked: DataFrame) -> DataFrame:
    """For each person the event that meets most rules; of these the one with the smallest rule, then the earliest."""
    smallest = F.when(F.col("inclusion_rule_mask") == 0, 0).otherwise(F.expr("bit_count((inclusion_rule_mask & -inclusion_rule_mask) - 1)"))
    order = Window.partitionBy("person_id").orderBy(F.desc(F.bit_count("inclusion_rule_mask")), smallest, "start_date", "event_id")
    return masked.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def _labelled(cohort_id: int, mode: int, *columns) -> list:
    return [F.lit(cohort_id).cast("long").alias("cohort_definition_id"), *columns, F.lit(mode).cast("int").alias("mode_id")]


def inclusion_result(masked: DataFrame, cohort_id: int, mode: int) -> DataFrame:
    return masked.groupBy("inclusion_rule_mask").agg(F.count("*").alias("person_count")).select(*_labelled(cohort_id, mode, "inclusion_rule_mask", "person_count"))


def inclusion_stats(masked: DataFrame, n_rules: int, cohort_id: int, mode: int) -> DataFrame:
    """For each rule: events that meet it, events that fail it alone (its gain), and all events."""
    full = F.lit((1 << n_rules) - 1).cast("long")
    counts = masked.groupBy("inclusion_rule_mask").agg(F.count("*").alias("n"))
    none = masked.sparkSession.range(n_rules).select(F.col("id").cast("int").alias("rule_sequence"), F.lit(0).cast("long").alias("inclusion_rule_mask"), F.lit(0).cast("long").alias("n"))
    rows = counts.select(F.explode(F.sequence(F.lit(0), F.lit(n_rules - 1))).alias("rule_sequence"), "inclusion_rule_mask", "n").unionByName(none)
    bit = F.expr("shiftleft(1L, rule_sequence)")
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    by_rule = rows.groupBy("rule_sequence").agg(
        total(F.col("inclusion_rule_mask").bitwiseAND(bit) != 0).alias("person_count"), total(F.col("inclusion_rule_mask") == full - bit).alias("gain_count"), F.sum("n").alias("person_total"))
    return by_rule.select(*_labelled(cohort_id, mode, "rule_sequence", "person_count", "gain_count", "person_total"))


def summary_stats(masked: DataFrame, n_rules: int, cohort_id: int, mode: int) -> DataFrame:
    met_all = F.count_if(F.col("inclusion_rule_mask") == (1 << n_rules) - 1)
    return masked.agg(F.count("*").alias("base_count"), met_all.alias("final_count")).select(*_labelled(cohort_id, mode, "base_count", "final_count"))


def censor_stats(spark) -> DataFrame:
    """Kept for the table's sake: it is always empty."""
    return spark.createDataFrame([], "cohort_definition_id long, lost_count long")
