"""The engine: a cohort expression planned as DataFrames, from entry events to cohort eras and statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Cohort, CustomEra, DateOffset, Group, Primary, from_dict, from_json
from ..operators import statistics
from ..operators.context import Context
from ..operators.correlation import KEYS, group_keys
from ..operators.eras import fold
from ..operators.events import COLUMNS, events, with_observation
from ..operators.exits import censored, custom_era, date_offset, default_end
from ..sources.cdm import Cdm

QUALIFIED = ("event_id", "person_id", "start_date", "end_date", "op_start_date", "op_end_date", "visit_occurrence_id")


def limited(rows: DataFrame, limit: str | None, by: list[str]) -> DataFrame:
    """All rows, or each person's first or last."""
    if limit in (None, "All"):
        return rows
    down = limit == "Last"
    order = Window.partitionBy("person_id").orderBy(F.desc(by[0]) if down else F.col(by[0]), *by[1:])
    return rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def primary_events(ctx: Context, primary: Primary) -> DataFrame:
    """Entry events inside observation periods with the days asked for before and after, numbered within a person."""
    found = [events(ctx, c).select(*COLUMNS, F.lit(i).alias("_criterion")) for i, c in enumerate(primary.criteria)]
    rows = with_observation(ctx, reduce(DataFrame.unionByName, found))
    rows = rows.filter((F.date_add("op_start_date", primary.prior_days) <= F.col("start_date")) & (F.date_add("start_date", primary.post_days) <= F.col("op_end_date")))
    limit = primary.limit or "First"
    first = F.desc("sort_date") if limit == "Last" else F.col("sort_date")
    order = Window.partitionBy("person_id").orderBy(first, "event_id", "_criterion", "start_date", "end_date", "op_start_date")
    rows = rows.withColumn("event_id", F.row_number().over(order).cast("long"))
    return (rows if limit == "All" else rows.filter("event_id = 1")).select(*QUALIFIED)


def earliest_ends(included: DataFrame, ends: list[DataFrame]) -> DataFrame:
    """included with cohort_end: the earliest end not before the start; events without one go."""
    both = included.select("person_id", "event_id", "start_date").join(reduce(DataFrame.unionByName, ends), KEYS)
    return both.filter("end_date >= start_date").groupBy("person_id", "event_id", "start_date").agg(F.min("end_date").alias("end_date"))


@dataclass(frozen=True)
class CohortResult:
    """Lazy DataFrames of one cohort's run."""

    ctx: Context
    expression: Cohort
    cohort_id: int
    #: what several parts of the plan read (qualified events, masks, included events): stored once ("cache" or "checkpoint") or planned again.
    keep: str | None = "cache"

    @cached_property
    def primary(self) -> DataFrame:
        if not self.expression.primary or not self.expression.primary.criteria:
            raise ValueError("an expression needs primary criteria")
        return primary_events(self.ctx, self.expression.primary)

    @cached_property
    def qualified(self) -> DataFrame:
        rows, group = self.primary, self.expression.additional
        if group and not group.empty:
            rows = rows.join(group_keys(self.ctx, rows, group), KEYS, "left_semi")
        if group:
            rows = limited(rows, self.expression.qualified_limit or "First", ["start_date", "event_id"])
        return self._kept(rows) if self.expression.rules else rows

    def _kept(self, rows: DataFrame) -> DataFrame:
        """rows that several parts of the plan read, stored as ``keep`` says."""
        if self.keep == "checkpoint":
            return rows.checkpoint()
        return self.ctx.keep(rows) if self.keep == "cache" else rows

    def release(self) -> None:
        """Gives stored rows back; the result's DataFrames can still be read, but are planned again."""
        self.ctx.release()

    @cached_property
    def inclusion_events(self) -> DataFrame:
        """inclusion_rule_id, person_id, event_id of every rule that an event meets."""
        out = self.ctx.cdm.spark.createDataFrame([], "inclusion_rule_id int, person_id long, event_id long")
        for i, rule in enumerate(self.expression.rules):
            met = group_keys(self.ctx, self.qualified, rule.expression or Group())
            out = out.unionByName(met.select(F.lit(i).alias("inclusion_rule_id"), "person_id", "event_id"))
        return out

    @cached_property
    def masked(self) -> DataFrame:
        """Qualified events with the mask of the rules that they meet."""
        return self._kept(statistics.masks(self.qualified, self.inclusion_events, len(self.expression.rules)))

    @cached_property
    def best_events(self) -> DataFrame:
        return statistics.best_events(self.masked)

    @cached_property
    def included(self) -> DataFrame:
        rows, n = self.qualified, len(self.expression.rules)
        if n > statistics.MOST_RULES:
            met = self.inclusion_events.groupBy(*KEYS).agg(F.count("*").alias("_n")).filter(F.col("_n") == n)
            rows = rows.join(met, KEYS, "left_semi")
        elif n:
            rows = self.masked.filter(F.col("inclusion_rule_mask") == (1 << n) - 1)
        rows = limited(rows.select(*QUALIFIED), self.expression.expression_limit, ["start_date", "event_id"])
        several = isinstance(self.expression.end_strategy, CustomEra) or self.expression.censoring
        return self._kept(rows) if several else rows

    @cached_property
    def ends(self) -> list[DataFrame]:
        strategy, out = self.expression.end_strategy, []
        if isinstance(strategy, DateOffset):
            out.append(date_offset(self.included, strategy))
        else:
            out.append(default_end(self.included))
            if strategy is not None:
                out.append(custom_era(self.ctx, self.included, strategy))
        return out + censored(self.ctx, self.included, self.expression.censoring)

    @cached_property
    def exits(self) -> DataFrame:
        return earliest_ends(self.included, self.ends)

    @cached_property
    def cohort(self) -> DataFrame:
        """cohort_definition_id, subject_id, cohort_start_date, cohort_end_date."""
        rows = fold(self.exits, self.expression.collapse.era_pad)
        if w := self.expression.censor_window:
            low, high = (F.to_date(F.lit(x[:10])) if x else None for x in (w.start_date, w.end_date))
            if low is not None:
                rows = rows.withColumn("start_date", F.greatest("start_date", low))
            if high is not None:
                rows = rows.withColumn("end_date", F.least("end_date", high))
            rows = rows.filter("start_date <= end_date")
        return rows.select(F.lit(self.cohort_id).cast("long").alias("cohort_definition_id"), F.col("person_id").alias("subject_id"), F.col("start_date").alias("cohort_start_date"), F.col("end_date").alias("cohort_end_date"))

    def _events(self, mode: int) -> DataFrame:
        """Mode 0 counts events, mode 1 people by their best event."""
        return self.best_events if mode else self.masked

    def inclusion_result(self, mode: int = 0) -> DataFrame:
        return statistics.inclusion_result(self._events(mode), self.cohort_id, mode)

    def inclusion_stats(self, mode: int = 0) -> DataFrame:
        return statistics.inclusion_stats(self._events(mode), len(self.expression.rules), self.cohort_id, mode)

    def summary_stats(self, mode: int = 0) -> DataFrame:
        return statistics.summary_stats(self._events(mode), len(self.expression.rules), self.cohort_id, mode)


class CohortEngine:
    """Runs expressions on a clinical data model."""

    def __init__(self, spark: SparkSession, cdm: Cdm, keep: str | None = "cache"):
        self.spark, self.cdm, self.keep = spark, cdm, keep

    def context(self, expression: Cohort) -> Context:
        return Context(self.cdm, expression.concept_sets)

    def run(self, expression: Cohort | str | dict, cohort_id: int = 1) -> CohortResult:
        if isinstance(expression, str):
            expression = from_json(expression)
        elif isinstance(expression, dict):
            expression = from_dict(expression)
        if expression.primary is None:
            expression = replace(expression, primary=Primary())
        return CohortResult(self.context(expression), expression, cohort_id, self.keep)
