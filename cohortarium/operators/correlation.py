"""Criteria around index events: correlated, demographic, and groups of them.

Index events have person_id, event_id (unique within a person), start_date, end_date, op_start_date, op_end_date and
visit_occurrence_id. Every function gives the keys (person_id, event_id) of the index events that pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates
from ..model import Bound, Correlated, Demographic, Group, Occurrence, Window
from .context import Context
from .events import events

KEYS = ["person_id", "event_id"]
EXACTLY, AT_MOST, AT_LEAST = 0, 1, 2


def _window(window: Window | None, event_end: bool, ignore_period: bool) -> list[Column]:
    if window is None:
        return []
    index = F.col("p.end_date" if window.use_index_end else "p.start_date")
    event = F.col("a.end_date" if event_end else "a.start_date")

    def limit(bound: Bound | None) -> Column | None:
        if bound is None:
            return None
        if bound.days is not None:
            return F.date_add(index, bound.coeff * bound.days)
        if ignore_period:
            return None
        return F.col("p.op_start_date" if bound.coeff == -1 else "p.op_end_date")

    low, high = limit(window.start), limit(window.end)
    return [event >= low] * (low is not None) + [event <= high] * (high is not None)


def correlated_keys(ctx: Context, index: DataFrame, c: Correlated) -> DataFrame:
    occurrence = c.occurrence or Occurrence()
    column = (occurrence.count_column or "domain_concept_id") if occurrence.is_distinct else None
    found = events(ctx, c.criterion, column).alias("a")
    p = index.alias("p")
    on = [F.col("a.person_id") == F.col("p.person_id")]
    if not c.ignore_observation_period:
        on.append(F.col("a.start_date").between(F.col("p.op_start_date"), F.col("p.op_end_date")))
    if c.start_window:
        on += _window(c.start_window, c.start_window.use_event_end is True, c.ignore_observation_period)
    if c.end_window:
        on += _window(c.end_window, c.end_window.use_event_end is not False, c.ignore_observation_period)
    if c.restrict_visit:
        on.append(F.col("a.visit_occurrence_id") == F.col("p.visit_occurrence_id"))
    on = reduce(lambda a, b: a & b, on)
    keys = index.select(*KEYS)
    n, kind = occurrence.count, occurrence.type
    if kind == AT_LEAST and n <= 0:
        return keys
    if kind in (EXACTLY, AT_MOST) and n == 0 and not column:
        return p.join(found, on, "left_anti").select(*KEYS)
    if kind == AT_LEAST and n == 1 and not column:
        return p.join(found, on, "left_semi").select(*KEYS)
    met = p.join(found, on).select(F.col("p.person_id"), F.col("p.event_id"), F.col("a.count_value" if column else "a.event_id").alias("v"))
    counts = met.groupBy(*KEYS).agg((F.countDistinct("v") if column else F.count("v")).alias("n"))
    if kind == AT_LEAST:
        return counts.filter(F.col("n") >= n).select(*KEYS)
    if kind == EXACTLY and n > 0:
        return counts.filter(F.col("n") == n).select(*KEYS)
    all_counts = keys.join(counts, KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return all_counts.filter(F.col("n") == n if kind == EXACTLY else F.col("n") <= n).select(*KEYS)


def demographic_keys(ctx: Context, index: DataFrame, d: Demographic) -> DataFrame:
    person = ctx.cdm.table("person").select("person_id", "year_of_birth", "gender_concept_id", "race_concept_id", "ethnicity_concept_id")
    rows = index.join(person, "person_id")
    conditions = []
    if d.age:
        conditions.append(predicates.number(F.year("start_date") - F.col("year_of_birth"), d.age))
    for what in ("gender", "race", "ethnicity"):
        if listed := getattr(d, what):
            conditions.append(predicates.concept_in(F.col(f"{what}_concept_id"), listed))
    for what in ("start_date", "end_date"):
        if r := getattr(d, f"occurrence_{what}"):
            conditions.append(predicates.date(F.col(what), r))
    rows = rows.filter(predicates.both(conditions))
    for what in ("gender", "race", "ethnicity"):
        if (s := getattr(d, f"{what}_cs")) is not None:
            rows = ctx.keep_in(rows, f"{what}_concept_id", s.codeset_id, s.is_exclusion)
    return rows.select(*KEYS).distinct()


def group_keys(ctx: Context, index: DataFrame, group: Group) -> DataFrame:
    """An empty group passes everything."""
    keys = index.select(*KEYS)
    children = [correlated_keys(ctx, index, c) for c in group.criteria] + [demographic_keys(ctx, index, d) for d in group.demographics] + [group_keys(ctx, index, g) for g in group.groups if not g.empty]
    if not children:
        return keys
    kind = group.type.upper()
    if kind == "ALL":
        return reduce(lambda a, b: a.join(b, KEYS, "left_semi"), children, keys)
    if kind == "ANY":
        return keys.join(reduce(DataFrame.unionByName, children), KEYS, "left_semi")
    if kind not in ("AT_LEAST", "AT_MOST"):
        raise ValueError(f"unknown group type {group.type!r}")
    n = group.count or 0
    if kind == "AT_LEAST" and n <= 0:
        return keys
    met = reduce(DataFrame.unionByName, children).groupBy(*KEYS).agg(F.count("*").alias("n"))
    if kind == "AT_LEAST":
        return keys.join(met.filter(F.col("n") >= n), KEYS, "left_semi")
    return keys.join(met.filter(F.col("n") > n), KEYS, "left_anti")
