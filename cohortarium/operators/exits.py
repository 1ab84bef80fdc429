"""When a person leaves the cohort: end strategies and censoring. Each gives (person_id, event_id, end_date)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Criterion, CustomEra, DateOffset
from .context import Context
from .eras import fold
from .events import events


def default_end(included: DataFrame) -> DataFrame:
    return included.select("person_id", "event_id", F.col("op_end_date").alias("end_date"))


def date_offset(included: DataFrame, strategy: DateOffset) -> DataFrame:
    """A fixed time after the event's start or end, within the observation period; an unknown field means the start."""
    column = "end_date" if strategy.date_field == "EndDate" else "start_date"
    return included.select("person_id", "event_id", F.least(F.date_add(column, strategy.offset), F.col("op_end_date")).alias("end_date"))


def custom_era(ctx: Context, included: DataFrame, strategy: CustomEra) -> DataFrame:
    """The end of the drug era, built from exposures to the concept set, that the event starts in."""
    if strategy.drug_codeset_id is None:
        raise ValueError("a custom era needs a drug concept set")
    drugs = ctx.cdm.table("drug_exposure")
    start = F.col("drug_exposure_start_date").cast("date")
    end = F.date_add(start, strategy.days_supply_override) if strategy.days_supply_override is not None else F.coalesce(F.col("drug_exposure_end_date").cast("date"), F.date_add(start, F.col("days_supply").cast("int")), F.date_add(start, 1))
    standard, source = "drug_concept_id", "drug_source_concept_id"
    either = [ctx.is_in(column, strategy.drug_codeset_id) for column in (standard, source)]
    if any(c is None for c in either):
        found = ctx.keep_in(drugs, standard, strategy.drug_codeset_id).unionByName(ctx.keep_in(drugs, source, strategy.drug_codeset_id))
    else:
        found = drugs.filter(either[0] | either[1])  # eras are the same whether a drug found by both counts once or twice
    taken = found.join(included.select("person_id").distinct(), "person_id", "left_semi")
    spans = taken.select(F.col("person_id").cast("long").alias("person_id"), start.alias("start_date"), F.date_add(end, strategy.offset).alias("end_date"))
    eras = fold(spans, strategy.gap_days).select(F.col("person_id").alias("_person"), F.col("start_date").alias("_from"), F.col("end_date").alias("_to"))
    on = (F.col("person_id") == F.col("_person")) & F.col("start_date").between(F.col("_from"), F.col("_to"))
    return included.join(eras, on).select("person_id", "event_id", F.col("_to").alias("end_date"))


def censored(ctx: Context, included: DataFrame, criteria: tuple[Criterion, ...]) -> list[DataFrame]:
    """For each censoring criterion its first event from the index event on, within the observation period."""
    out = []
    for c in criteria:
        found = events(ctx, c).select(F.col("person_id").alias("_person"), F.col("start_date").alias("_date"))
        on = (F.col("person_id") == F.col("_person")) & F.col("_date").between(F.col("start_date"), F.col("op_end_date"))
        out.append(included.join(found, on).groupBy("person_id", "event_id").agg(F.min("_date").alias("end_date")))
    return out
