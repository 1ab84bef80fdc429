"""Events of one criterion: the generic operator over the domain declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates
from ..model import Criterion, Period
from .context import Context

#: The columns of events, in order; count_value is there only if a criterion counts distinct values.
COLUMNS = ("person_id", "event_id", "start_date", "end_date", "visit_occurrence_id", "sort_date")
NEVER = "2099-12-31"


def _joined(ctx: Context, rows: DataFrame, used: set[str]) -> DataFrame:
    """rows with the columns of the dimension tables that the criterion's attributes need."""
    cdm = ctx.cdm
    if "person" in used:
        rows = rows.join(cdm.table("person").select("person_id", "year_of_birth", "gender_concept_id"), "person_id")
    if "visit" in used:
        rows = rows.join(cdm.table("visit_occurrence").select("person_id", "visit_occurrence_id", "visit_concept_id"), ["person_id", "visit_occurrence_id"])
    if "provider" in used:
        rows = rows.join(cdm.table("provider").select("provider_id", "specialty_concept_id"), "provider_id", "left")
    if "care_site" in used:
        rows = rows.join(cdm.table("care_site").select("care_site_id", "place_of_service_concept_id"), "care_site_id")
    return rows


def _in_place(ctx: Context, rows: DataFrame, codeset_id: int) -> DataFrame:
    """Rows whose care site stood, from start to end, at a location of a region of the concept set."""
    history = ctx.cdm.table("location_history").filter("domain_id = 'CARE_SITE'").select("location_id", F.col("entity_id").alias("_site"), F.col("start_date").alias("_from"), F.coalesce("end_date", F.to_date(F.lit(NEVER))).alias("_to"))
    places = ctx.keep_in(ctx.cdm.table("location").select("location_id", "region_concept_id"), "region_concept_id", codeset_id)
    history = history.join(places, "location_id", "left_semi")
    return rows.join(history, (rows["care_site_id"] == history["_site"]) & (rows["start_date"] >= history["_from"]) & (rows["end_date"] <= history["_to"]), "left_semi")


def events(ctx: Context, criterion: Criterion, count: str | None = None) -> DataFrame:
    """Events (COLUMNS) that meet the criterion, nested criteria included; count names the column counted as distinct.

    The concept set and, for "first", the person's first event are taken before the other attributes are looked at:
    a first event that fails one of them isn't replaced by a later event.
    """
    d = criterion.domain
    rows = ctx.cdm.table(d.table)
    if d.concept and criterion.get("codeset_id") is not None:
        rows = ctx.keep_in(rows, d.concept, criterion.get("codeset_id"))
    if d.source and criterion.get(d.source[0]) is not None:
        rows = ctx.keep_in(rows, d.source[1], criterion.get(d.source[0]))
    rows = rows.withColumn("_start", F.expr(d.start).cast("date")).withColumn("_end", F.expr(d.end).cast("date")).withColumn("_key", F.col(d.key).cast("long"))
    if criterion.get("first"):
        order = Window.partitionBy("person_id").orderBy("_start", "_key")
        rows = rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
    rows = rows.withColumn("sort_date", F.col("_start"))
    period = criterion.get("user_defined_period")
    if period:
        rows = _period(rows, period)
    if a := criterion.date_adjustment:
        base = {"START_DATE": F.col("_start"), "END_DATE": F.col("_end")}
        rows = rows.withColumns({"_start": F.date_add(base[a.start_with], a.start_offset), "_end": F.date_add(base[a.end_with], a.end_offset)})
    rows = rows.withColumns({"start_date": F.col("_start"), "end_date": F.col("_end")})
    given = [(a, criterion.get(a.name)) for a in d.attributes if criterion.get(a.name) is not None and a.on]
    rows = _joined(ctx, rows, {a.through for a, _ in given})
    conditions = []
    for a, value in given:
        if a.kind == "date":
            conditions.append(predicates.date(F.col(a.on), value))
        elif a.kind in ("number", "length"):
            conditions.append(predicates.number(F.expr(a.on), value, a.decimals))
        elif a.kind == "age":
            conditions.append(predicates.number(F.year(a.on) - F.col("year_of_birth"), value))
        elif a.kind == "text":
            conditions.append(predicates.text(F.col(a.on), value))
        elif a.kind == "concepts" and value:
            conditions.append(predicates.concept_in(F.col(a.on), value, bool(a.exclude and criterion.get(a.exclude))))
        elif a.kind == "flag" and value:
            conditions.append(F.expr(a.on))
    rows = rows.filter(predicates.both(conditions))
    for a, value in given:
        if a.kind == "selection":
            rows = ctx.keep_in(rows, a.on, value.codeset_id, value.is_exclusion)
        elif a.kind == "codeset" and a.through == "place":
            rows = _in_place(ctx, rows, value)
        elif a.kind == "codeset":
            rows = ctx.keep_in(rows, a.on, value)
    visit = F.col(d.visit).cast("long") if d.visit else F.lit(None).cast("long")
    out = [F.col("person_id").cast("long").alias("person_id"), F.col("_key").alias("event_id"), "start_date", "end_date", visit.alias("visit_occurrence_id"), "sort_date"]
    if count:
        counted = dict(d.counts).get(count)
        if counted is None:
            raise ValueError(f"{d.kind} has no column {count} to count")
        out.append(F.expr(counted).alias("count_value"))
    rows = rows.select(*out)
    if criterion.correlated and not criterion.correlated.empty:
        from .correlation import group_keys

        context = with_observation(ctx, rows.select(*COLUMNS))
        rows = rows.join(group_keys(ctx, context, criterion.correlated), ["person_id", "event_id"], "left_semi")
    return rows


def _period(rows: DataFrame, period: Period) -> DataFrame:
    """The period must hold the given dates, which then stand for its own."""
    for column, value in (("_start", period.start_date), ("_end", period.end_date)):
        if value:
            rows = rows.filter((F.col("_start") <= F.to_date(F.lit(value[:10]))) & (F.col("_end") >= F.to_date(F.lit(value[:10]))))
    return rows.withColumns({c: F.to_date(F.lit(v[:10])) for c, v in (("_start", period.start_date), ("_end", period.end_date)) if v})


def with_observation(ctx: Context, rows: DataFrame) -> DataFrame:
    """rows that start inside an observation period of their person, with op_start_date and op_end_date."""
    op = ctx.cdm.table("observation_period").select(
        F.col("person_id").cast("long").alias("_person"), F.col("observation_period_start_date").cast("date").alias("op_start_date"), F.col("observation_period_end_date").cast("date").alias("op_end_date"))
    return rows.join(op, (F.col("person_id") == F.col("_person")) & F.col("start_date").between(F.col("op_start_date"), F.col("op_end_date"))).drop("_person")
