"""More registered queries: every attribute filter of every domain, a cohort of eight absent conditions, results read back.

A query of attributes gives, for each attribute, how many events pass and the exclusive or of their keys; the SQL says
the same from the tables' columns.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import (
    Bound,
    Cohort,
    Collapse,
    Concept,
    ConceptItem,
    ConceptSet,
    Correlated,
    DateOffset,
    Demographic,
    Group,
    Occurrence,
    Primary,
    Range,
    Rule,
    Selection,
    TextFilter,
    Window,
)
from ..operators import correlation, events
from ..sources.commerce import commerce_cdm
from ..sources.sinks import TABLES, read, write_result
from .engine import CohortEngine, primary_events
from .queries import _BASE_TABLES, _FOLD, _MET, _MT, _OUT, _Q, CONDITION, ORACLES, RULES, _add, _run, c, ids

_SETS: list[ConceptSet] = []


def code(*concepts: int) -> int:
    """The number of a new concept set."""
    _SETS.append(ConceptSet(len(_SETS) + 1, None, tuple(ConceptItem(Concept(x)) for x in concepts)))
    return len(_SETS)


def inside(*concepts: int) -> Selection:
    return Selection(code(*concepts))


def outside(*concepts: int) -> Selection:
    return Selection(code(*concepts), True)


def listed(*concepts: int) -> tuple[Concept, ...]:
    return tuple(map(Concept, concepts))


#: Columns of other tables by their alias in conditions.
_JOINS = {
    "p.": ("person", "left join person p on p.person_id = t.person_id"),
    "r.": ("provider", "left join provider r on r.provider_id = t.provider_id"),
    "s.": ("care_site", "left join care_site s on s.care_site_id = t.care_site_id"),
    "v.": ("visit_occurrence", "left join visit_occurrence v on v.visit_occurrence_id = t.visit_occurrence_id and v.person_id = t.person_id"),
}


def _attributes(kind: str, table: str, key: str, rows: list[tuple[str, dict, str]], *more: str) -> None:
    """rows: (attribute, what a criterion asks of it, the same in SQL)."""

    def query(spark, sf_dir):
        ctx = CohortEngine(spark, commerce_cdm(spark, sf_dir), keep=None).context(Cohort(concept_sets=tuple(_SETS)))
        found = [events.events(ctx, c(kind, **asked)).agg(F.count("*").alias("n"), F.expr("bit_xor(event_id)").alias("keys")).select(F.lit(name).alias("attribute"), "n", "keys") for name, asked, _ in rows]
        return reduce(DataFrame.unionByName, found)

    parts, tables = [], {table, *more}
    for name, _, where in rows:
        used = [(t, j) for alias, (t, j) in _JOINS.items() if f" {alias}" in f" {where}".replace("(", " ")]
        tables |= {t for t, _ in used}
        parts.append(f"select '{name}' as attribute, count(*) as n, bit_xor(t.{key}) as keys from {table} t {' '.join(j for _, j in used)} where {where}")
    _add(f"attributes_{table}", query, " union all ".join(parts), *sorted(tables))


MALE, FEMALE = 8507, 8532


def _people(start: str, visits: bool = True) -> list[tuple[str, dict, str]]:
    """Attributes that most domains have."""
    out = [
        ("age", {"age": Range("lte", 40)}, f"year({start}) - p.year_of_birth <= 40"),
        ("gender", {"gender": listed(MALE)}, "p.gender_concept_id = 8507"),
        ("gender_cs", {"gender_cs": outside(MALE)}, "p.gender_concept_id is not null and p.gender_concept_id <> 8507"),
        ("occurrence_start_date", {"occurrence_start_date": Range("gte", "1996-06-01")}, f"{start} >= date '1996-06-01'"),
    ]
    if visits:
        out += [
            ("provider_specialty", {"provider_specialty": listed(500, 502)}, "r.specialty_concept_id in (500, 502)"),
            ("provider_specialty_cs", {"provider_specialty_cs": inside(501, 503)}, "r.specialty_concept_id in (501, 503)"),
            ("visit_type", {"visit_type": listed(511)}, "v.visit_concept_id = 511"),
            ("visit_type_cs", {"visit_type_cs": inside(510, 513)}, "v.visit_concept_id in (510, 513)"),
        ]
    return out


def _typed(name: str, column: str, a: int, b: int) -> list[tuple[str, dict, str]]:
    """A listed attribute, its exclusion, and its concept set."""
    return [
        (name, {name: listed(a)}, f"t.{column} = {a}"),
        (f"{name}_exclude", {name: listed(a), f"{name}_exclude": True}, f"t.{column} <> {a}"),
        (f"{name}_cs", {f"{name}_cs": inside(b)}, f"t.{column} = {b}"),
        (f"{name}_cs_out", {f"{name}_cs": outside(b)}, f"t.{column} <> {b}"),
    ]


def _plain(name: str, column: str, a: int, b: int) -> list[tuple[str, dict, str]]:
    """A listed attribute and its concept set."""
    return [(name, {name: listed(a, b)}, f"t.{column} in ({a}, {b})"), (f"{name}_cs", {f"{name}_cs": inside(b)}, f"t.{column} = {b}")]


def _source(name: str, column: str, a: int) -> list[tuple[str, dict, str]]:
    return [(name, {name: code(a)}, f"t.{column} = {a}")]


_CS, _CE = "t.condition_start_date", "coalesce(t.condition_end_date, t.condition_start_date + 1)"
_attributes("ConditionOccurrence", "condition_occurrence", "condition_occurrence_id", [
    *_people(_CS), *_typed("condition_type", "condition_type_concept_id", 20, 21), *_plain("condition_status", "condition_status_concept_id", 26, 27), *_source("condition_source_concept", "condition_source_concept_id", 12),
    ("occurrence_end_date", {"occurrence_end_date": Range("lt", "1997-01-01")}, f"{_CE} < date '1997-01-01'"),
    ("stop_reason", {"stop_reason": TextFilter("1-URGENT", "eq")}, "t.stop_reason = '1-URGENT'"), ("stop_reason_not", {"stop_reason": TextFilter("1-URGENT", "!eq")}, "t.stop_reason <> '1-URGENT'"),
    ("stop_reason_start", {"stop_reason": TextFilter("3-", "!startsWith")}, "t.stop_reason not like '3-%'"), ("stop_reason_end", {"stop_reason": TextFilter("LOW", "!endsWith")}, "t.stop_reason not like '%LOW'"),
])
_DS, _DEND = "t.drug_exposure_start_date", "coalesce(t.drug_exposure_end_date, t.drug_exposure_start_date + t.days_supply, t.drug_exposure_start_date + 1)"
_attributes("DrugExposure", "drug_exposure", "drug_exposure_id", [
    *_people(_DS), *_typed("drug_type", "drug_type_concept_id", 30, 31), *_plain("dose_unit", "dose_unit_concept_id", 37, 38), *_plain("route_concept", "route_concept_id", 35, 36), *_source("drug_source_concept", "drug_source_concept_id", 1007),
    ("occurrence_end_date", {"occurrence_end_date": Range("gt", "1997-01-01")}, f"{_DEND} > date '1997-01-01'"), ("refills", {"refills": Range("gt", 2)}, "t.refills > 2"), ("quantity", {"quantity": Range("lt", 20)}, "t.quantity < 20"),
    ("days_supply", {"days_supply": Range("eq", 7)}, "t.days_supply = 7"), ("lot_number", {"lot_number": TextFilter("F", "startsWith")}, "t.lot_number like 'F%'"), ("stop_reason", {"stop_reason": TextFilter("R", "contains")}, "t.stop_reason like '%R%'"),
])
_attributes("ProcedureOccurrence", "procedure_occurrence", "procedure_occurrence_id", [
    *_people("t.procedure_date"), *_typed("procedure_type", "procedure_type_concept_id", 115, 116), *_plain("modifier", "modifier_concept_id", 117, 118), *_source("procedure_source_concept", "procedure_source_concept_id", 111), ("quantity", {"quantity": Range("!eq", 2)}, "t.quantity <> 2"),
])
_attributes("VisitOccurrence", "visit_occurrence", "visit_occurrence_id", [
    *_people("t.visit_start_date", False), *_typed("visit_type", "visit_type_concept_id", 520, 521), *_source("visit_source_concept", "visit_source_concept_id", 516),
    ("provider_specialty", {"provider_specialty": listed(500)}, "r.specialty_concept_id = 500"), ("place_of_service_cs", {"place_of_service_cs": inside(507)}, "s.place_of_service_concept_id = 507"),
    ("occurrence_end_date", {"occurrence_end_date": Range("eq", "1997-03-04")}, "t.visit_end_date = date '1997-03-04'"), ("visit_length", {"visit_length": Range("lt", 2)}, "date_diff('day', t.visit_start_date, t.visit_end_date) < 2"),
])
_attributes("VisitDetail", "visit_detail", "visit_detail_id", [
    ("age", {"age": Range("lte", 40)}, "year(t.visit_detail_end_date) - p.year_of_birth <= 40"), ("gender_cs", {"gender_cs": inside(FEMALE)}, "p.gender_concept_id = 8532"),
    *_typed("visit_detail_type", "visit_detail_type_concept_id", 540, 541), *_source("visit_detail_source_concept", "visit_detail_source_concept_id", 536),
    ("visit_detail_start_date", {"visit_detail_start_date": Range("lt", "1996-05-05")}, "t.visit_detail_start_date < date '1996-05-05'"), ("visit_detail_end_date", {"visit_detail_end_date": Range("!bt", "1996-01-01", "1997-01-01")}, "not (t.visit_detail_end_date between date '1996-01-01' and date '1997-01-01')"),
    ("provider_specialty", {"provider_specialty": listed(504)}, "r.specialty_concept_id = 504"), ("place_of_service", {"place_of_service": listed(508)}, "s.place_of_service_concept_id = 508"),
])
_attributes("Observation", "observation", "observation_id", [
    *_people("t.observation_date"), *_typed("observation_type", "observation_type_concept_id", 219, 220), *_plain("unit", "unit_concept_id", 215, 216), *_plain("value_as_concept", "value_as_concept_id", 210, 212), *_plain("qualifier", "qualifier_concept_id", 217, 218),
    *_source("observation_source_concept", "observation_source_concept_id", 206), ("value_as_string", {"value_as_string": TextFilter("5-LOW", "eq")}, "t.value_as_string = '5-LOW'"),
])
_attributes("Measurement", "measurement", "measurement_id", [
    *_people("t.measurement_date"), *_typed("measurement_type", "measurement_type_concept_id", 340, 341), *_plain("operator", "operator_concept_id", 330, 332), *_plain("unit", "unit_concept_id", 335, 336), *_plain("value_as_concept", "value_as_concept_id", 4155142, 4155143),
    *_source("measurement_source_concept", "measurement_source_concept_id", 321), ("range_low", {"range_low": Range("gt", 9.5)}, "t.range_low > 9.5"), ("range_high", {"range_high": Range("bt", 25, 40)}, "t.range_high between 25 and 40"),
    ("range_low_ratio", {"range_low_ratio": Range("lt", 2)}, "t.value_as_number / nullif(t.range_low, 0) < 2"),
])
_attributes("DeviceExposure", "device_exposure", "device_exposure_id", [
    *_people("t.device_exposure_start_date"), *_typed("device_type", "device_type_concept_id", 130, 131), *_source("device_source_concept", "device_source_concept_id", 127), ("quantity", {"quantity": Range("gte", 4)}, "t.quantity >= 4"),
    ("occurrence_end_date", {"occurrence_end_date": Range("lte", "1997-01-01")}, "coalesce(t.device_exposure_end_date, t.device_exposure_start_date + 1) <= date '1997-01-01'"),
])
_attributes("Specimen", "specimen", "specimen_id", [
    *_people("t.specimen_date", False), *_typed("specimen_type", "specimen_type_concept_id", 360, 361), *_plain("unit", "unit_concept_id", 365, 366), *_plain("anatomic_site", "anatomic_site_concept_id", 367, 368), *_plain("disease_status", "disease_status_concept_id", 369, 370),
    *_source("specimen_source_concept", "specimen_source_concept_id", 356),
])
_attributes("Death", "death", "person_id", [
    ("age", {"age": Range("lt", 50)}, "year(t.death_date) - p.year_of_birth < 50"), ("gender", {"gender": listed(FEMALE)}, "p.gender_concept_id = 8532"), *_typed("death_type", "death_type_concept_id", 370, 371),
    ("codeset_id", {"codeset_id": code(376)}, "t.cause_concept_id = 376"), ("death_source_concept", {"death_source_concept": code(381)}, "t.cause_source_concept_id = 381"), ("occurrence_start_date", {"occurrence_start_date": Range("gt", "1998-01-01")}, "t.death_date > date '1998-01-01'"),
], "observation_period")
_AGES = lambda start, end: [("age_at_start", {"age_at_start": Range("gt", 30)}, f"year({start}) - p.year_of_birth > 30"), ("age_at_end", {"age_at_end": Range("bt", 20, 60)}, f"year({end}) - p.year_of_birth between 20 and 60")]
_OS, _OE = "t.observation_period_start_date", "t.observation_period_end_date"
_attributes("ObservationPeriod", "observation_period", "observation_period_id", [
    *_AGES(_OS, _OE), *_plain("period_type", "period_type_concept_id", 590, 591), ("period_start_date", {"period_start_date": Range("gt", "1993-01-01")}, f"{_OS} > date '1993-01-01'"), ("period_end_date", {"period_end_date": Range("lt", "1998-12-01")}, f"{_OE} < date '1998-12-01'"),
])
_PS, _PE = "t.payer_plan_period_start_date", "t.payer_plan_period_end_date"
_attributes("PayerPlanPeriod", "payer_plan_period", "payer_plan_period_id", [
    *_AGES(_PS, _PE), ("gender_cs", {"gender_cs": inside(MALE)}, "p.gender_concept_id = 8507"), ("plan_concept", {"plan_concept": code(391)}, "t.plan_concept_id = 391"), ("sponsor_concept", {"sponsor_concept": code(395)}, "t.sponsor_concept_id = 395"),
    ("period_start_date", {"period_start_date": Range("gt", "1993-01-01")}, f"{_PS} > date '1993-01-01'"), ("period_length", {"period_length": Range("eq", 365)}, f"date_diff('day', {_PS}, {_PE}) = 365"),
], "observation_period")


def _era(kind: str, table: str, *more: tuple[str, dict, str]) -> None:
    start, end = f"t.{table}_start_date", f"t.{table}_end_date"
    _attributes(kind, table, f"{table}_id", [
        *_AGES(start, end), ("gender", {"gender": listed(MALE, FEMALE)}, "p.gender_concept_id in (8507, 8532)"), ("era_start_date", {"era_start_date": Range("gt", "1995-01-01")}, f"{start} > date '1995-01-01'"),
        ("era_end_date", {"era_end_date": Range("bt", "1996-01-01", "1997-06-30")}, f"{end} between date '1996-01-01' and date '1997-06-30'"), ("era_length", {"era_length": Range("lte", 400)}, f"date_diff('day', {start}, {end}) <= 400"), *more,
    ], *({"condition_era": ("condition_occurrence",), "drug_era": ("drug_exposure",), "dose_era": ("drug_era", "drug_exposure")}[table]))


_era("ConditionEra", "condition_era", ("occurrence_count", {"occurrence_count": Range("eq", 2)}, "t.condition_occurrence_count = 2"))
_era("DrugEra", "drug_era", ("occurrence_count", {"occurrence_count": Range("gt", 1)}, "t.drug_exposure_count > 1"), ("gap_days", {"gap_days": Range("lt", 3)}, "t.gap_days < 3"))
_era("DoseEra", "dose_era", *_plain("unit", "unit_concept_id", 37, 38), ("dose_value", {"dose_value": Range("gt", 5.5)}, "t.dose_value > 5.5"))


# demographic criteria with concept sets and ethnicity
_DEMOGRAPHIC = Demographic(gender_cs=Selection(1), race_cs=Selection(2, True), ethnicity_cs=Selection(3), ethnicity=(Concept(38003563), Concept(38003564)), occurrence_end_date=Range("lt", "1998-01-01"))


def _demographic(spark, sf_dir):
    sets = (ids(1, MALE), ids(2, 8525), ids(3, 38003563), ids(4, 1))
    engine = CohortEngine(spark, commerce_cdm(spark, sf_dir))
    result = engine.run(Cohort(concept_sets=sets, primary=Primary((c("ConditionOccurrence", codeset_id=4),))))
    return correlation.group_keys(result.ctx, primary_events(result.ctx, result.expression.primary), Group("ALL", demographics=(_DEMOGRAPHIC,)))


_add("demographic_sets", _demographic, f"with {_Q.format('', '')} select q.person_id, q.event_id from q join person p on p.person_id = q.person_id where gender_concept_id = 8507 and race_concept_id <> 8525 and ethnicity_concept_id = 38003563 and q.end_date < date '1998-01-01'", *_BASE_TABLES, "person")

# A cohort of eight "exactly 0" rules that look past observation periods, two censoring events, an exit at the event's end.
#: Days before the event and after it; None: any time before it.
_AROUND = ((None, None), (365, 0), (180, 7), (90, 30), (60, 0), (30, 30), (14, 1), (7, 365))


def _absent(i: int) -> tuple[Rule, str]:
    """A rule and the same in SQL."""
    (before, after), concept = _AROUND[i], 2 + i % 2
    window = Window(Bound(-1), Bound(-1, 1)) if before is None else Window(Bound(-1, before), Bound(1, after))
    near = "x.condition_start_date < q.start_date" if before is None else f"x.condition_start_date between q.start_date - {before} and q.start_date + {after}"
    none = Correlated(c("ConditionOccurrence", codeset_id=concept), window, occurrence=Occurrence(0, 0), ignore_observation_period=True)
    return Rule(f"no {concept}", None, Group("ALL", criteria=(none,))), f"not exists (select 1 from condition_occurrence x where x.person_id = q.person_id and x.condition_concept_id = {concept} and {near})"


_RULES = [_absent(i) for i in range(len(_AROUND))]
_ABSENT = Cohort(
    concept_sets=(ids(1, 1), ids(2, 2), ids(3, 3), ids(7, 510), ids(13, 512)), primary=Primary((CONDITION,)), rules=tuple(r for r, _ in _RULES), end_strategy=DateOffset("EndDate", 0),
    censoring=(c("VisitOccurrence", codeset_id=13), c("VisitOccurrence", codeset_id=7)), collapse=Collapse("ERA", 0))
_FIRST = "select z.person_id, z.event_id, min(v.visit_start_date) as e from z join visit_occurrence v on v.person_id = z.person_id and v.visit_concept_id = {} and v.visit_start_date between z.start_date and z.op_end_date group by z.person_id, z.event_id"
_add("absent_conditions", lambda spark, sf_dir: CohortEngine(spark, commerce_cdm(spark, sf_dir)).run(_ABSENT).cohort,
    f"with {_Q.format('', '')}, z as (select * from q where {' and '.join(x for _, x in _RULES)}), ce as (select person_id, event_id, least(end_date, op_end_date) as e from z union all {_FIRST.format(512)} union all {_FIRST.format(510)}), "
    "x as (select z.person_id, z.start_date as s, min(ce.e) as e from z join ce on ce.person_id = z.person_id and ce.event_id = z.event_id and ce.e >= z.start_date group by z.person_id, z.event_id, z.start_date), " + _FOLD.format(pad=0, rows="x") + " " + _OUT,
    *_BASE_TABLES, "visit_occurrence")


# results written to their tables and read again


def _results_dir(spark: SparkSession) -> str:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/results-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="cohort-results-")


def _read_back(name: str, table: str) -> None:
    """Two writes of one cohort leave one."""

    def query(spark, sf_dir):
        path = _results_dir(spark)
        for rules in (RULES[:1], RULES):
            write_result(_run(spark, sf_dir, rules=rules), path)
        return read(spark, path, table)

    if table == "cohort":
        sql = f"with {_MET}, x as (select person_id, start_date as s, op_end_date as e from m where mask = 7), " + _FOLD.format(pad=0, rows="x").replace("f1", "g1").replace("f2", "g2") + " " + _OUT
        _add(name, query, sql, *_MT)
    else:
        of = table.removeprefix("cohort_inclusion_").removeprefix("cohort_")
        _add(name, query, None)
        ORACLES[name] = " union all ".join(f"select * from ({ORACLES[f'{q}{mode}']}) x{i}" for q in [{"result": "inclusion_result", "stats": "inclusion_stats", "summary_stats": "summary_stats"}[of]] for i, mode in enumerate(("", "_best")))


for _table in TABLES:
    _read_back(f"written_{_table}", _table)
