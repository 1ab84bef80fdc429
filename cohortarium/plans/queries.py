"""Registered queries of the cohort engine over commerce tables, and the same results in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

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
    Criterion,
    CustomEra,
    DateAdjustment,
    DateOffset,
    Demographic,
    Group,
    Occurrence,
    Period,
    Primary,
    Range,
    Rule,
    Selection,
    TextFilter,
    Window,
)
from ..operators import correlation, events
from ..operators.vocabulary import resolve
from ..sources.commerce import commerce_cdm, common_tables
from .engine import CohortEngine, CohortResult, primary_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def ids(n: int, *concepts: int) -> ConceptSet:
    return ConceptSet(n, f"set {n}", tuple(ConceptItem(Concept(c)) for c in concepts))


def c(kind: str, correlated: Group | None = None, adjust: DateAdjustment | None = None, **attributes) -> Criterion:
    return Criterion(kind, tuple(sorted(attributes.items())), adjust, correlated)


#: Concept sets of all queries.
SETS = (ids(1, 1), ids(2, 2), ids(3, 1, 2, 3), ids(4, *range(1001, 1011)), ids(5, 100, 101), ids(6, 400, 401), ids(7, 510, 511), ids(8, 37), ids(9, 8507), ids(10, 999_999), ids(11, 4155142), ids(12, *range(300, 312)), ids(13, 512), ids(14, 385, 386), ids(15, 11, 12), ids(16, 331))
CONDITION = c("ConditionOccurrence", codeset_id=1)


def _run(spark: SparkSession, sf_dir: str, **parts) -> CohortResult:
    parts.setdefault("primary", Primary((CONDITION,)))
    return CohortEngine(spark, commerce_cdm(spark, sf_dir)).run(Cohort(concept_sets=SETS, **parts))


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None, *tables: str) -> None:
    QUERIES[name] = query
    if sql is not None:
        with_ = common_tables(*tables) if tables else ""
        body = sql.strip()
        if body.lower().startswith("with "):
            body = f"with {with_}, {body[5:]}" if with_ else body
        elif with_:
            body = f"with {with_} {body}"
        ORACLES[name] = body


_EVENT = "person_id, event_id, start_date, end_date, visit_occurrence_id"


def _events(name: str, criterion: Criterion, sql: str, *tables: str) -> None:
    def query(spark, sf_dir):
        ctx = CohortEngine(spark, commerce_cdm(spark, sf_dir), keep=None).context(Cohort(concept_sets=SETS))
        return events.events(ctx, criterion).select(*_EVENT.split(", "))

    _add(name, query, sql, *tables)


def _domain(table: str, key: str, start: str, end: str, where: str, visit: str = "visit_occurrence_id", join: str = "") -> str:
    return f"select t.person_id, {key} as event_id, {start} as start_date, {end} as end_date, {visit} as visit_occurrence_id from {table} t {join} where {where}"


_NO_VISIT = "cast(null as bigint)"
_CO = ("condition_occurrence", "condition_occurrence_id", "condition_start_date", "coalesce(condition_end_date, condition_start_date + 1)")
_DE = ("drug_exposure", "drug_exposure_id", "drug_exposure_start_date", "coalesce(drug_exposure_end_date, drug_exposure_start_date + days_supply, drug_exposure_start_date + 1)")
_PO = ("procedure_occurrence", "procedure_occurrence_id", "procedure_date", "procedure_date + 1")
_OB = ("observation", "observation_id", "observation_date", "observation_date + 1")
_ME = ("measurement", "measurement_id", "measurement_date", "measurement_date + 1")
_VO = ("visit_occurrence", "visit_occurrence_id", "visit_start_date", "visit_end_date")
_PERSON = "join person p on p.person_id = t.person_id"

# D1-D16
_events("domain_condition", c("ConditionOccurrence", codeset_id=3, condition_source_concept=None, condition_type=(Concept(20), Concept(21)), age=Range("gt", 30)),
    _domain(*_CO, "condition_concept_id in (1, 2, 3) and condition_type_concept_id in (20, 21) and year(condition_start_date) - year_of_birth > 30", "t.visit_occurrence_id", _PERSON), "condition_occurrence", "person")
_events("domain_drug", c("DrugExposure", codeset_id=4, refills=Range("lte", 3), drug_type=(Concept(30),), drug_type_exclude=True),
    _domain(*_DE, "drug_concept_id between 1001 and 1010 and drug_concept_id % 9 >= 0 and refills <= 3 and drug_type_concept_id not in (30)"), "drug_exposure")
_events("domain_procedure", c("ProcedureOccurrence", codeset_id=5, quantity=Range("bt", 1, 2)), _domain(*_PO, "procedure_concept_id in (100, 101) and quantity between 1 and 2"), "procedure_occurrence")
_events("domain_visit", c("VisitOccurrence", codeset_id=7, visit_length=Range("gte", 3), place_of_service=(Concept(506),)),
    _domain(*_VO, "visit_concept_id in (510, 511) and date_diff('day', visit_start_date, visit_end_date) >= 3 and place_of_service_concept_id = 506", "visit_occurrence_id", "join care_site s on s.care_site_id = t.care_site_id"), "visit_occurrence", "care_site")
_events("domain_visit_detail", c("VisitDetail", visit_detail_length=Range("lt", 4), gender=(Concept(8507),)),
    _domain("visit_detail", "visit_detail_id", "visit_detail_start_date", "visit_detail_end_date", "date_diff('day', visit_detail_start_date, visit_detail_end_date) < 4 and gender_concept_id = 8507", join=_PERSON), "visit_detail", "person")
_events("domain_observation", c("Observation", value_as_number=Range("gt", 150000.5), value_as_string=TextFilter("HIGH", "contains")),
    _domain(*_OB, "value_as_number > 150000.5 and value_as_string like '%HIGH%'"), "observation")
_events("domain_measurement", c("Measurement", codeset_id=12, value_as_number=Range("bt", 5, 50.25), unit=(Concept(335),)),
    _domain(*_ME, "measurement_concept_id between 300 and 311 and value_as_number between 5.0 and 50.25 and unit_concept_id = 335"), "measurement")
_events("domain_device", c("DeviceExposure", first=True, unique_device_id=TextFilter("DEV-1", "startsWith")),
    "with r as (select *, row_number() over (partition by person_id order by device_exposure_start_date, device_exposure_id) as n from device_exposure) " + _domain("r", "device_exposure_id", "device_exposure_start_date", "coalesce(device_exposure_end_date, device_exposure_start_date + 1)", "n = 1 and unique_device_id like 'DEV-1%'"), "device_exposure")
_events("domain_specimen", c("Specimen", quantity=Range("lt", 100000), source_id=TextFilter("LOW", "endsWith")), _domain("specimen", "specimen_id", "specimen_date", "specimen_date", "quantity < 100000 and specimen_source_id like '%LOW'", _NO_VISIT), "specimen")
_events("domain_death", c("Death", death_type=(Concept(370),), age=Range("gte", 20)), _domain("death", "t.person_id", "death_date", "death_date + 1", "death_type_concept_id = 370 and year(death_date) - year_of_birth >= 20", _NO_VISIT, _PERSON), "death", "person")
_events("domain_observation_period", c("ObservationPeriod", period_length=Range("gt", 2000), age_at_start=Range("lt", 60)),
    _domain("observation_period", "observation_period_id", "observation_period_start_date", "observation_period_end_date", "date_diff('day', observation_period_start_date, observation_period_end_date) > 2000 and year(observation_period_start_date) - year_of_birth < 60", _NO_VISIT, _PERSON), "observation_period", "person")
_events("user_defined_period", c("ObservationPeriod", user_defined_period=Period("1998-01-01", "1999-06-30")),
    _domain("observation_period", "observation_period_id", "date '1998-01-01'", "date '1999-06-30'", "observation_period_start_date <= date '1998-01-01' and observation_period_end_date >= date '1999-06-30'", _NO_VISIT), "observation_period")
_events("domain_payer_plan", c("PayerPlanPeriod", first=True, payer_concept=14, gender=(Concept(8532),), age_at_start=Range("gte", 30)), _domain("payer_plan_period", "payer_plan_period_id", "payer_plan_period_start_date", "payer_plan_period_end_date", "payer_concept_id in (385, 386) and gender_concept_id = 8532 and year(payer_plan_period_start_date) - year_of_birth >= 30", _NO_VISIT, _PERSON), "payer_plan_period", "person")
_events("domain_location_region", c("LocationRegion", codeset_id=6), "select entity_id as person_id, location_history_id as event_id, start_date, coalesce(end_date, date '2099-12-31') as end_date, cast(null as bigint) as visit_occurrence_id from location_history h join location l on l.location_id = h.location_id where domain_id = 'PERSON' and region_concept_id in (400, 401)", "location_history", "location")
_events("domain_condition_era", c("ConditionEra", codeset_id=3, era_length=Range("gt", 100), occurrence_count=Range("gte", 2)),
    _domain("condition_era", "condition_era_id", "condition_era_start_date", "condition_era_end_date", "condition_concept_id in (1, 2, 3) and date_diff('day', condition_era_start_date, condition_era_end_date) > 100 and condition_occurrence_count >= 2", _NO_VISIT), "condition_era")
_events("domain_drug_era", c("DrugEra", gap_days=Range("eq", 3), age_at_end=Range("gt", 40)), _domain("drug_era", "drug_era_id", "drug_era_start_date", "drug_era_end_date", "gap_days = 3 and year(drug_era_end_date) - year_of_birth > 40", _NO_VISIT, _PERSON), "drug_era", "person")
_events("domain_dose_era", c("DoseEra", dose_value=Range("!bt", 5, 10), unit=(Concept(37),)), _domain("dose_era", "dose_era_id", "dose_era_start_date", "dose_era_end_date", "not (dose_value >= 5 and dose_value <= 10) and unit_concept_id = 37", _NO_VISIT), "dose_era")
# P3-P15 and joins
_events("num_range", c("DrugExposure", quantity=Range("bt", 10, 20.5)), _domain(*_DE, "quantity >= 10 and quantity <= 20.5"), "drug_exposure")
_events("date_range", c("ConditionOccurrence", occurrence_start_date=Range("bt", "1997-01-01", "1997-12-31"), occurrence_end_date=Range("lt", "1997-12-01")),
    _domain(*_CO, "condition_start_date between date '1997-01-01' and date '1997-12-31' and coalesce(condition_end_date, condition_start_date + 1) < date '1997-12-01'"), "condition_occurrence")
_events("not_between", c("DrugExposure", days_supply=Range("!bt", 10, 40)), _domain(*_DE, "not (days_supply >= 10 and days_supply <= 40)"), "drug_exposure")
_events("text_filter", c("ConditionOccurrence", stop_reason=TextFilter("MEDIUM", "!contains")), _domain(*_CO, "stop_reason not like '%MEDIUM%'"), "condition_occurrence")
_events("age_filter", c("VisitOccurrence", age=Range("bt", 18, 35)), _domain(*_VO, "year(visit_start_date) - year_of_birth between 18 and 35", join=_PERSON), "visit_occurrence", "person")
_events("abnormal_ratio", c("Measurement", abnormal=True, range_high_ratio=Range("gt", 0.5)), _domain(*_ME, "(value_as_number < range_low or value_as_number > range_high or value_as_concept_id in (4155142, 4155143)) and value_as_number / nullif(range_high, 0) > 0.5"), "measurement")
_events("date_adjustment", c("VisitOccurrence", adjust=DateAdjustment(5, -5, "START_DATE", "START_DATE"), codeset_id=7), _domain("visit_occurrence", "visit_occurrence_id", "visit_start_date + 5", "visit_start_date - 5", "visit_concept_id in (510, 511)"), "visit_occurrence")
_events("not_in_codeset_nulls", c("Measurement", value_as_concept_cs=Selection(16, True)), _domain(*_ME, "value_as_concept_id not in (331)"), "measurement")
_events("not_in_empty_codeset", c("Measurement", value_as_concept_cs=Selection(11, True)), _domain(*_ME, "value_as_concept_id not in (select concept_id from concept where concept_id = 4155142)"), "measurement", "concept")
_events("codeset_source", c("ConditionOccurrence", codeset_id=3, condition_source_concept=15), _domain(*_CO, "condition_concept_id in (1, 2, 3) and condition_source_concept_id in (11, 12)"), "condition_occurrence")
_events("visit_provider_joins", c("ProcedureOccurrence", visit_type=(Concept(510), Concept(512)), provider_specialty=(Concept(501), Concept(502), Concept(503))),
    _domain(*_PO, "visit_concept_id in (510, 512) and specialty_concept_id in (501, 502, 503)", "t.visit_occurrence_id", "join visit_occurrence v on v.visit_occurrence_id = t.visit_occurrence_id and v.person_id = t.person_id left join provider r on r.provider_id = t.provider_id"), "procedure_occurrence", "visit_occurrence", "provider")
_events("visit_place_location", c("VisitOccurrence", place_of_service_location=6),
    _domain(*_VO, "exists (select 1 from location_history h join location l on l.location_id = h.location_id where h.domain_id = 'CARE_SITE' and h.entity_id = t.care_site_id and region_concept_id in (400, 401) and visit_start_date >= h.start_date and visit_end_date <= coalesce(h.end_date, date '2099-12-31'))"), "visit_occurrence", "location_history", "location")
_events("first_then_filter", c("ConditionOccurrence", codeset_id=3, first=True, condition_type=(Concept(20),)),
    "with r as (select *, row_number() over (partition by person_id order by condition_start_date, condition_occurrence_id) as n from condition_occurrence where condition_concept_id in (1, 2, 3)) " + _domain("r", *_CO[1:], "n = 1 and condition_type_concept_id = 20"), "condition_occurrence")

# C1
_PARTS = "with m as ({}) select distinct concept_id from m"
_BELOW = "select a.descendant_concept_id as concept_id from concept_ancestor a join concept k on k.concept_id = a.descendant_concept_id and k.invalid_reason is null where a.ancestor_concept_id in ({})"


def _concepts(name: str, items: tuple[ConceptItem, ...], sql: str, *tables: str) -> None:
    _add(name, lambda spark, sf_dir: resolve(commerce_cdm(spark, sf_dir), ConceptSet(1, None, items)), sql, *tables)


_concepts("concept_descendants", (ConceptItem(Concept(701), include_descendants=True), ConceptItem(Concept(1004))), _PARTS.format(f"select concept_id from concept where concept_id in (701, 1004) union all {_BELOW.format(701)}"), "concept", "concept_ancestor")
_MAPPED = "select r.concept_id_1 from concept_relationship r join d on d.concept_id = r.concept_id_2 where relationship_id = 'Maps to' and invalid_reason is null"
_concepts("concept_mapped", (ConceptItem(Concept(702), include_descendants=True, include_mapped=True),), f"with d as (select concept_id from concept where concept_id = 702 union all {_BELOW.format(702)}) select distinct concept_id from (select concept_id from d union all {_MAPPED}) x", "concept", "concept_ancestor", "concept_relationship")
_concepts("concept_excluded", (ConceptItem(Concept(703), include_descendants=True), ConceptItem(Concept(704), include_descendants=True), ConceptItem(Concept(704), is_excluded=True, include_descendants=True)),
    f"select distinct concept_id from (select concept_id from concept where concept_id = 703 union all {_BELOW.format(703)}) x where concept_id not in (select concept_id from concept where concept_id = 704 union all {_BELOW.format(704)})", "concept", "concept_ancestor")

# C3, P16
_EV = "ev as (select person_id, condition_occurrence_id as event_id, condition_start_date as start_date, coalesce(condition_end_date, condition_start_date + 1) as end_date, visit_occurrence_id from condition_occurrence where condition_concept_id = 1)"
_Q = f"{_EV}, q as (select row_number() over (partition by ev.person_id order by start_date {{}}, ev.event_id) as event_id, ev.person_id, start_date, end_date, observation_period_start_date as op_start_date, observation_period_end_date as op_end_date, visit_occurrence_id from ev join observation_period o on o.person_id = ev.person_id and start_date between observation_period_start_date and observation_period_end_date {{}})"
_BASE_TABLES = ("condition_occurrence", "observation_period")
_QCOLS = "event_id, person_id, start_date, end_date, op_start_date, op_end_date, visit_occurrence_id"


def _primary(name: str, primary: Primary, sql: str, *tables: str) -> None:
    _add(name, lambda spark, sf_dir: _run(spark, sf_dir, primary=primary).primary, sql, *(tables or _BASE_TABLES))


_primary("primary_all", Primary((CONDITION,)), f"with {_Q.format('', '')} select {_QCOLS} from q")
_primary("primary_first", Primary((CONDITION,), limit="First"), f"with {_Q.format('', '')} select {_QCOLS} from q where event_id = 1")
_primary("primary_last", Primary((CONDITION,), limit="Last"), f"with {_Q.format('desc', '')} select {_QCOLS} from q where event_id = 1")
_primary("obs_window_filter", Primary((CONDITION,), prior_days=365, post_days=30), f"with {_Q.format('', 'where observation_period_start_date + 365 <= start_date and start_date + 30 <= observation_period_end_date')} select {_QCOLS} from q")
_primary("primary_union", Primary((CONDITION, c("Death")), limit="First"),
    f"with {_EV}, u as (select *, 0 as i from ev union all select person_id, person_id, death_date, death_date + 1, null, 1 from death), q as (select row_number() over (partition by u.person_id order by start_date, u.event_id, i) as event_id, u.person_id, start_date, end_date, observation_period_start_date as op_start_date, observation_period_end_date as op_end_date, visit_occurrence_id from u join observation_period o on o.person_id = u.person_id and start_date between observation_period_start_date and observation_period_end_date) select {_QCOLS} from q where event_id = 1", *_BASE_TABLES, "death")

# C5-C7: keys of index events
_A = "a as (select person_id, drug_exposure_id as event_id, drug_exposure_start_date as start_date, coalesce(drug_exposure_end_date, drug_exposure_start_date + days_supply, drug_exposure_start_date + 1) as end_date, visit_occurrence_id, drug_concept_id, quantity from drug_exposure)"
_INSIDE = "a.start_date between q.op_start_date and q.op_end_date"
DRUG = c("DrugExposure")
MONTH = Window(Bound(-1, 30), Bound(1, 30))


def _keys(name: str, group: Group, sql: str, *tables: str) -> None:
    def query(spark, sf_dir):
        result = _run(spark, sf_dir)
        return correlation.group_keys(result.ctx, primary_events(result.ctx, result.expression.primary), group)

    _add(name, query, f"with {_Q.format('', '')}, {_A} " + sql, *_BASE_TABLES, "drug_exposure", *tables)


def _one(name: str, correlated: Correlated, on: str, having: str, left: bool = False, *tables: str) -> None:
    if left:
        sql = f"select q.person_id, q.event_id from q left join a on a.person_id = q.person_id and {on} group by q.person_id, q.event_id having {having}"
    else:
        sql = f"select q.person_id, q.event_id from q join a on a.person_id = q.person_id and {on} group by q.person_id, q.event_id having {having}"
    _keys(name, Group("ALL", criteria=(correlated,)), sql, *tables)


_NEAR = "a.start_date >= q.start_date - 30 and a.start_date <= q.start_date + 30"
_one("corr_at_least", Correlated(DRUG, MONTH, occurrence=Occurrence(2, 2)), f"{_INSIDE} and {_NEAR}", "count(a.event_id) >= 2")
_one("corr_at_most", Correlated(DRUG, MONTH, occurrence=Occurrence(1, 1)), f"{_INSIDE} and {_NEAR}", "count(a.event_id) <= 1", True)
_one("corr_exactly_zero", Correlated(DRUG, MONTH, occurrence=Occurrence(0, 0)), f"{_INSIDE} and {_NEAR}", "count(a.event_id) = 0", True)
_one("corr_exactly", Correlated(DRUG, MONTH, occurrence=Occurrence(0, 1)), f"{_INSIDE} and {_NEAR}", "count(a.event_id) = 1")
_one("corr_distinct", Correlated(DRUG, occurrence=Occurrence(2, 5, True)), _INSIDE, "count(distinct a.drug_concept_id) >= 5")
_one("corr_distinct_column", Correlated(DRUG, occurrence=Occurrence(1, 8, True, "quantity")), _INSIDE, "count(distinct a.quantity) <= 8", True)
_one("window_event_end", Correlated(DRUG, MONTH, Window(Bound(-1, 10), Bound(1, 60), True, True)), f"{_INSIDE} and {_NEAR} and a.end_date >= q.end_date - 10 and a.end_date <= q.end_date + 60", "count(a.event_id) >= 1")
_one("window_unbounded", Correlated(DRUG, Window(Bound(-1), Bound(-1, 1)), occurrence=Occurrence(2, 3)), f"{_INSIDE} and a.start_date >= q.op_start_date and a.start_date <= q.start_date - 1", "count(a.event_id) >= 3")
_one("ignore_obs_period", Correlated(DRUG, Window(Bound(1, 0), Bound(1)), occurrence=Occurrence(2, 4), ignore_observation_period=True), "a.start_date >= q.start_date", "count(a.event_id) >= 4")
_one("restrict_visit", Correlated(DRUG, restrict_visit=True, occurrence=Occurrence(2, 2)), f"{_INSIDE} and a.visit_occurrence_id = q.visit_occurrence_id", "count(a.event_id) >= 2")
_TWO = (Correlated(DRUG, MONTH), Correlated(DRUG, Window(Bound(1, 1), Bound(1, 200)), occurrence=Occurrence(2, 3)), Correlated(c("VisitOccurrence", codeset_id=7), Window(Bound(-1, 0), Bound(1, 0))))
_K = (f"k1 as (select distinct q.person_id, q.event_id from q join a on a.person_id = q.person_id and {_INSIDE} and {_NEAR}), k2 as (select q.person_id, q.event_id from q join a on a.person_id = q.person_id and {_INSIDE} and a.start_date between q.start_date + 1 and q.start_date + 200 group by all having count(a.event_id) >= 3), "
    "k3 as (select distinct q.person_id, q.event_id from q join visit_occurrence v on v.person_id = q.person_id and v.visit_concept_id in (510, 511) and v.visit_start_date between q.op_start_date and q.op_end_date and v.visit_start_date = q.start_date), k as (select * from k1 union all select * from k2 union all select * from k3)")
for _name, _group, _having in (("group_all", Group("ALL", criteria=_TWO), "= 3"), ("group_any", Group("ANY", criteria=_TWO), "> 0"), ("group_at_least", Group("AT_LEAST", 2, _TWO), ">= 2"), ("group_at_most", Group("AT_MOST", 1, _TWO), "<= 1")):
    _keys(_name, _group, f", {_K} select q.person_id, q.event_id from q left join k on k.person_id = q.person_id and k.event_id = q.event_id group by q.person_id, q.event_id having count(k.event_id) {_having}", "visit_occurrence")
_keys("group_nested", Group("ALL", criteria=(_TWO[0],), groups=(Group("ANY", criteria=_TWO[1:]),)), f", {_K} select q.person_id, q.event_id from q where exists (select 1 from k1 where k1.person_id = q.person_id and k1.event_id = q.event_id) and (exists (select 1 from k2 where k2.person_id = q.person_id and k2.event_id = q.event_id) or exists (select 1 from k3 where k3.person_id = q.person_id and k3.event_id = q.event_id))", "visit_occurrence")
_keys("demographic", Group("ALL", demographics=(Demographic(Range("bt", 20, 50), (Concept(8507),), race=(Concept(8526), Concept(8527)), occurrence_start_date=Range("gt", "1997-06-01")),)),
    "select q.person_id, q.event_id from q join person p on p.person_id = q.person_id where year(q.start_date) - year_of_birth between 20 and 50 and gender_concept_id = 8507 and race_concept_id in (8526, 8527) and q.start_date > date '1997-06-01'", "person")

# C19, C4, C8-C16
_NEST = Group("ALL", criteria=(Correlated(DRUG, MONTH),))
_add("nested_correlated", lambda spark, sf_dir: _run(spark, sf_dir, primary=Primary((c("ConditionOccurrence", _NEST, codeset_id=1),))).primary,
    f"with ev0 as (select person_id, condition_occurrence_id as event_id, condition_start_date as start_date, coalesce(condition_end_date, condition_start_date + 1) as end_date, visit_occurrence_id from condition_occurrence where condition_concept_id = 1), {_A}, ev as (select e.* from ev0 e where exists (select 1 from observation_period o join a on a.person_id = o.person_id and a.start_date between o.observation_period_start_date and o.observation_period_end_date and a.start_date between e.start_date - 30 and e.start_date + 30 where o.person_id = e.person_id and e.start_date between o.observation_period_start_date and o.observation_period_end_date)), " + _Q.format("", "").split("), ", 1)[1] + f" select {_QCOLS} from q", *_BASE_TABLES, "drug_exposure")
_K1 = _K.split(", k2 as")[0]
_add("qualified_limit", lambda spark, sf_dir: _run(spark, sf_dir, additional=Group("ALL", criteria=(_TWO[0],)), qualified_limit="First").qualified,
    f"with {_Q.format('', '')}, {_A}, {_K1}, r as (select q.*, row_number() over (partition by q.person_id order by q.start_date, q.event_id) as n from q join k1 on k1.person_id = q.person_id and k1.event_id = q.event_id) select {_QCOLS} from r where n = 1", *_BASE_TABLES, "drug_exposure")
RULES = (Rule("a drug near", None, Group("ALL", criteria=(_TWO[0],))), Rule("three drugs after", None, Group("ALL", criteria=(_TWO[1],))), Rule("a visit that day", None, Group("ALL", criteria=(_TWO[2],))))
_MET = f"{_Q.format('', '')}, {_A}, {_K}, i as (select 0 as r, * from k1 union all select 1, * from k2 union all select 2, * from k3), m as (select q.person_id, q.event_id, q.start_date, q.end_date, q.op_start_date, q.op_end_date, q.visit_occurrence_id, cast(coalesce(sum(1 << r), 0) as bigint) as mask, count(r) as n, coalesce(min(r), 0) as least from q left join i on i.person_id = q.person_id and i.event_id = q.event_id group by all)"
_MT = (*_BASE_TABLES, "drug_exposure", "visit_occurrence")
_add("inclusion_mask", lambda spark, sf_dir: _run(spark, sf_dir, rules=RULES).masked.select("person_id", "event_id", "inclusion_rule_mask"), f"with {_MET} select person_id, event_id, mask as inclusion_rule_mask from m", *_MT)
_add("inclusion_rules", lambda spark, sf_dir: _run(spark, sf_dir, rules=RULES[:2], expression_limit="First").included, f"with {_MET}, r as (select *, row_number() over (partition by person_id order by start_date, event_id) as nth from m where mask & 3 = 3) select {_QCOLS} from r where nth = 1", *_MT)


def _ends(name: str, sql: str, *tables: str, **parts) -> None:
    _add(name, lambda spark, sf_dir: _run(spark, sf_dir, **parts).exits.select("person_id", "event_id", "start_date", "end_date"), f"with {_Q.format('', '')} " + sql, *(tables or _BASE_TABLES))


_ends("date_offset_end", "select person_id, event_id, start_date, least(end_date + 45, op_end_date) as end_date from q where least(end_date + 45, op_end_date) >= start_date", end_strategy=DateOffset("EndDate", 45))
_CENSOR = "select q.person_id, q.event_id, min(v.visit_start_date) as e from q join visit_occurrence v on v.person_id = q.person_id and v.visit_concept_id = 512 and v.visit_start_date between q.start_date and q.op_end_date group by q.person_id, q.event_id"
_ends("censoring", f", ce as (select person_id, event_id, op_end_date as e from q union all {_CENSOR}) select q.person_id, q.event_id, q.start_date, min(e) as end_date from q join ce on ce.person_id = q.person_id and ce.event_id = q.event_id and e >= q.start_date group by q.person_id, q.event_id, q.start_date",
    *_BASE_TABLES, "visit_occurrence", censoring=(c("VisitOccurrence", visit_source_concept=None, codeset_id=13),))
_FOLD = "f1 as (select *, case when max(e) over (partition by person_id order by s, e rows between unbounded preceding and 1 preceding) + {pad} >= s then 0 else 1 end as b from {rows}), f2 as (select *, sum(b) over (partition by person_id order by s, e rows unbounded preceding) as g from f1), eras as (select person_id, min(s) as s, max(e) as e from f2 group by person_id, g)"
_ERA = ("d as (select person_id, drug_exposure_start_date as s, coalesce(drug_exposure_end_date, drug_exposure_start_date + days_supply, drug_exposure_start_date + 1) + 5 as e from drug_exposure where drug_concept_id between 1001 and 1010 union all select person_id, drug_exposure_start_date, coalesce(drug_exposure_end_date, drug_exposure_start_date + days_supply, drug_exposure_start_date + 1) + 5 from drug_exposure where drug_source_concept_id between 1001 and 1010), " + _FOLD.format(pad=60, rows="d"))
_ends("custom_era_end", f", {_ERA}, ce as (select person_id, event_id, op_end_date as e from q union all select q.person_id, q.event_id, eras.e from q join eras on eras.person_id = q.person_id and q.start_date between eras.s and eras.e) select q.person_id, q.event_id, q.start_date, min(e) as end_date from q join ce on ce.person_id = q.person_id and ce.event_id = q.event_id and e >= q.start_date group by q.person_id, q.event_id, q.start_date",
    *_BASE_TABLES, "drug_exposure", end_strategy=CustomEra(4, 60, 5))
_ends("earliest_end", "select person_id, event_id, start_date, op_end_date as end_date from q")


def _cohort(name: str, sql: str, *tables: str, **parts) -> None:
    _add(name, lambda spark, sf_dir: _run(spark, sf_dir, **parts).cohort, f"with {_Q.format('', '')}, " + sql, *(tables or _BASE_TABLES))


_OUT = "select cast(1 as bigint) as cohort_definition_id, person_id as subject_id, s as cohort_start_date, e as cohort_end_date from eras"
_cohort("era_collapse", "x as (select person_id, start_date as s, least(start_date + 30, op_end_date) as e from q), " + _FOLD.format(pad=200, rows="x") + " " + _OUT, end_strategy=DateOffset("StartDate", 30), collapse=Collapse("ERA", 200))
_cohort("censor_window", "x as (select person_id, start_date as s, op_end_date as e from q), " + _FOLD.format(pad=0, rows="x") + ", w as (select person_id, greatest(s, date '1997-01-01') as s, least(e, date '2000-06-30') as e from eras) " + _OUT.replace("eras", "w") + " where s <= e", censor_window=Period("1997-01-01", "2000-06-30"))
_ONE = f"with {_MET}, "
for _mode, _rows in ((0, "e as (select * from m)"), (1, "e as (select * exclude (rk) from (select *, row_number() over (partition by person_id order by n desc, least, start_date, event_id) as rk from m) where rk = 1)")):
    _tail = "" if _mode == 0 else "_best"
    _add(f"inclusion_result{_tail}", lambda spark, sf_dir, m=_mode: _run(spark, sf_dir, rules=RULES).inclusion_result(m), _ONE + _rows + f" select cast(1 as bigint) as cohort_definition_id, mask as inclusion_rule_mask, count(*) as person_count, {_mode} as mode_id from e group by mask", *_MT)
    _add(f"inclusion_stats{_tail}", lambda spark, sf_dir, m=_mode: _run(spark, sf_dir, rules=RULES).inclusion_stats(m), _ONE + _rows + f" select cast(1 as bigint) as cohort_definition_id, cast(r as integer) as rule_sequence, (select count(*) from e where mask & (1 << r) > 0) as person_count, (select count(*) from e where mask = 7 - (1 << r)) as gain_count, (select count(*) from e) as person_total, {_mode} as mode_id from (select unnest([0, 1, 2]) as r) rules", *_MT)
    _add(f"summary_stats{_tail}", lambda spark, sf_dir, m=_mode: _run(spark, sf_dir, rules=RULES).summary_stats(m), _ONE + _rows + f" select cast(1 as bigint) as cohort_definition_id, count(*) as base_count, count(*) filter (mask = 7) as final_count, {_mode} as mode_id from e", *_MT)
_add("best_event", lambda spark, sf_dir: _run(spark, sf_dir, rules=RULES).best_events.select("person_id", "event_id"), _ONE + "e as (select *, row_number() over (partition by person_id order by n desc, least, start_date, event_id) as rk from m) select person_id, event_id from e where rk = 1", *_MT)
FULL = {"rules": RULES[:2], "expression_limit": "All", "end_strategy": CustomEra(4, 60, 5), "censoring": (c("VisitOccurrence", codeset_id=13),), "collapse": Collapse("ERA", 30), "censor_window": Period("1996-01-01", None)}
_add("full_cohort", lambda spark, sf_dir: _run(spark, sf_dir, **FULL).cohort,
    f"with {_MET}, z as (select * from m where mask & 3 = 3), {_ERA.replace('eras as', 'deras as')}, ce as (select person_id, event_id, op_end_date as e from z union all select z.person_id, z.event_id, deras.e from z join deras on deras.person_id = z.person_id and z.start_date between deras.s and deras.e union all {_CENSOR.replace('from q ', 'from z q ')}), "
    "x as (select z.person_id, z.start_date as s, min(ce.e) as e from z join ce on ce.person_id = z.person_id and ce.event_id = z.event_id and ce.e >= z.start_date group by z.person_id, z.event_id, z.start_date), " + _FOLD.format(pad=30, rows="x").replace("f1", "g1").replace("f2", "g2") + ", w as (select person_id, greatest(s, date '1996-01-01') as s, e from eras) " + _OUT.replace("eras", "w") + " where s <= e", *_MT)

#: The expression that entry() runs: a first event with a year before it and a day after.
FLAGSHIP = Cohort(title="First urgent order", concept_sets=(ids(1, 1),), primary=Primary((c("ConditionOccurrence", codeset_id=1, first=True),), prior_days=365, post_days=1))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CohortEngine(spark, commerce_cdm(spark, sf_dir)).run(FLAGSHIP).cohort


def _flag_sql() -> str:
    first = "r as (select person_id, condition_occurrence_id as event_id, condition_start_date as start_date, row_number() over (partition by person_id order by condition_start_date, condition_occurrence_id) as n from condition_occurrence where condition_concept_id = 1)"
    return f"with {first} select cast(1 as bigint) as cohort_definition_id, r.person_id as subject_id, start_date as cohort_start_date, observation_period_end_date as cohort_end_date from r join observation_period o on o.person_id = r.person_id and start_date between observation_period_start_date and observation_period_end_date where n = 1 and observation_period_start_date + 365 <= start_date and start_date + 1 <= observation_period_end_date"


_add("flagship", flagship, _flag_sql(), *_BASE_TABLES)


# rows only: what isn't a query over tables


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..render import markdown

    return spark.createDataFrame(list(enumerate(markdown(Cohort(concept_sets=SETS, primary=Primary((CONDITION,)), **FULL)).split("\n"))), "line int, text string")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..checks import check

    return spark.createDataFrame([(f.severity, f.check, f.message) for f in check(Cohort(concept_sets=SETS, primary=Primary((CONDITION,)), **FULL))], "severity string, check string, message string")


_add("markdown_render", _lines, None)
_add("check_warnings", _findings, None)
