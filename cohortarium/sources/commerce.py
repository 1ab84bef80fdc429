"""A clinical data model projected from commerce tables (customers are people, orders are visits and conditions ...).

Every projection is one SQL text that Spark and other engines read alike; braces name the tables it reads. The same
texts serve as common table expressions in the SQL that results are compared with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .cdm import Cdm

_DAY = "cast(o_orderdate as date)"
_VISIT = "o_orderkey as visit_occurrence_id, o_orderkey % 10 as provider_id"

PROJECTIONS = {
    "person": "select c_custkey as person_id, cast(1930 + c_custkey % 60 as int) as year_of_birth, cast(case when c_mktsegment in ('BUILDING', 'MACHINERY') then 8507 else 8532 end as bigint) as gender_concept_id, cast(8527 - c_nationkey % 3 as bigint) as race_concept_id, 38003563 + c_custkey % 2 as ethnicity_concept_id from {customer}",
    "observation_period": f"select o_custkey as observation_period_id, o_custkey as person_id, min({_DAY}) as observation_period_start_date, max({_DAY}) + 180 as observation_period_end_date, cast(590 + o_custkey % 3 as bigint) as period_type_concept_id from {{orders}} group by o_custkey",
    "visit_occurrence": f"select o_orderkey as visit_occurrence_id, o_custkey as person_id, cast(510 + o_orderkey % 4 as bigint) as visit_concept_id, cast(515 + o_orderkey % 3 as bigint) as visit_source_concept_id, {_DAY} as visit_start_date, {_DAY} + cast(o_orderkey % 7 as int) as visit_end_date, cast(520 + o_orderkey % 2 as bigint) as visit_type_concept_id, o_orderkey % 10 as provider_id, o_orderkey % 25 as care_site_id from {{orders}}",
    "visit_detail": f"select o_orderkey as visit_detail_id, o_custkey as person_id, cast(530 + o_orderkey % 4 as bigint) as visit_detail_concept_id, cast(535 + o_orderkey % 3 as bigint) as visit_detail_source_concept_id, {_DAY} as visit_detail_start_date, {_DAY} + cast(o_orderkey % 5 as int) as visit_detail_end_date, cast(540 + o_orderkey % 2 as bigint) as visit_detail_type_concept_id, o_orderkey % 25 as care_site_id, {_VISIT} from {{orders}}",
    "condition_occurrence": f"select o_orderkey as condition_occurrence_id, o_custkey as person_id, cast(substr(o_orderpriority, 1, 1) as bigint) as condition_concept_id, cast(10 + o_orderkey % 6 as bigint) as condition_source_concept_id, {_DAY} as condition_start_date, case when o_orderkey % 3 <> 0 then {_DAY} + cast(o_orderkey % 11 as int) end as condition_end_date, cast(20 + o_orderkey % 3 as bigint) as condition_type_concept_id, cast(25 + o_orderkey % 4 as bigint) as condition_status_concept_id, case when o_orderkey % 4 > 0 then o_orderpriority end as stop_reason, {_VISIT}, o_orderkey as visit_detail_id from {{orders}}",
    "drug_exposure": "select ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey as drug_exposure_id, o_custkey as person_id, 1000 + l_partkey as drug_concept_id, 1000 + (l_partkey + 1) % 50 as drug_source_concept_id, cast(l_shipdate as date) as drug_exposure_start_date, case when l_linenumber % 2 = 0 then cast(l_shipdate as date) + 20 end as drug_exposure_end_date, cast(30 + l_linenumber % 3 as bigint) as drug_type_concept_id, case when l_returnflag <> 'N' then l_returnflag end as stop_reason, cast(l_linenumber as int) as refills, l_quantity as quantity, case when l_linenumber % 3 > 0 then cast(l_quantity as int) end as days_supply, cast(35 + l_linenumber % 2 as bigint) as route_concept_id, cast(37 + l_linenumber % 2 as bigint) as dose_unit_concept_id, l_linestatus as lot_number, o_orderkey as visit_occurrence_id, l_suppkey % 10 as provider_id from {lineitem} join {orders} on l_orderkey = o_orderkey",
    "procedure_occurrence": f"select o_orderkey as procedure_occurrence_id, o_custkey as person_id, cast(100 + o_orderkey % 7 as bigint) as procedure_concept_id, cast(110 + o_orderkey % 4 as bigint) as procedure_source_concept_id, {_DAY} + cast(o_orderkey % 5 as int) as procedure_date, cast(115 + o_orderkey % 2 as bigint) as procedure_type_concept_id, cast(117 + o_orderkey % 2 as bigint) as modifier_concept_id, cast(1 + o_orderkey % 4 as int) as quantity, {_VISIT} from {{orders}}",
    "device_exposure": f"select o_orderkey as device_exposure_id, o_custkey as person_id, cast(120 + o_orderkey % 5 as bigint) as device_concept_id, cast(126 + o_orderkey % 3 as bigint) as device_source_concept_id, {_DAY} as device_exposure_start_date, case when o_orderkey % 2 = 0 then {_DAY} + 9 end as device_exposure_end_date, cast(130 + o_orderkey % 2 as bigint) as device_type_concept_id, concat('DEV-', o_orderpriority) as unique_device_id, cast(o_orderkey % 6 as int) as quantity, {_VISIT} from {{orders}}",
    "observation": f"select o_orderkey as observation_id, o_custkey as person_id, cast(200 + o_orderkey % 4 as bigint) as observation_concept_id, cast(205 + o_orderkey % 3 as bigint) as observation_source_concept_id, {_DAY} as observation_date, o_totalprice as value_as_number, o_orderpriority as value_as_string, cast(210 + o_orderkey % 3 as bigint) as value_as_concept_id, cast(215 + o_orderkey % 2 as bigint) as unit_concept_id, cast(217 + o_orderkey % 2 as bigint) as qualifier_concept_id, cast(219 + o_orderkey % 2 as bigint) as observation_type_concept_id, {_VISIT} from {{orders}}",
    "measurement": "select event_id as measurement_id, user_id as person_id, cast(300 + length(event_type) as bigint) as measurement_concept_id, cast(320 + event_id % 3 as bigint) as measurement_source_concept_id, cast(ts as date) + (-8766) as measurement_date, value as value_as_number, case when event_id % 5 > 0 then cast(event_id % 20 as double) end as range_low, case when event_id % 7 > 0 then cast(20 + event_id % 40 as double) end as range_high, case when event_id % 9 = 0 then cast(4155142 as bigint) end as value_as_concept_id, cast(330 + event_id % 3 as bigint) as operator_concept_id, cast(335 + event_id % 2 as bigint) as unit_concept_id, cast(340 + event_id % 2 as bigint) as measurement_type_concept_id, event_id % 10 as provider_id, case when event_id % 4 > 0 then event_id end as visit_occurrence_id from {events}",
    "specimen": f"select o_orderkey as specimen_id, o_custkey as person_id, cast(350 + o_orderkey % 3 as bigint) as specimen_concept_id, cast(355 + o_orderkey % 3 as bigint) as specimen_source_concept_id, {_DAY} as specimen_date, cast(360 + o_orderkey % 2 as bigint) as specimen_type_concept_id, o_totalprice as quantity, cast(365 + o_orderkey % 2 as bigint) as unit_concept_id, cast(367 + o_orderkey % 2 as bigint) as anatomic_site_concept_id, cast(369 + o_orderkey % 2 as bigint) as disease_status_concept_id, o_orderpriority as specimen_source_id from {{orders}}",
    "death": "select person_id, observation_period_end_date + (-30) as death_date, cast(370 + person_id % 2 as bigint) as death_type_concept_id, cast(375 + person_id % 3 as bigint) as cause_concept_id, cast(380 + person_id % 2 as bigint) as cause_source_concept_id from {observation_period}",
    "payer_plan_period": "select person_id as payer_plan_period_id, person_id, observation_period_start_date as payer_plan_period_start_date, observation_period_start_date + 365 as payer_plan_period_end_date, cast(385 + person_id % 4 as bigint) as payer_concept_id, cast(390 + person_id % 3 as bigint) as plan_concept_id, cast(395 + person_id % 2 as bigint) as sponsor_concept_id from {observation_period}",
    "condition_era": "select person_id * 10 + condition_concept_id as condition_era_id, person_id, condition_concept_id, min(condition_start_date) as condition_era_start_date, max(condition_start_date) as condition_era_end_date, cast(count(*) as int) as condition_occurrence_count from {condition_occurrence} group by person_id, condition_concept_id",
    "drug_era": "select person_id * 10 + drug_concept_id % 10 as drug_era_id, person_id, 1000 + drug_concept_id % 10 as drug_concept_id, min(drug_exposure_start_date) as drug_era_start_date, max(drug_exposure_start_date) as drug_era_end_date, cast(count(*) as int) as drug_exposure_count, cast(count(*) % 7 as int) as gap_days from {drug_exposure} group by person_id, drug_concept_id % 10",
    "dose_era": "select drug_era_id as dose_era_id, person_id, drug_concept_id, cast(37 + drug_era_id % 2 as bigint) as unit_concept_id, cast(drug_exposure_count as double) * 2.5 as dose_value, drug_era_start_date as dose_era_start_date, drug_era_end_date as dose_era_end_date from {drug_era}",
    "location": "select cast(n_nationkey as bigint) as location_id, cast(400 + n_regionkey as bigint) as region_concept_id from {nation}",
    "location_history": "select c_custkey as location_history_id, cast(c_nationkey as bigint) as location_id, c_custkey as entity_id, 'PERSON' as domain_id, date '1996-01-01' as start_date, case when c_custkey % 2 = 0 then date '1999-12-31' end as end_date from {customer} union all select cast(-1 - n_nationkey as bigint), cast(n_nationkey as bigint), cast(n_nationkey as bigint), 'CARE_SITE', date '1996-01-01', case when n_nationkey % 2 = 0 then date '1999-12-31' end from {nation}",
    "provider": "select s_suppkey as provider_id, cast(500 + s_nationkey % 6 as bigint) as specialty_concept_id from {supplier}",
    "care_site": "select cast(n_nationkey as bigint) as care_site_id, cast(506 + n_nationkey % 3 as bigint) as place_of_service_concept_id from {nation}",
    "concept": "select cast(a.n_nationkey * 25 + b.n_nationkey + 1 as bigint) as concept_id, cast(null as varchar(20)) as invalid_reason from {nation} a cross join {nation} b union all select cast(700 + cast(substr(p_brand, 7) as bigint) as bigint), cast(null as varchar(20)) from {part} group by 1 union all select 1000 + p_partkey, case when p_partkey % 9 = 4 then 'D' end from {part} union all select cast(x as bigint), cast(null as varchar(20)) from (values (8507), (8532), (8525), (8526), (8527), (38003563), (38003564), (4155143)) as v(x)",
    "concept_ancestor": "select cast(700 + cast(substr(p_brand, 7) as bigint) as bigint) as ancestor_concept_id, 1000 + p_partkey as descendant_concept_id from {part}",
    "concept_relationship": "select 1000 + p_partkey as concept_id_1, 1000 + p_partkey - p_partkey % 5 as concept_id_2, case when p_partkey % 4 < 3 then 'Maps to' else 'Is a' end as relationship_id, case when p_partkey % 10 = 9 then 'D' end as invalid_reason from {part}",
}


def commerce_cdm(spark: SparkSession, sf_dir: str) -> Cdm:
    """The model over the Parquet tables of a folder."""
    made: dict[str, DataFrame] = {}

    def load(name: str) -> DataFrame | None:
        if name in made:
            return made[name]
        text = PROJECTIONS.get(name)
        if text is None:
            return None
        import string

        needs = {f for _, f, _, _ in string.Formatter().parse(text) if f}
        given = {n: load(n) if n in PROJECTIONS else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in needs}
        made[name] = spark.sql(text, **given)
        return made[name]

    return Cdm(spark, load)


def common_tables(*names: str) -> str:
    """WITH clause text of the tables named and of those they read, each once."""
    import string

    out: dict[str, str] = {}

    def add(name: str) -> None:
        needs = [f for _, f, _, _ in string.Formatter().parse(PROJECTIONS[name]) if f]
        for n in needs:
            if n in PROJECTIONS and n not in out:
                add(n)
        out.setdefault(name, f"{name} as ({PROJECTIONS[name].format_map({n: n for n in needs})})")

    for n in names:
        add(n)
    return ", ".join(out.values())
