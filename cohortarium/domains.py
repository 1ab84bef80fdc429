"""The sixteen event domains, declared: table, key, dates, concept columns, attributes and countable columns.

One generic operator (operators.events) turns a declaration and a criterion into events; parsing, checks, rendering
and code generation read the same declarations. Expressions are Spark SQL over the domain's own columns; in attribute
expressions, start_date and end_date are the event's (adjusted) dates.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Attribute:
    """kind: date, number, age, length, concepts, selection, codeset, text, flag, period.

    on: the expression that is compared; through: person, visit, provider, care_site or place, if the value is there.
    decimals: numbers are compared at so many decimals; None means whole numbers.
    """

    name: str
    kind: str
    on: str | None = None
    through: str | None = None
    decimals: int | None = None
    exclude: str | None = None
    phrase: str | None = None


@dataclass(frozen=True)
class Domain:
    kind: str
    table: str
    key: str
    start: str
    end: str
    noun: str
    concept: str | None = None
    source: tuple[str, str] | None = None
    visit: str | None = "visit_occurrence_id"
    attributes: tuple[Attribute, ...] = ()
    counts: tuple[tuple[str, str], ...] = ()
    first: bool = True
    any_name: str = ""

    def attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)


def _date(name: str, on: str, phrase: str) -> Attribute:
    return Attribute(name, "date", on, phrase=phrase)


def _listed(name: str, on: str, phrase: str, through: str | None = None, exclude: str | None = None, cs: bool = True) -> tuple[Attribute, ...]:
    both = (Attribute(name, "concepts", on, through, exclude=exclude, phrase=phrase),)
    if cs:
        both += (Attribute(f"{name}_cs", "selection", on, through, phrase=phrase),)
    if exclude:
        both += (Attribute(exclude, "flag"),)
    return both


def _number(name: str, on: str, phrase: str, decimals: int | None = None) -> Attribute:
    return Attribute(name, "number", on, decimals=decimals, phrase=phrase)


_OCCURRENCE = (_date("occurrence_start_date", "start_date", "starting"), _date("occurrence_end_date", "end_date", "ending"))
_ONLY_START = (_date("occurrence_start_date", "start_date", "starting"), Attribute("occurrence_end_date", "date"))
_AGE = (Attribute("age", "age", "start_date", "person", phrase="who are {} years old"),)
_AGES = (Attribute("age_at_start", "age", "start_date", "person", phrase="who are {} years old at start"), Attribute("age_at_end", "age", "end_date", "person", phrase="who are {} years old at end"))
_GENDER = _listed("gender", "gender_concept_id", "gender", "person")
_PROVIDER = _listed("provider_specialty", "specialty_concept_id", "a provider specialty that is", "provider")
_VISIT = _listed("visit_type", "visit_concept_id", "a visit occurrence that is", "visit")
_BASE = (Attribute("codeset_id", "codeset"), Attribute("first", "flag"))
_ERA = (_date("era_start_date", "start_date", "starting"), _date("era_end_date", "end_date", "ending"))
_ERA_LENGTH = (Attribute("era_length", "length", "datediff(end_date, start_date)", phrase="with era length {} days"),)
_COUNTED = (("start_date", "start_date"), ("end_date", "end_date"), ("duration", "datediff(end_date, start_date)"))
_VISITS = (("visit_occurrence_id", "visit_occurrence_id"),)


def _counts(concept: str | None, source: str | None, *more: str) -> tuple[tuple[str, str], ...]:
    out = _COUNTED
    if concept:
        out += (("domain_concept_id", concept),)
    if source:
        out += (("domain_source_concept_id", source),)
    return out + tuple((m, m) for m in more)


def _next_day(column: str) -> str:
    return f"date_add({column}, 1)"


_ALL = (
    Domain("ConditionOccurrence", "condition_occurrence", "condition_occurrence_id", "condition_start_date", f"coalesce(condition_end_date, {_next_day('condition_start_date')})", "condition occurrence",
        "condition_concept_id", ("condition_source_concept", "condition_source_concept_id"),
        attributes=(*_BASE, Attribute("condition_source_concept", "codeset"), *_OCCURRENCE, *_AGE, *_GENDER, *_listed("condition_type", "condition_type_concept_id", "a condition type that", exclude="condition_type_exclude"),
            Attribute("stop_reason", "text", "stop_reason", phrase="with a stop reason"), *_PROVIDER, *_listed("condition_status", "condition_status_concept_id", "a condition status that is"), *_VISIT),
        counts=_counts("condition_concept_id", "condition_source_concept_id", "visit_occurrence_id", "visit_detail_id"), any_name="any condition"),
    Domain("DrugExposure", "drug_exposure", "drug_exposure_id", "drug_exposure_start_date", f"coalesce(drug_exposure_end_date, date_add(drug_exposure_start_date, cast(days_supply as int)), {_next_day('drug_exposure_start_date')})", "drug exposure",
        "drug_concept_id", ("drug_source_concept", "drug_source_concept_id"),
        attributes=(*_BASE, Attribute("drug_source_concept", "codeset"), *_OCCURRENCE, *_AGE, *_GENDER, *_listed("drug_type", "drug_type_concept_id", "a drug type that", exclude="drug_type_exclude"),
            _number("refills", "refills", "with refills {}"), _number("quantity", "quantity", "with quantity {}", 4), _number("days_supply", "days_supply", "with days supply {} days"), Attribute("effective_drug_dose", "number", phrase="with effective drug dose {}"),
            *_listed("dose_unit", "dose_unit_concept_id", "dose unit"), *_listed("route_concept", "route_concept_id", "with route"), Attribute("lot_number", "text", "lot_number", phrase="lot number"),
            Attribute("stop_reason", "text", "stop_reason", phrase="with a stop reason"), *_PROVIDER, *_VISIT),
        counts=_counts("drug_concept_id", "drug_source_concept_id", "days_supply", "quantity", "refills", "visit_occurrence_id", "visit_detail_id"), any_name="any drug"),
    Domain("ProcedureOccurrence", "procedure_occurrence", "procedure_occurrence_id", "procedure_date", _next_day("procedure_date"), "procedure occurrence",
        "procedure_concept_id", ("procedure_source_concept", "procedure_source_concept_id"),
        attributes=(*_BASE, Attribute("procedure_source_concept", "codeset"), *_ONLY_START, *_AGE, *_GENDER, *_listed("procedure_type", "procedure_type_concept_id", "a procedure type that", exclude="procedure_type_exclude"),
            *_listed("modifier", "modifier_concept_id", "with modifier"), _number("quantity", "quantity", "with quantity {}"), *_PROVIDER, *_VISIT),
        counts=(*_counts("procedure_concept_id", "procedure_source_concept_id", "quantity", "visit_occurrence_id")[0:2], ("duration", "1"), ("domain_concept_id", "procedure_concept_id"), ("domain_source_concept_id", "procedure_source_concept_id"), ("quantity", "quantity"), *_VISITS), any_name="any procedure"),
    Domain("VisitOccurrence", "visit_occurrence", "visit_occurrence_id", "visit_start_date", "visit_end_date", "visit occurrence",
        "visit_concept_id", ("visit_source_concept", "visit_source_concept_id"),
        attributes=(*_BASE, Attribute("visit_source_concept", "codeset"), *_OCCURRENCE, *_AGE, *_GENDER, *_listed("visit_type", "visit_type_concept_id", "a visit type that", exclude="visit_type_exclude"), *_PROVIDER,
            *_listed("place_of_service", "place_of_service_concept_id", "a place of service that is", "care_site"), Attribute("place_of_service_location", "codeset", "region_concept_id", "place"),
            Attribute("visit_length", "length", "datediff(end_date, start_date)", phrase="with length {} days")),
        counts=_counts("visit_concept_id", "visit_source_concept_id", "visit_occurrence_id"), any_name="any visit"),
    Domain("VisitDetail", "visit_detail", "visit_detail_id", "visit_detail_start_date", "visit_detail_end_date", "visit detail",
        "visit_detail_concept_id", ("visit_detail_source_concept", "visit_detail_source_concept_id"),
        attributes=(*_BASE, Attribute("visit_detail_source_concept", "codeset"), _date("visit_detail_start_date", "start_date", "starting"), _date("visit_detail_end_date", "end_date", "ending"),
            Attribute("age", "age", "end_date", "person", phrase="who are {} years old"), *_GENDER, *_listed("visit_detail_type", "visit_detail_type_concept_id", "a visit detail type that", exclude="visit_detail_type_exclude"), *_PROVIDER,
            *_listed("place_of_service", "place_of_service_concept_id", "a place of service that is", "care_site"), Attribute("place_of_service_location", "codeset", "region_concept_id", "place"),
            *_listed("discharge_to", "discharge_to_concept_id", "discharged to"), Attribute("visit_detail_length", "length", "datediff(end_date, start_date)", phrase="with length {} days")),
        counts=_counts("visit_detail_concept_id", "visit_detail_source_concept_id", "visit_occurrence_id", "visit_detail_id"), any_name="any visit detail"),
    Domain("Observation", "observation", "observation_id", "observation_date", _next_day("observation_date"), "observation",
        "observation_concept_id", ("observation_source_concept", "observation_source_concept_id"),
        attributes=(*_BASE, Attribute("observation_source_concept", "codeset"), *_OCCURRENCE, *_AGE, *_GENDER, *_listed("observation_type", "observation_type_concept_id", "an observation type that", exclude="observation_type_exclude"),
            _number("value_as_number", "value_as_number", "numeric value {}", 4), *_listed("unit", "unit_concept_id", "unit"), *_listed("value_as_concept", "value_as_concept_id", "with value as concept"),
            Attribute("value_as_string", "text", "value_as_string", phrase="with value as string"), *_listed("qualifier", "qualifier_concept_id", "with qualifier"), *_PROVIDER, *_VISIT),
        counts=_counts("observation_concept_id", "observation_source_concept_id", "value_as_number", "unit_concept_id", "visit_occurrence_id"), any_name="any observation"),
    Domain("Measurement", "measurement", "measurement_id", "measurement_date", _next_day("measurement_date"), "measurement",
        "measurement_concept_id", ("measurement_source_concept", "measurement_source_concept_id"),
        attributes=(*_BASE, Attribute("measurement_source_concept", "codeset"), *_ONLY_START, *_AGE, *_GENDER, *_listed("measurement_type", "measurement_type_concept_id", "a measurement type that", exclude="measurement_type_exclude"),
            *_listed("operator", "operator_concept_id", "with operator"), _number("value_as_number", "value_as_number", "numeric value {}", 4), Attribute("value_as_string", "text", phrase="with value as string"), *_listed("unit", "unit_concept_id", "unit"),
            *_listed("value_as_concept", "value_as_concept_id", "with value as concept"), _number("range_low", "range_low", "low range {}", 4), _number("range_high", "range_high", "high range {}", 4),
            _number("range_low_ratio", "value_as_number / nullif(range_low, 0)", "low range-to-value ratio {}", 4), _number("range_high_ratio", "value_as_number / nullif(range_high, 0)", "high range-to-value ratio {}", 4),
            Attribute("abnormal", "flag", "value_as_number < range_low or value_as_number > range_high or value_as_concept_id in (4155142, 4155143)", phrase="with an abnormal result (measurement value falls outside the low and high range)"), *_PROVIDER, *_VISIT),
        counts=_counts("measurement_concept_id", "measurement_source_concept_id", "value_as_number", "range_high", "range_low", "unit_concept_id", "visit_occurrence_id"), any_name="any measurement"),
    Domain("DeviceExposure", "device_exposure", "device_exposure_id", "device_exposure_start_date", f"coalesce(device_exposure_end_date, {_next_day('device_exposure_start_date')})", "device exposure",
        "device_concept_id", ("device_source_concept", "device_source_concept_id"),
        attributes=(*_BASE, Attribute("device_source_concept", "codeset"), *_OCCURRENCE, *_AGE, *_GENDER, *_listed("device_type", "device_type_concept_id", "a device type that", exclude="device_type_exclude"),
            Attribute("unique_device_id", "text", "unique_device_id", phrase="unique device id"), _number("quantity", "quantity", "quantity {}"), *_PROVIDER, *_VISIT),
        counts=_counts("device_concept_id", "device_source_concept_id", "quantity", "visit_occurrence_id"), any_name="any device"),
    Domain("Specimen", "specimen", "specimen_id", "specimen_date", "specimen_date", "specimen",
        "specimen_concept_id", ("specimen_source_concept", "specimen_source_concept_id"),
        attributes=(*_BASE, Attribute("specimen_source_concept", "codeset"), *_ONLY_START, *_AGE, *_GENDER, *_listed("specimen_type", "specimen_type_concept_id", "a specimen type that", exclude="specimen_type_exclude"),
            _number("quantity", "quantity", "quantity {}", 4), *_listed("unit", "unit_concept_id", "with unit"), *_listed("anatomic_site", "anatomic_site_concept_id", "with anatomic site"),
            *_listed("disease_status", "disease_status_concept_id", "with disease status"), Attribute("source_id", "text", "specimen_source_id", phrase="with source ID")),
        counts=_counts("specimen_concept_id", "specimen_source_concept_id", "quantity", "unit_concept_id", "visit_occurrence_id"), any_name="any specimen"),
    Domain("Death", "death", "person_id", "death_date", _next_day("death_date"), "death", "cause_concept_id", ("death_source_concept", "cause_source_concept_id"), visit=None, first=False,
        attributes=(Attribute("codeset_id", "codeset"), Attribute("death_source_concept", "codeset"), *_ONLY_START, *_AGE, *_GENDER, *_listed("death_type", "death_type_concept_id", "a death type that", exclude="death_type_exclude"),
            Attribute("cause_source_concept", "codeset", "cause_source_concept_id"), Attribute("cause_source_concept_cs", "selection", "cause_source_concept_id", phrase="a source cause that is")),
        counts=_counts("cause_concept_id", "cause_source_concept_id"), any_name="any form"),
    Domain("ObservationPeriod", "observation_period", "observation_period_id", "observation_period_start_date", "observation_period_end_date", "observation period", visit=None,
        attributes=(Attribute("first", "flag"), _date("period_start_date", "start_date", "starting"), _date("period_end_date", "end_date", "ending"), Attribute("user_defined_period", "period"),
            *_AGES, *_listed("period_type", "period_type_concept_id", "a period type that is"), Attribute("period_length", "length", "datediff(end_date, start_date)", phrase="with a length {} days")),
        counts=_counts("period_type_concept_id", None)),
    Domain("PayerPlanPeriod", "payer_plan_period", "payer_plan_period_id", "payer_plan_period_start_date", "payer_plan_period_end_date", "payer plan period", visit=None,
        attributes=(Attribute("first", "flag"), _date("period_start_date", "start_date", "starting"), _date("period_end_date", "end_date", "ending"), Attribute("user_defined_period", "period"), *_AGES, *_GENDER,
            Attribute("period_length", "length", "datediff(end_date, start_date)", phrase="with a length {} days"),
            *(Attribute(f"{n}_{k}", "codeset", f"{n}_{k}_id", phrase=f"{n.replace('_', ' ')} {k.replace('_', ' ')}") for n in ("payer", "plan", "sponsor", "stop_reason") for k in ("concept", "source_concept"))),
        counts=_counts("payer_concept_id", "payer_source_concept_id")),
    Domain("LocationRegion", "location_region", "location_history_id", "start_date", "coalesce(end_date, make_date(2099, 12, 31))", "location", "region_concept_id", visit=None, first=False,
        attributes=(Attribute("codeset_id", "codeset"), _date("start_date", "start_date", "starting"), _date("end_date", "end_date", "ending")), counts=_counts("region_concept_id", None), any_name="any location"),
    Domain("ConditionEra", "condition_era", "condition_era_id", "condition_era_start_date", "condition_era_end_date", "condition era", "condition_concept_id", visit=None,
        attributes=(*_BASE, *_ERA, *_AGES, *_GENDER, *_ERA_LENGTH, _number("occurrence_count", "condition_occurrence_count", "containing {} occurrences")),
        counts=(*_counts("condition_concept_id", None), ("occurrence_count", "condition_occurrence_count")), any_name="any condition"),
    Domain("DrugEra", "drug_era", "drug_era_id", "drug_era_start_date", "drug_era_end_date", "drug era", "drug_concept_id", visit=None,
        attributes=(*_BASE, *_ERA, *_AGES, *_GENDER, *_ERA_LENGTH, _number("occurrence_count", "drug_exposure_count", "with occurrence count {}"), _number("gap_days", "gap_days", "with gap days {}")),
        counts=(*_counts("drug_concept_id", None), ("occurrence_count", "drug_exposure_count"), ("gap_days", "gap_days")), any_name="any drug"),
    Domain("DoseEra", "dose_era", "dose_era_id", "dose_era_start_date", "dose_era_end_date", "dose era", "drug_concept_id", visit=None,
        attributes=(*_BASE, *_ERA, *_AGES, *_GENDER, *_listed("unit", "unit_concept_id", "unit is"), *_ERA_LENGTH, _number("dose_value", "dose_value", "with dose value {}", 4)),
        counts=(*_counts("drug_concept_id", None), ("unit_concept_id", "unit_concept_id")), any_name="any drug"),
)

DOMAINS: dict[str, Domain] = {d.kind: d for d in _ALL}
_BY_FLAT = {d.kind.lower(): d for d in _ALL}


def find_domain(name: str) -> Domain | None:
    return _BY_FLAT.get(name.replace("_", "").lower())
