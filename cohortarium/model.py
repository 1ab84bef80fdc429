"""The cohort expression as immutable values, with tolerant reading and canonical writing of its JSON."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, fields, replace
from typing import Any

from .domains import DOMAINS, find_domain


class ExpressionError(ValueError):
    """An expression that can't be read; the message begins with the JSON path."""


@dataclass(frozen=True)
class Range:
    """A comparison with one or two values: lt, lte, eq, gt, gte, bt, and with ! before eq and bt."""

    op: str | None = None
    value: Any = None
    extent: Any = None


@dataclass(frozen=True)
class TextFilter:
    text: str | None = None
    op: str | None = None


@dataclass(frozen=True)
class Concept:
    concept_id: int | None = None
    concept_name: str | None = None
    concept_code: str | None = None
    concept_class_id: str | None = None
    standard_concept: str | None = None
    standard_concept_caption: str | None = None
    invalid_reason: str | None = None
    invalid_reason_caption: str | None = None
    domain_id: str | None = None
    vocabulary_id: str | None = None


@dataclass(frozen=True)
class Selection:
    """A concept set, or all concepts outside it."""

    codeset_id: int | None = None
    is_exclusion: bool = False


@dataclass(frozen=True)
class Period:
    start_date: str | None = None
    end_date: str | None = None


@dataclass(frozen=True)
class DateAdjustment:
    start_offset: int = 0
    end_offset: int = 0
    start_with: str = "START_DATE"
    end_with: str = "END_DATE"


@dataclass(frozen=True)
class Bound:
    coeff: int = -1
    days: int | None = None


@dataclass(frozen=True)
class Window:
    start: Bound | None = None
    end: Bound | None = None
    use_event_end: bool | None = None
    use_index_end: bool | None = None


@dataclass(frozen=True)
class Occurrence:
    """type: 0 exactly, 1 at most, 2 at least."""

    type: int = 2
    count: int = 1
    is_distinct: bool = False
    count_column: str | None = None


@dataclass(frozen=True)
class Criterion:
    """Events of one domain; attributes by name, as the domain's specification lists them."""

    kind: str
    attributes: tuple[tuple[str, Any], ...] = ()
    date_adjustment: DateAdjustment | None = None
    correlated: Group | None = None

    def get(self, name: str, default: Any = None) -> Any:
        return dict(self.attributes).get(name, default)

    def with_(self, **attributes: Any) -> Criterion:
        merged = dict(self.attributes) | attributes
        return replace(self, attributes=tuple(sorted((k, v) for k, v in merged.items() if v is not None)))

    @property
    def domain(self):
        return DOMAINS[self.kind]


@dataclass(frozen=True)
class Correlated:
    criterion: Criterion
    start_window: Window | None = None
    end_window: Window | None = None
    occurrence: Occurrence | None = None
    restrict_visit: bool = False
    ignore_observation_period: bool = False


@dataclass(frozen=True)
class Demographic:
    age: Range | None = None
    gender: tuple[Concept, ...] | None = None
    gender_cs: Selection | None = None
    race: tuple[Concept, ...] | None = None
    race_cs: Selection | None = None
    ethnicity: tuple[Concept, ...] | None = None
    ethnicity_cs: Selection | None = None
    occurrence_start_date: Range | None = None
    occurrence_end_date: Range | None = None


@dataclass(frozen=True)
class Group:
    type: str = "ALL"
    count: int | None = None
    criteria: tuple[Correlated, ...] = ()
    demographics: tuple[Demographic, ...] = ()
    groups: tuple[Group, ...] = ()

    @property
    def empty(self) -> bool:
        return not (self.criteria or self.demographics or self.groups)


@dataclass(frozen=True)
class Rule:
    name: str | None = None
    description: str | None = None
    expression: Group | None = None


@dataclass(frozen=True)
class Primary:
    """limit None means First."""

    criteria: tuple[Criterion, ...] = ()
    prior_days: int = 0
    post_days: int = 0
    has_window: bool = True
    limit: str | None = "All"


@dataclass(frozen=True)
class DateOffset:
    date_field: str = "StartDate"
    offset: int = 0


@dataclass(frozen=True)
class CustomEra:
    drug_codeset_id: int | None = None
    gap_days: int = 0
    offset: int = 0
    days_supply_override: int | None = None


@dataclass(frozen=True)
class Collapse:
    collapse_type: str = "ERA"
    era_pad: int = 0


@dataclass(frozen=True)
class ConceptItem:
    concept: Concept = field(default_factory=Concept)
    is_excluded: bool = False
    include_descendants: bool = False
    include_mapped: bool = False


@dataclass(frozen=True)
class ConceptSet:
    id: int = 0
    name: str | None = None
    items: tuple[ConceptItem, ...] = ()


@dataclass(frozen=True)
class Cohort:
    title: str | None = None
    concept_sets: tuple[ConceptSet, ...] = ()
    primary: Primary | None = None
    additional: Group | None = None
    qualified_limit: str | None = None
    expression_limit: str | None = None
    rules: tuple[Rule, ...] = ()
    end_strategy: DateOffset | CustomEra | None = None
    censoring: tuple[Criterion, ...] = ()
    collapse: Collapse = field(default_factory=Collapse)
    censor_window: Period | None = None
    cdm_version: str | None = None

    # introspection
    @property
    def is_first_event(self) -> bool:
        return self.primary is not None and (self.primary.limit or "First") == "First"

    @property
    def has_inclusion_rules(self) -> bool:
        return bool(self.rules)

    @property
    def has_censoring_criteria(self) -> bool:
        return bool(self.censoring)

    @property
    def has_end_strategy(self) -> bool:
        return self.end_strategy is not None

    @property
    def has_additional_criteria(self) -> bool:
        return self.additional is not None and not self.additional.empty

    @property
    def has_observation_window(self) -> bool:
        return self.primary is not None and self.primary.has_window

    @property
    def primary_criteria_types(self) -> list[str]:
        return [c.kind for c in self.primary.criteria] if self.primary else []

    @property
    def censoring_criteria_types(self) -> list[str]:
        return [c.kind for c in self.censoring]

    @property
    def end_strategy_type(self) -> str | None:
        return type(self.end_strategy).__name__ if self.end_strategy is not None else None

    @property
    def concept_set_ids(self) -> list[int]:
        return [c.id for c in self.concept_sets if c.id is not None]

    @property
    def is_complete(self) -> bool:
        """Whether there are entry criteria and every concept set has a number."""
        return self.primary is not None and all(c.id for c in self.concept_sets)

    def _repr_markdown_(self) -> str:
        """What notebooks show."""
        from .render import markdown

        return markdown(self)

    def rule_by_name(self, name: str) -> Rule | None:
        return next((r for r in self.rules if r.name == name), None)

    def concept_set(self, id: int) -> ConceptSet | None:
        return next((c for c in self.concept_sets if c.id == id), None)

    def exclusion_count(self) -> int:
        """Correlated criteria in rules that ask for none."""
        return sum(c.occurrence is not None and c.occurrence.count == 0 and c.occurrence.type in (0, 1) for r in self.rules if r.expression for c in correlated_in(r.expression))

    @property
    def has_exclusion_rules(self) -> bool:
        return self.exclusion_count() > 0

    # changes
    def add_concept_set(self, item: ConceptSet) -> Cohort:
        return replace(self, concept_sets=(*(c for c in self.concept_sets if c.id != item.id), item))

    def remove_concept_set(self, id: int) -> Cohort:
        return replace(self, concept_sets=tuple(c for c in self.concept_sets if c.id != id))

    def add_rule(self, rule: Rule) -> Cohort:
        return replace(self, rules=(*self.rules, rule))

    def remove_rule(self, name: str) -> Cohort:
        return replace(self, rules=tuple(r for r in self.rules if r.name != name))

    def add_censoring(self, criterion: Criterion) -> Cohort:
        return replace(self, censoring=(*self.censoring, criterion))

    def remove_censoring(self, kind: str) -> Cohort:
        """Without the censoring criteria of a domain."""
        return replace(self, censoring=tuple(c for c in self.censoring if c.kind != kind))

    def clear_censoring(self) -> Cohort:
        return replace(self, censoring=())

    def checksum(self, algorithm: str = "sha256") -> str:
        """A digest of what the expression says: names and titles don't count, nor the order or repetition of concepts."""
        data = to_dict(replace(self, title=None))
        for cs in data.get("ConceptSets", []):
            cs.pop("name", None)
            items = {json.dumps({k: (v if k != "concept" else v.get("CONCEPT_ID")) for k, v in i.items()}, sort_keys=True) for i in cs["expression"]["items"]}
            cs["expression"] = sorted(items)
        for rule in data.get("InclusionRules", []):
            rule.pop("name", None)
            rule.pop("description", None)
        return hashlib.new(algorithm, json.dumps(data, sort_keys=True, default=str).encode()).hexdigest()


def correlated_in(group: Group):
    """Every correlated criterion of a group and of the groups inside it."""
    yield from group.criteria
    for g in group.groups:
        yield from correlated_in(g)


def criteria_of(cohort: Cohort, nested: bool = True):
    """(place, criterion) of every criterion, in order."""

    def of_group(place: str, group: Group | None):
        if group:
            for c in group.criteria:
                yield place, c.criterion
                if nested:
                    yield from of_group(place, c.criterion.correlated)
            for g in group.groups:
                yield from of_group(place, g)

    if cohort.primary:
        for c in cohort.primary.criteria:
            yield "primary criteria", c
            if nested:
                yield from of_group("primary criteria", c.correlated)
    yield from of_group("additional criteria", cohort.additional)
    for r in cohort.rules:
        yield from of_group(f"inclusion rule {r.name or ''}".strip(), r.expression)
    for c in cohort.censoring:
        yield "censoring events", c
        if nested:
            yield from of_group("censoring events", c.correlated)


# reading

_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def _flat(key: str) -> str:
    return re.sub(r"[^a-z0-9]", "", key.lower())


class _Reader:
    """Access to a JSON object by names that may be written in Pascal, camel or snake case."""

    def __init__(self, data: Any, path: str):
        if not isinstance(data, dict):
            raise ExpressionError(f"{path}: an object is expected, not {type(data).__name__}")
        self.path, self.data = path, {_flat(k): v for k, v in data.items()}

    def get(self, *names: str, default: Any = None) -> Any:
        for n in names:
            if (v := self.data.get(_flat(n))) is not None:
                return v
        return default

    def list(self, *names: str) -> list:
        v = self.get(*names, default=[])
        if not isinstance(v, list):
            raise ExpressionError(f"{self.path}.{names[0]}: a list is expected")
        return v

    def int(self, *names: str, default: int | None = None) -> int | None:
        v = self.get(*names, default=default)
        try:
            return None if v is None else int(v)
        except (TypeError, ValueError):
            raise ExpressionError(f"{self.path}.{names[0]}: a number is expected, not {v!r}") from None

    def bool(self, *names: str, default: bool | None = False) -> bool | None:
        v = self.get(*names)
        return default if v is None else bool(v)

    def at(self, name: str, i: int | None = None) -> str:
        return f"{self.path}.{name}" + ("" if i is None else f"[{i}]")


def _range(data: Any, path: str) -> Range:
    r = _Reader(data, path)
    return Range(r.get("Op"), r.get("Value"), r.get("Extent"))


def _concept(data: Any, path: str) -> Concept:
    r = _Reader(data, path)
    return Concept(r.int("CONCEPT_ID"), *(r.get(n) for n in ("CONCEPT_NAME", "CONCEPT_CODE", "CONCEPT_CLASS_ID", "STANDARD_CONCEPT", "STANDARD_CONCEPT_CAPTION", "INVALID_REASON", "INVALID_REASON_CAPTION", "DOMAIN_ID", "VOCABULARY_ID")))


def _concepts(data: Any, path: str) -> tuple[Concept, ...]:
    if not isinstance(data, list):
        raise ExpressionError(f"{path}: a list of concepts is expected")
    return tuple(_concept(c, f"{path}[{i}]") for i, c in enumerate(data))


def _selection(data: Any, path: str) -> Selection:
    r = _Reader(data, path)
    return Selection(r.int("CodesetId"), r.bool("IsExclusion"))


def _text(data: Any, path: str) -> TextFilter:
    r = _Reader(data, path)
    return TextFilter(r.get("Text"), r.get("Op"))


def _period(data: Any, path: str) -> Period:
    r = _Reader(data, path)
    return Period(r.get("StartDate"), r.get("EndDate"))


_READ = {"date": _range, "number": _range, "age": _range, "length": _range, "concepts": _concepts, "selection": _selection, "text": _text, "period": _period}


def _attribute(kind: str, data: Any, path: str) -> Any:
    if kind in _READ:
        return _READ[kind](data, path)
    if kind == "flag":
        return bool(data)
    try:
        return int(data)
    except (TypeError, ValueError):
        raise ExpressionError(f"{path}: a number is expected, not {data!r}") from None


def _criterion(data: Any, path: str) -> Criterion:
    if not isinstance(data, dict) or len(data) != 1:
        raise ExpressionError(f"{path}: an object with one key, the criterion's type, is expected")
    ((name, body),) = data.items()
    domain = find_domain(name)
    if domain is None:
        raise ExpressionError(f"{path}.{name}: unknown criterion type")
    r = _Reader(body, f"{path}.{name}")
    attributes = {}
    for a in domain.attributes:
        if (v := r.get(a.name)) is not None:
            attributes[a.name] = _attribute(a.kind, v, r.at(a.name))
    adjust = r.get("DateAdjustment")
    group = r.get("CorrelatedCriteria")
    return Criterion(domain.kind, tuple(sorted(attributes.items())), _adjustment(adjust, r.at("DateAdjustment")) if adjust else None, _group(group, r.at("CorrelatedCriteria")) if group else None)


def _adjustment(data: Any, path: str) -> DateAdjustment:
    r = _Reader(data, path)
    return DateAdjustment(r.int("StartOffset", default=0), r.int("EndOffset", default=0), str(r.get("StartWith", default="START_DATE")).upper(), str(r.get("EndWith", default="END_DATE")).upper())


def _window(data: Any, path: str, strict: bool) -> Window:
    r = _Reader(data, path)

    def bound(name: str) -> Bound | None:
        if (v := r.get(name)) is None:
            return None
        b = _Reader(v, r.at(name))
        days = b.get("Days")
        return Bound(b.int("Coeff", default=0), None if days is None or str(days).lower() == "all" else int(days))

    return Window(bound("Start"), bound("End"), r.bool("UseEventEnd", default=False if strict else None), r.bool("UseIndexEnd", default=None))


def _occurrence(data: Any, path: str) -> Occurrence:
    r = _Reader(data, path)
    column = r.get("CountColumn")
    return Occurrence(r.int("Type", default=2), r.int("Count", default=1), r.bool("IsDistinct"), column and "_".join(x.lower() for x in _SPLIT.findall(str(column))))


def _correlated(data: Any, path: str, strict: bool = False) -> Correlated:
    r = _Reader(data, path)
    inner = r.get("Criteria")
    if inner is None:
        raise ExpressionError(f"{path}.Criteria: missing")
    start, end, occurrence = r.get("StartWindow"), r.get("EndWindow"), r.get("Occurrence")
    return Correlated(
        _criterion(inner, r.at("Criteria")), _window(start, r.at("StartWindow"), strict) if start else None, _window(end, r.at("EndWindow"), strict) if end else None,
        _occurrence(occurrence, r.at("Occurrence")) if occurrence else None, r.bool("RestrictVisit"), r.bool("IgnoreObservationPeriod"))


def _demographic(data: Any, path: str) -> Demographic:
    r = _Reader(data, path)
    kinds = {"age": _range, "gender": _concepts, "gender_cs": _selection, "race": _concepts, "race_cs": _selection, "ethnicity": _concepts, "ethnicity_cs": _selection, "occurrence_start_date": _range, "occurrence_end_date": _range}
    return Demographic(**{n: f(v, r.at(n)) for n, f in kinds.items() if (v := r.get(n)) is not None})


def _group(data: Any, path: str) -> Group:
    r = _Reader(data, path)
    each = lambda name, f: tuple(f(v, r.at(name, i)) for i, v in enumerate(r.list(name)))
    return Group(str(r.get("Type", default="ALL")).upper(), r.int("Count"), each("CriteriaList", _correlated), each("DemographicCriteriaList", _demographic), each("Groups", _group))


def _limit(data: Any, path: str) -> str | None:
    return None if data is None else str(data if isinstance(data, str) else _Reader(data, path).get("Type", default="All")).capitalize()


def _concept_set(data: Any, path: str) -> ConceptSet:
    r = _Reader(data, path)
    items = []
    if expression := r.get("expression"):
        e = _Reader(expression, r.at("expression"))
        for i, item in enumerate(e.list("items")):
            x = _Reader(item, e.at("items", i))
            items.append(ConceptItem(_concept(x.get("concept", default={}), x.at("concept")), x.bool("isExcluded"), x.bool("includeDescendants"), x.bool("includeMapped")))
    return ConceptSet(r.int("id", default=0), r.get("name"), tuple(items))


def from_dict(data: dict) -> Cohort:
    r = _Reader(data, "$")
    each = lambda name, f: tuple(f(v, r.at(name, i)) for i, v in enumerate(r.list(name)))
    primary = None
    if (p := r.get("PrimaryCriteria")) is not None:
        x = _Reader(p, r.at("PrimaryCriteria"))
        window = x.get("ObservationWindow")
        w = _Reader(window or {}, x.at("ObservationWindow"))
        primary = Primary(tuple(_criterion(c, x.at("CriteriaList", i)) for i, c in enumerate(x.list("CriteriaList"))), w.int("PriorDays", default=0), w.int("PostDays", default=0), window is not None, _limit(x.get("PrimaryCriteriaLimit", "PrimaryLimit"), x.at("PrimaryCriteriaLimit")))
    additional = r.get("AdditionalCriteria")
    end = None
    if (e := r.get("EndStrategy")) is not None:
        x = _Reader(e, r.at("EndStrategy"))
        if (d := x.get("DateOffset")) is not None:
            y = _Reader(d, x.at("DateOffset"))
            end = DateOffset(y.get("DateField", default="StartDate"), y.int("Offset", default=0))
        elif (c := x.get("CustomEra")) is not None:
            y = _Reader(c, x.at("CustomEra"))
            end = CustomEra(y.int("DrugCodesetId"), y.int("GapDays", default=0), y.int("Offset", default=0), y.int("DaysSupplyOverride"))

    def rule(v: Any, path: str) -> Rule:
        x = _Reader(v, path)
        g = x.get("expression")
        return Rule(x.get("name"), x.get("description"), _group(g, x.at("expression")) if g else None)

    collapse = _Reader(r.get("CollapseSettings", default={}), r.at("CollapseSettings"))
    window = r.get("CensorWindow")
    window = _period(window, r.at("CensorWindow")) if window else None
    version = r.get("cdmVersionRange")
    return Cohort(
        r.get("Title"), each("ConceptSets", _concept_set), primary, _group(additional, r.at("AdditionalCriteria")) if additional else None,
        _limit(r.get("QualifiedLimit"), "$.QualifiedLimit"), _limit(r.get("ExpressionLimit"), "$.ExpressionLimit"), each("InclusionRules", rule), end,
        each("CensoringCriteria", _criterion), Collapse(str(collapse.get("CollapseType", default="ERA")).upper(), collapse.int("EraPad", default=0)),
        window if window and (window.start_date or window.end_date) else None, version if isinstance(version, str) else None)


def from_json(text: str) -> Cohort:
    """Reads an expression; an ExpressionError names the place that is wrong."""
    try:
        return from_dict(json.loads(text))
    except json.JSONDecodeError as e:
        raise ExpressionError(f"$: not JSON: {e}") from e


# writing


def pascal(name: str) -> str:
    return "".join("CS" if p == "cs" else p.capitalize() for p in name.split("_"))


def _drop(data: dict) -> dict:
    return {k: v for k, v in data.items() if v is not None}


def _plain(v: Any) -> Any:
    if isinstance(v, Concept):
        return _drop({f.name.upper(): getattr(v, f.name) for f in fields(v)})
    if isinstance(v, tuple):
        return [_plain(x) for x in v]
    if isinstance(v, (Range, TextFilter, Selection, Period, DateAdjustment, Bound, Window, Occurrence)):
        return _drop({pascal(f.name): _plain(getattr(v, f.name)) for f in fields(v)})
    return v


def criterion_dict(c: Criterion) -> dict:
    body = {pascal(k): _plain(v) for k, v in c.attributes}
    if c.date_adjustment:
        body["DateAdjustment"] = _plain(c.date_adjustment)
    if c.correlated:
        body["CorrelatedCriteria"] = group_dict(c.correlated)
    return {c.kind: body}


def group_dict(g: Group) -> dict:
    return _drop({
        "Type": g.type, "Count": g.count,
        "CriteriaList": [_drop({"Criteria": criterion_dict(c.criterion), "StartWindow": _plain(c.start_window), "EndWindow": _plain(c.end_window), "Occurrence": _plain(c.occurrence), "RestrictVisit": c.restrict_visit, "IgnoreObservationPeriod": c.ignore_observation_period}) for c in g.criteria],
        "DemographicCriteriaList": [_drop({pascal(f.name): _plain(getattr(d, f.name)) for f in fields(d)}) for d in g.demographics],
        "Groups": [group_dict(x) for x in g.groups]})


def to_dict(cohort: Cohort) -> dict:
    p = cohort.primary
    limit = lambda x: None if x is None else {"Type": x}
    end = cohort.end_strategy
    return _drop({
        "Title": cohort.title,
        "ConceptSets": [{"id": s.id, "name": s.name, "expression": {"items": [{"concept": _plain(i.concept), "isExcluded": i.is_excluded, "includeDescendants": i.include_descendants, "includeMapped": i.include_mapped} for i in s.items]}} for s in cohort.concept_sets],
        "PrimaryCriteria": p and _drop({"CriteriaList": [criterion_dict(c) for c in p.criteria], "ObservationWindow": {"PriorDays": p.prior_days, "PostDays": p.post_days} if p.has_window else None, "PrimaryCriteriaLimit": limit(p.limit)}),
        "AdditionalCriteria": cohort.additional and group_dict(cohort.additional),
        "QualifiedLimit": limit(cohort.qualified_limit), "ExpressionLimit": limit(cohort.expression_limit),
        "InclusionRules": [_drop({"name": r.name, "description": r.description, "expression": r.expression and group_dict(r.expression)}) for r in cohort.rules],
        "EndStrategy": None if end is None else {type(end).__name__: _drop({pascal(f.name): getattr(end, f.name) for f in fields(end)})},
        "CensoringCriteria": [criterion_dict(c) for c in cohort.censoring],
        "CollapseSettings": {"CollapseType": cohort.collapse.collapse_type, "EraPad": cohort.collapse.era_pad},
        "CensorWindow": _plain(cohort.censor_window), "cdmVersionRange": cohort.cdm_version})


def to_json(cohort: Cohort, indent: int | None = 2) -> str:
    return json.dumps(to_dict(cohort), indent=indent, ensure_ascii=False)
