"""The JSON schema of cohort expressions, from the domain declarations."""

from __future__ import annotations

from .domains import DOMAINS
from .model import pascal

_REF = {"date": "Range", "number": "Range", "age": "Range", "length": "Range", "concepts": "Concepts", "selection": "Selection", "text": "TextFilter", "period": "Period"}


def _object(required: tuple[str, ...] = (), **properties) -> dict:
    out = {"type": "object", "properties": properties}
    return out | ({"required": list(required)} if required else {})


def json_schema() -> dict:
    """A draft 2020-12 schema; names in Pascal case, as expressions are written."""
    ref = lambda name: {"$ref": f"#/$defs/{name}"}
    many = lambda item: {"type": "array", "items": item}
    text, number, flag = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
    limit = _object(Type={"enum": ["All", "First", "Last"]})
    defs = {
        "Range": _object(Op={"enum": ["lt", "lte", "eq", "!eq", "gt", "gte", "bt", "!bt"]}, Value={"type": ["string", "number"]}, Extent={"type": ["string", "number"]}),
        "TextFilter": _object(Text=text, Op=text), "Selection": _object(CodesetId=number, IsExclusion=flag), "Period": _object(StartDate=text, EndDate=text),
        "Concept": _object(CONCEPT_ID=number, **{n: text for n in ("CONCEPT_NAME", "CONCEPT_CODE", "CONCEPT_CLASS_ID", "STANDARD_CONCEPT", "DOMAIN_ID", "VOCABULARY_ID", "INVALID_REASON")}),
        "Concepts": many(ref("Concept")), "DateAdjustment": _object(StartOffset=number, EndOffset=number, StartWith=text, EndWith=text),
        "Bound": _object(Days={"type": ["integer", "string", "null"]}, Coeff={"enum": [-1, 1]}), "Window": _object(Start=ref("Bound"), End=ref("Bound"), UseEventEnd={"type": ["boolean", "null"]}, UseIndexEnd={"type": ["boolean", "null"]}),
        "Occurrence": _object(Type={"enum": [0, 1, 2]}, Count=number, IsDistinct=flag, CountColumn=text),
        "Correlated": _object(("Criteria",), Criteria=ref("Criterion"), StartWindow=ref("Window"), EndWindow=ref("Window"), Occurrence=ref("Occurrence"), RestrictVisit=flag, IgnoreObservationPeriod=flag),
        "Demographic": _object(Age=ref("Range"), OccurrenceStartDate=ref("Range"), OccurrenceEndDate=ref("Range"), **{n: ref("Concepts") for n in ("Gender", "Race", "Ethnicity")}, **{f"{n}CS": ref("Selection") for n in ("Gender", "Race", "Ethnicity")}),
        "Group": _object(Type={"enum": ["ALL", "ANY", "AT_LEAST", "AT_MOST"]}, Count=number, CriteriaList=many(ref("Correlated")), DemographicCriteriaList=many(ref("Demographic")), Groups=many(ref("Group"))),
        "Criterion": {"oneOf": [_object((kind,), **{kind: ref(kind)}) for kind in DOMAINS]},
        "ConceptSet": _object(("id",), id=number, name=text, expression=_object(items=many(_object(("concept",), concept=ref("Concept"), isExcluded=flag, includeDescendants=flag, includeMapped=flag)))),
    }
    for kind, d in DOMAINS.items():
        given = {pascal(a.name): ref(_REF[a.kind]) if a.kind in _REF else flag if a.kind == "flag" else number for a in d.attributes}
        defs[kind] = _object(**given, DateAdjustment=ref("DateAdjustment"), CorrelatedCriteria=ref("Group"))
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema", "title": "CohortExpression", "$defs": defs,
        **_object(
            Title=text, ConceptSets=many(ref("ConceptSet")), PrimaryCriteria=_object(CriteriaList=many(ref("Criterion")), ObservationWindow=_object(PriorDays=number, PostDays=number), PrimaryCriteriaLimit=limit),
            AdditionalCriteria=ref("Group"), QualifiedLimit=limit, ExpressionLimit=limit, InclusionRules=many(_object(name=text, description=text, expression=ref("Group"))),
            EndStrategy={"oneOf": [_object(("DateOffset",), DateOffset=_object(DateField=text, Offset=number)), _object(("CustomEra",), CustomEra=_object(DrugCodesetId=number, GapDays=number, Offset=number, DaysSupplyOverride=number))]},
            CensoringCriteria=many(ref("Criterion")), CollapseSettings=_object(CollapseType=text, EraPad=number), CensorWindow=ref("Period"), cdmVersionRange=text)}
