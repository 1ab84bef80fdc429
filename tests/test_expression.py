"""Reading, writing, checks, Markdown, code, modifiers, builder and command line."""

import dataclasses
import json

import pytest

from cohortarium import builder, checks, codegen, model, modifiers, render
from cohortarium.cli import main
from cohortarium.domains import DOMAINS

RANGE = {"Value": 2, "Extent": 5, "Op": "bt"}
DATE = {"Value": "2020-01-01", "Op": "gt"}
CONCEPT = [{"CONCEPT_ID": 7, "CONCEPT_NAME": "Seven", "DOMAIN_ID": "Type", "VOCABULARY_ID": "V", "CONCEPT_CODE": "7"}]
SAMPLES = {"date": DATE, "number": RANGE, "age": RANGE, "length": RANGE, "concepts": CONCEPT, "selection": {"CodesetId": 1, "IsExclusion": True}, "text": {"Text": "x", "Op": "contains"}, "period": {"StartDate": "2020-01-01"}, "flag": True, "codeset": 1}


def everything(kind):
    return {kind: {model.pascal(a.name): SAMPLES[a.kind] for a in DOMAINS[kind].attributes}}


def expression(**more):
    return {"Title": "t", "ConceptSets": [{"id": 1, "name": "one", "expression": {"items": [{"concept": {"CONCEPT_ID": 5}, "includeDescendants": True}]}}], "PrimaryCriteria": {"CriteriaList": [{"ConditionOccurrence": {"CodesetId": 1}}], "ObservationWindow": {"PriorDays": 1, "PostDays": 0}, "PrimaryCriteriaLimit": {"Type": "All"}}, **more}


@pytest.mark.parametrize("kind", DOMAINS)
def test_round_trip_of_every_domain(kind):
    data = expression(CensoringCriteria=[everything(kind)], InclusionRules=[{"name": "r", "expression": {"Type": "AT_LEAST", "Count": 1, "CriteriaList": [{"Criteria": everything(kind), "StartWindow": {"Start": {"Days": 3, "Coeff": -1}, "End": {"Coeff": 1}}, "Occurrence": {"Type": 2, "Count": 2, "IsDistinct": True, "CountColumn": "START_DATE"}}], "DemographicCriteriaList": [{"Age": RANGE, "Gender": CONCEPT}]}}])
    c = model.from_dict(data)
    assert model.from_json(model.to_json(c)) == c
    assert len(c.censoring[0].attributes) == len(DOMAINS[kind].attributes)
    space = {}
    exec(codegen.to_python(c), space)
    assert space["cohort"] == c
    text = render.markdown(c, include_concept_sets=True)
    assert DOMAINS[kind].noun in text and "unknown" not in text.lower()
    assert isinstance(checks.check(c), list)


def test_keys_in_any_case():
    a = model.from_dict({"primaryCriteria": {"criteriaList": [{"condition_occurrence": {"codesetId": 1, "first": True}}], "primaryCriteriaLimit": {"type": "First"}}})
    b = model.from_dict({"PrimaryCriteria": {"CriteriaList": [{"ConditionOccurrence": {"CodesetId": 1, "First": True}}], "PrimaryCriteriaLimit": {"Type": "First"}, "ObservationWindow": None}})
    assert a.primary.criteria == b.primary.criteria and a.is_first_event


@pytest.mark.parametrize("data, path", [
    ({"PrimaryCriteria": {"CriteriaList": [{"Nothing": {}}]}}, r"\$\.PrimaryCriteria\.CriteriaList\[0\]\.Nothing"),
    ({"PrimaryCriteria": {"CriteriaList": {}}}, "a list"),
    ({"ConceptSets": [3]}, r"\$\.ConceptSets\[0\]"),
    ({"InclusionRules": [{"expression": {"CriteriaList": [{}]}}]}, "Criteria: missing"),
    ({"PrimaryCriteria": {"CriteriaList": [{"Death": {"CodesetId": "x"}}]}}, "a number"),
])
def test_errors_name_the_place(data, path):
    with pytest.raises(model.ExpressionError, match=path):
        model.from_dict(data)
    with pytest.raises(model.ExpressionError):
        model.from_json("{")


def test_checksum_ignores_names():
    a, b = expression(), expression(Title="other")
    b["ConceptSets"][0]["name"] = "another"
    b["ConceptSets"][0]["expression"]["items"] *= 2
    assert model.from_dict(a).checksum() == model.from_dict(b).checksum()
    b["CollapseSettings"] = {"EraPad": 3}
    assert model.from_dict(a).checksum() != model.from_dict(b).checksum()


def found(**more):
    return {f.check for f in checks.check(model.from_dict(expression(**more)))}


CORRELATED = {"Criteria": {"DrugExposure": {"CodesetId": 1}}, "StartWindow": {"Start": {"Days": 1, "Coeff": -1}, "End": {"Days": 1, "Coeff": 1}}, "Occurrence": {"Type": 2, "Count": 1}}


def rule_with(*criteria, **more):
    return [{"name": "r", "expression": {"Type": "ALL", "CriteriaList": list(criteria), **more}}]


@pytest.mark.parametrize("name, more", [
    ("UnusedConcepts", {"ConceptSets": [{"id": 9, "name": "u", "expression": {"items": []}}]}),
    ("ExitCriteria", {"EndStrategy": {"CustomEra": {"GapDays": 3}}}),
    ("ExitCriteriaDaysOffset", {"EndStrategy": {"DateOffset": {"DateField": "StartDate", "Offset": 0}}}),
    ("Range", {"CensoringCriteria": [{"Death": {"Age": {"Op": "bt", "Value": 9, "Extent": 2}}}]}),
    ("Range", {"CensorWindow": {"StartDate": "2020-02-01", "EndDate": "2020-01-01"}}),
    ("Range", {"CensoringCriteria": [{"Death": {"OccurrenceStartDate": {"Op": "lt", "Value": "soon"}}}]}),
    ("Concept", {"CensoringCriteria": [{"Death": {"Gender": []}}]}),
    ("ConceptSetSelection", {"CensoringCriteria": [{"Death": {"GenderCS": {}}}]}),
    ("Attribute", {"InclusionRules": rule_with(DemographicCriteriaList=[{}])}),
    ("Text", {"CensoringCriteria": [{"ConditionOccurrence": {"StopReason": {"Op": "eq"}}}]}),
    ("IncompleteRule", {"InclusionRules": [{"name": "r"}]}),
    ("InitialEvent", {"PrimaryCriteria": {"CriteriaList": []}}),
    ("NoExitCriteria", {}),
    ("ConceptSetCriteria", {"CensoringCriteria": [{"Death": {}}]}),
    ("DrugEra", {"InclusionRules": rule_with({"Criteria": {"DrugEra": {"CodesetId": 1}}})}),
    ("Ocurrence", {"InclusionRules": rule_with(CORRELATED | {"Occurrence": {"Type": 2, "Count": 0}})}),
    ("DuplicatesCriteria", {"InclusionRules": rule_with(CORRELATED, CORRELATED)}),
    ("DuplicatesConceptSet", {"ConceptSets": [{"id": i, "name": str(i), "expression": {"items": [{"concept": {"CONCEPT_ID": 5}}]}} for i in (1, 2)]}),
    ("DrugDomain", {"ConceptSets": [{"id": 1, "name": "d", "expression": {"items": [{"concept": {"CONCEPT_ID": 5, "DOMAIN_ID": "Drug"}}]}}]}),
    ("EmptyConceptSet", {"ConceptSets": [{"id": 1, "name": "d", "expression": {"items": []}}]}),
    ("EventsProgression", {"PrimaryCriteria": {"CriteriaList": [{"Death": {"CodesetId": 1}}], "PrimaryCriteriaLimit": {"Type": "First"}}, "ExpressionLimit": {"Type": "All"}}),
    ("TimeWindow", {"InclusionRules": rule_with(CORRELATED | {"StartWindow": {"Start": {"Days": 90, "Coeff": -1}, "End": {"Days": 0, "Coeff": 1}}})}),
    ("TimePattern", {"InclusionRules": rule_with(CORRELATED, CORRELATED, CORRELATED | {"StartWindow": {"Start": {"Days": 0, "Coeff": -1}, "End": {"Days": 0, "Coeff": 1}}})}),
    ("DomainType", {}),
    ("CriteriaContradictions", {"InclusionRules": rule_with(CORRELATED, CORRELATED | {"Occurrence": {"Type": 0, "Count": 0}})}),
    ("DeathTimeWindow", {"InclusionRules": rule_with({"Criteria": {"Death": {"CodesetId": 1}}, "StartWindow": {"Start": {"Days": 5, "Coeff": -1}, "End": {"Days": 0, "Coeff": 1}}})}),
])
def test_checks(name, more):
    assert name in found(**more)


def test_all_checks_are_covered():
    assert len(checks.CHECKS) == 24
    covered = {m.args[1][i][0] for m in test_checks.pytestmark for i in range(len(m.args[1]))}
    assert covered == {n for n, *_ in checks.CHECKS}


def test_markdown_sentences():
    text = render.markdown(model.from_dict(expression(
        InclusionRules=rule_with(CORRELATED | {"RestrictVisit": True, "IgnoreObservationPeriod": True}), EndStrategy={"DateOffset": {"DateField": "EndDate", "Offset": 1}}, CensorWindow={"StartDate": "2020-01-01"})))
    assert "People with continuous observation of 1 days before event may enter the cohort when observing any of the following:" in text
    assert "1. condition occurrences of 'one'." in text
    assert "Entry events having at least 1 drug exposure of 'one', starting between 1 days before and 1 days after cohort entry start date; at same visit as cohort entry and allow events outside observation period." in text
    assert "The cohort end date will be offset from index event's end date plus 1 day." in text
    assert "Left censor cohort start dates to 2020-01-01." in text


def test_modifiers():
    c = model.from_dict(expression())
    m = modifiers
    assert m.set_prior_observation(c, 30).primary.prior_days == 30
    assert m.set_post_observation(c, 5).primary.post_days == 5
    assert not m.reset_observation_window(c).primary.has_window
    assert m.set_limit_to_first_event(c).primary.limit == "First" and m.set_allow_all_events(c).expression_limit == "All"
    assert m.set_cohort_era(c, 9).collapse.era_pad == 9 and m.reset_collapse_settings(m.set_cohort_era(c, 9)).collapse.era_pad == 0
    limited = m.set_allow_all_events(dataclasses.replace(c, qualified_limit="Last"))
    assert (limited.qualified_limit, limited.primary.limit) == ("Last", "All")
    asked = len(c.additional.demographics) if c.additional else 0
    aged = m.set_gender_criteria(m.set_age_criteria(m.set_age_criteria(c, 18), 18, 65), "female")
    assert len(aged.additional.demographics) == asked + 3 and aged.rules == c.rules
    assert len(m.set_age_criteria(aged, high=9, replacing=True).additional.demographics) == asked + 2
    assert [d.gender[0].concept_name for d in m.set_gender_criteria(aged, 8507, replacing=True).additional.demographics if d.gender] == ["MALE"]
    assert not any(d.age or d.gender for d in m.reset_gender_criteria(m.reset_age_criteria(aged)).additional.demographics)
    assert m.set_age_criteria(model.Cohort(), 3).additional == model.Group("ALL", demographics=(model.Demographic(age=model.Range("gte", 3)),))
    assert m.set_end_date_strategy(c, "custom_era", codeset_id=3, gap_days=30, offset=1).end_strategy == model.CustomEra(3, 30, 1) and m.reset_end_strategy(c).end_strategy is None
    assert m.set_end_date_strategy(c, "Fixed-duration", 7, "EndDate").end_strategy == model.DateOffset("EndDate", 7) and m.set_end_date_strategy(c, "end_of_observation").end_strategy is None
    assert m.set_clean_window(c, 10).has_exclusion_rules and m.set_clean_window(c, 10, "all").rules[0].expression.type == "ANY"
    assert not m.reset_clean_window(m.set_clean_window(c, 10)).rules
    washed = m.set_washout_period(m.set_allow_all_events(c), 100)
    assert washed == m.set_prior_observation(m.set_allow_all_events(c), 100) and not washed.is_first_event
    assert m.set_date_range(c, "2020-01-01").censor_window.start_date == "2020-01-01" and m.reset_date_range(c).censor_window is None
    assert m.clear_censor_events(m.set_censor_event(c, model.Criterion("Death"))).censoring == ()
    assert m.apply_standard_rules(c).primary.prior_days == 365
    all_of = m.apply_standard_rules(model.Cohort(primary=c.primary), 10, 5, False, 3, 18, 65, 8532, "fixed_duration", 30)
    assert (all_of.primary.post_days, all_of.primary.limit, all_of.collapse.era_pad, len(all_of.additional.demographics), all_of.end_strategy.offset) == (5, "All", 3, 2, 30)
    for bad in (lambda: m.set_age_criteria(c), lambda: m.set_age_criteria(c, 9, 3), lambda: m.set_prior_observation(c, -1), lambda: m.set_gender_criteria(c), lambda: m.set_end_date_strategy(c, "x"), lambda: m.set_date_range(c, "2021", "2020"), lambda: m.set_date_range(c), lambda: m.set_clean_window(c, 0), lambda: m.set_clean_window(model.Cohort(), 5), lambda: m.set_end_date_strategy(c, "fixed_duration")):
        with pytest.raises(ValueError):
            bad()


def test_introspection():
    c = dataclasses.replace(model.from_dict(expression()), censoring=(model.Criterion("Death"), model.Criterion("VisitOccurrence")))
    assert c.primary_criteria_types == ["ConditionOccurrence"] and c.concept_set_ids == [x.id for x in c.concept_sets] and c.is_complete
    assert c.censoring_criteria_types == ["Death", "VisitOccurrence"] and c.remove_censoring("Death").censoring_criteria_types == ["VisitOccurrence"]
    assert modifiers.set_end_date_strategy(c, "custom_era").end_strategy_type == "CustomEra" and model.Cohort().end_strategy_type is None
    assert not model.Cohort().is_complete and not model.Cohort().has_observation_window and not model.Cohort().has_additional_criteria
    assert c._repr_markdown_() == render.markdown(c)


def test_builder():
    b = builder.CohortBuilder("t").with_concept_sets(builder.concept_set(1, "one", 5)).enter_on(builder.event("ConditionOccurrence", 1))
    c = b.require(builder.event("DrugExposure", 1).within_days_before(30).at_least(2)).exclude(builder.event("Death").anytime_before()).require_age(18).first_event_only().with_observation(365).collapse_within(3).exit_at("start_date", offset=7).between("2020-01-01").build()
    assert [r.name for r in c.rules] == ["requires drug exposure", "excludes death"] and c.additional.demographics[0].age.value == 18
    assert c.primary.prior_days == 365 and c.end_strategy == model.DateOffset("StartDate", 7) and c.exclusion_count() == 1
    with pytest.raises(ValueError):
        builder.CohortBuilder().build()


def test_command_line(tmp_path, capsys):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(expression()))
    assert main(["validate", str(path)]) == 2
    assert main(["render-markdown", str(path), "--concept-sets"]) == 0 and "### Cohort Exit" in capsys.readouterr().out
    assert main(["generate-source", str(path), "-o", str(tmp_path / "c.py")]) == 0 and "Cohort(" in (tmp_path / "c.py").read_text()
    assert main(["process", str(path)]) == 0
    path.write_text(json.dumps(expression(PrimaryCriteria={"CriteriaList": []})))
    assert main(["validate", str(path)]) == 1
    assert main(["validate", str(tmp_path / "absent.json")]) == 1


def test_command_line_runs(spark, tmp_path):
    from cohortarium.plans.queries import FLAGSHIP
    from cohortarium.sources.commerce import PROJECTIONS, commerce_cdm

    cdm = commerce_cdm(spark, "/root/testdata/sf0.001")
    for name in PROJECTIONS:
        if name in ("condition_occurrence", "observation_period", "concept"):
            cdm.table(name).write.parquet(str(tmp_path / f"cdm/{name}.parquet"))
    (tmp_path / "c.json").write_text(model.to_json(FLAGSHIP))
    assert main(["run", str(tmp_path / "c.json"), "--cdm", str(tmp_path / "cdm"), "--results", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out/cohort")).count() == 72


def test_json_schema_names_what_is_written():
    """Every key that an expression is written with is in the schema."""
    from cohortarium.schema import json_schema

    schema = json_schema()

    def walk(data, at):
        while "$ref" in at:
            at = schema["$defs"][at["$ref"].rpartition("/")[2]]
        if "oneOf" in at:
            at = next(o for o in at["oneOf"] if set(o["required"]) <= set(data))
        if isinstance(data, dict):
            assert set(data) <= set(at["properties"]), set(data) - set(at["properties"])
            for k, v in data.items():
                walk(v, at["properties"][k])
        elif isinstance(data, list):
            for v in data:
                walk(v, at["items"])

    for kind in DOMAINS:
        walk(model.to_dict(model.from_dict(expression(CensoringCriteria=[everything(kind)], EndStrategy={"CustomEra": {"DrugCodesetId": 1}}, InclusionRules=rule_with(CORRELATED, DemographicCriteriaList=[{"Age": RANGE}])))), schema)


def test_run_options(spark):
    from cohortarium.options import RunOptions, run
    from cohortarium.plans.queries import FLAGSHIP
    from cohortarium.sources.commerce import commerce_cdm

    options = RunOptions.from_json('{"cohortId": 3, "cdmSchema": "opt_cdm", "targetTable": "opt_cdm.cohort", "resultSchema": "opt_cdm", "generateStats": true, "cohortIdFieldName": "cohort_id", "unknown": 1}')
    spark.sql("create database if not exists opt_cdm")
    cdm = commerce_cdm(spark, "/root/testdata/sf0.001")
    for name in ("condition_occurrence", "observation_period", "concept"):
        cdm.table(name).write.mode("overwrite").saveAsTable(f"opt_cdm.{name}")
    cohort = FLAGSHIP.add_rule(model.Rule("all", None, model.Group()))
    for _ in range(2):
        run(spark, cohort, options)
    run(spark, cohort, RunOptions(**{**options.__dict__, "cohort_id": 4}))
    counts = {r["cohort_id"]: r["count"] for r in spark.table("opt_cdm.cohort").groupBy("cohort_id").count().collect()}
    assert counts == {3: 72, 4: 72} and spark.table("opt_cdm.cohort_summary_stats").count() == 4
    spark.sql("drop database opt_cdm cascade")
