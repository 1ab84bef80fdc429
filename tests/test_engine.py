"""Micro tables with exact expected rows for decisions that SQL comparison alone doesn't show."""

from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortarium.model import Bound, Cohort, Concept, ConceptItem, ConceptSet, Correlated, Criterion, CustomEra, DateAdjustment, DateOffset, Group, Occurrence, Primary, Range, Rule, Selection, TextFilter, Window
from cohortarium.operators.eras import fold
from cohortarium.operators.events import events
from cohortarium.plans.engine import CohortEngine
from cohortarium.sources.cdm import Cdm, schema

D = lambda s: date.fromisoformat(s)


def cdm(spark, **tables):
    made = {}
    for name, rows in tables.items():
        names = sorted({k for r in rows for k in r})
        fields = {f.name: f for f in schema(name)}
        made[name] = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {fields[n].dataType.simpleString()}" for n in names))
    return Cdm(spark, made)


def base(spark, **tables):
    tables.setdefault("observation_period", [{"observation_period_id": 1, "person_id": 1, "observation_period_start_date": D("2019-01-01"), "observation_period_end_date": D("2021-12-31")}])
    tables.setdefault("person", [{"person_id": 1, "year_of_birth": 1980, "gender_concept_id": 8507}])
    tables.setdefault("concept", [{"concept_id": i} for i in range(10, 20)])
    return cdm(spark, **tables)


def criterion(kind, adjust=None, **a):
    return Criterion(kind, tuple(sorted(a.items())), adjust)


SET = ConceptSet(1, "ten", (ConceptItem(Concept(10)),))

ADJUSTED = [
    ("DrugEra", "drug_era", "drug_era_start_date", "drug_era_end_date", "drug_concept_id", "2020-01-10", "2020-01-20", 5, -5, "2020-01-15", "2020-01-15"),
    ("ConditionOccurrence", "condition_occurrence", "condition_start_date", "condition_end_date", "condition_concept_id", "2020-02-01", "2020-02-05", 1, 1, "2020-02-02", "2020-02-06"),
    ("DrugExposure", "drug_exposure", "drug_exposure_start_date", "drug_exposure_end_date", "drug_concept_id", "2020-03-01", "2020-03-10", 2, 2, "2020-03-03", "2020-03-12"),
    ("DoseEra", "dose_era", "dose_era_start_date", "dose_era_end_date", "drug_concept_id", "2020-04-01", "2020-04-05", -1, -1, "2020-03-31", "2020-04-04"),
    ("ConditionEra", "condition_era", "condition_era_start_date", "condition_era_end_date", "condition_concept_id", "2020-01-01", "2020-01-10", 2, 1, "2020-01-03", "2020-01-11"),
    ("VisitOccurrence", "visit_occurrence", "visit_start_date", "visit_end_date", "visit_concept_id", "2020-01-01", "2020-01-10", 2, 1, "2020-01-03", "2020-01-11"),
]


@pytest.mark.parametrize("kind, table, s, e, concept, start, end, a, b, want_s, want_e", ADJUSTED)
def test_date_adjustment(spark, kind, table, s, e, concept, start, end, a, b, want_s, want_e):
    c = base(spark, **{table: [{"person_id": 1, f"{table}_id": 1, concept: 10, s: D(start), e: D(end)}]})
    ctx = CohortEngine(spark, c).context(Cohort(concept_sets=(SET,)))
    row = events(ctx, criterion(kind, DateAdjustment(a, b), codeset_id=1)).first()
    assert (row.start_date, row.end_date) == (D(want_s), D(want_e))


def run(spark, c, **parts):
    parts.setdefault("primary", Primary((criterion("ConditionOccurrence", codeset_id=1),)))
    return CohortEngine(spark, c, keep=None).run(Cohort(concept_sets=(SET,), **parts))


def conditions(*days, **more):
    return [{"condition_occurrence_id": i, "person_id": 1, "condition_concept_id": 10, "condition_start_date": D(d), **more} for i, d in enumerate(days, 1)]


def test_first_is_taken_before_other_attributes(spark):
    rows = conditions("2020-01-01", "2020-02-01")
    rows[1]["stop_reason"] = "done"
    got = run(spark, base(spark, condition_occurrence=rows), primary=Primary((criterion("ConditionOccurrence", codeset_id=1, first=True, stop_reason=TextFilter("done")),)))
    assert got.primary.count() == 0


def test_missing_limits(spark):
    c = base(spark, condition_occurrence=conditions("2020-01-01", "2020-02-01"))
    assert run(spark, c, primary=Primary((criterion("ConditionOccurrence", codeset_id=1),), limit=None)).primary.count() == 1
    assert run(spark, c).included.count() == 2


def test_null_end_is_the_next_day_and_events_outside_observation_go(spark):
    got = run(spark, base(spark, condition_occurrence=conditions("2020-01-01", "2025-01-01"))).primary.collect()
    assert [(r.start_date, r.end_date) for r in got] == [(D("2020-01-01"), D("2020-01-02"))]


def test_not_in_with_nulls(spark):
    rows = conditions("2020-01-01", "2020-02-01", "2020-03-01")
    for r, v in zip(rows, (10, 11, None), strict=True):
        r["condition_status_concept_id"] = v
    c = base(spark, condition_occurrence=rows)
    ctx = CohortEngine(spark, c).context(Cohort(concept_sets=(SET, ConceptSet(2, "none", ()))))
    ids = lambda s: sorted(r.event_id for r in events(ctx, criterion("ConditionOccurrence", condition_status_cs=s)).collect())
    assert ids(Selection(1, True)) == [2]
    assert ids(Selection(2, True)) == [1, 2, 3]
    assert ids(Selection(1, False)) == [1]


def test_window_end_defaults(spark):
    """A missing use of the event's end means the start in a start window and the end in an end window."""
    drugs = [{"drug_exposure_id": 1, "person_id": 1, "drug_concept_id": 11, "drug_exposure_start_date": D("2020-01-05"), "drug_exposure_end_date": D("2020-03-01")}]
    c = base(spark, condition_occurrence=conditions("2020-01-01"), drug_exposure=drugs)
    near = Window(Bound(1, 0), Bound(1, 10))
    for k, n in ((Correlated(criterion("DrugExposure"), near), 1), (Correlated(criterion("DrugExposure"), None, near), 0)):
        assert run(spark, c, rules=(Rule("r", None, Group("ALL", criteria=(k,))),)).included.count() == n


def test_unknown_group_and_count_column_raise(spark):
    c = base(spark, condition_occurrence=conditions("2020-01-01"))
    k = Correlated(criterion("ConditionOccurrence"))
    with pytest.raises(ValueError, match="group type"):
        run(spark, c, rules=(Rule("r", None, Group("SOME", criteria=(k,))),)).included
    bad = Correlated(criterion("ConditionOccurrence"), occurrence=Occurrence(2, 1, True, "refills"))
    with pytest.raises(ValueError, match="to count"):
        run(spark, c, rules=(Rule("r", None, Group("ALL", criteria=(bad,))),)).included


def test_many_rules(spark):
    """More rules than a mask holds are counted."""
    c = base(spark, condition_occurrence=conditions("2020-01-01"))
    assert run(spark, c, rules=tuple(Rule(str(i), None, Group()) for i in range(64))).included.count() == 1


def test_ends_and_eras(spark):
    c = base(spark, condition_occurrence=conditions("2020-01-01", "2020-01-20", "2020-06-01"))
    got = run(spark, c, end_strategy=DateOffset("StartDate", 10)).cohort
    assert got.count() == 3
    from dataclasses import replace

    from cohortarium.model import Collapse

    wide = CohortEngine(spark, c).run(replace(run(spark, c, end_strategy=DateOffset("StartDate", 10)).expression, collapse=Collapse("ERA", 9))).cohort.orderBy("cohort_start_date").collect()
    assert [(r.cohort_start_date, r.cohort_end_date) for r in wide] == [(D("2020-01-01"), D("2020-01-30")), (D("2020-06-01"), D("2020-06-11"))]


def test_custom_era_with_supply_override(spark):
    drugs = [{"drug_exposure_id": i, "person_id": 1, "drug_concept_id": 10, "drug_exposure_start_date": D(d), "days_supply": 90} for i, d in enumerate(("2020-01-01", "2020-01-15"))]
    c = base(spark, condition_occurrence=conditions("2020-01-02"), drug_exposure=drugs)
    assert run(spark, c, end_strategy=CustomEra(1, 3, 0, 10)).exits.first().end_date == D("2020-01-11")
    assert run(spark, c, end_strategy=CustomEra(1, 5, 0)).exits.first().end_date == D("2020-04-14")
    with pytest.raises(ValueError):
        run(spark, c, end_strategy=CustomEra()).ends


def test_results_are_replaced_by_cohort(spark, tmp_path):
    from cohortarium.sources.sinks import read, write_result

    c = base(spark, condition_occurrence=conditions("2020-01-01"))
    rules = (Rule("r", None, Group()),)
    for cohort_id in (1, 2, 1):
        result = CohortEngine(spark, c).run(run(spark, c, rules=rules).expression, cohort_id)
        write_result(result, str(tmp_path))
    assert sorted(r.cohort_definition_id for r in read(spark, str(tmp_path), "cohort").collect()) == [1, 2]
    assert read(spark, str(tmp_path), "cohort_inclusion_stats").count() == 4


intervals = st.lists(st.tuples(st.integers(1, 3), st.integers(0, 60), st.integers(0, 15)), min_size=1, max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(intervals, st.integers(0, 10))
def test_fold_is_disjoint_and_idempotent(spark, rows, pad):
    from datetime import timedelta

    day = lambda n: D("2020-01-01") + timedelta(n)
    df = spark.createDataFrame([(p, day(s), day(s + n)) for p, s, n in rows], "person_id long, start_date date, end_date date")
    eras = sorted((r.person_id, r.start_date, r.end_date) for r in fold(df, pad).collect())
    for (p, _, e), (q, s, _) in zip(eras, eras[1:], strict=False):
        assert p != q or (s - e).days > pad
    again = fold(spark.createDataFrame(eras, df.schema), pad)
    assert sorted((r.person_id, r.start_date, r.end_date) for r in again.collect()) == eras


def test_number_literals():
    from cohortarium.functions.predicates import number
    from pyspark.sql import functions as F

    assert number(F.lit(1), Range("gt", None)) is None
    assert number(F.lit(1), Range("bt", 1, None)) is None
    with pytest.raises(ValueError):
        number(F.lit(1), Range("near", 1))


def test_streaming_eras(spark, tmp_path):
    from datetime import datetime

    from cohortarium.streaming.eras import streaming_eras

    rows = [(1, datetime(2020, 1, d)) for d in (1, 2, 10)]
    spark.createDataFrame(rows, "person_id long, start_time timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("person_id long, start_time timestamp").parquet(str(tmp_path / "in"))
    q = streaming_eras(stream, 3).writeStream.format("memory").queryName("eras").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = sorted((r.era_start.day, r.era_end.day, r.n_events) for r in spark.table("eras").collect())
    assert got == [(1, 2, 2), (10, 10, 1)]
