"""A fluent way to write cohorts: every call gives a new builder."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from . import modifiers
from .model import Bound, Cohort, Concept, ConceptItem, ConceptSet, Correlated, Criterion, Demographic, Group, Occurrence, Primary, Range, Rule, Window


@dataclass(frozen=True)
class Event:
    """A criterion with where and how often it must occur around the entry event."""

    criterion: Criterion
    window: Window | None = None
    occurrence: Occurrence = field(default_factory=Occurrence)
    same_visit_only: bool = False
    outside_observation: bool = False

    def within_days_before(self, days: int) -> Event:
        return replace(self, window=Window(Bound(-1, days), Bound(-1, 0), False, False))

    def within_days_after(self, days: int) -> Event:
        return replace(self, window=Window(Bound(1, 0), Bound(1, days), False, False))

    def within_days(self, before: int, after: int) -> Event:
        return replace(self, window=Window(Bound(-1, before), Bound(1, after), False, False))

    def anytime_before(self) -> Event:
        return replace(self, window=Window(Bound(-1), Bound(-1, 1), False, False))

    def anytime_after(self) -> Event:
        return replace(self, window=Window(Bound(1, 1), Bound(1), False, False))

    def same_visit(self) -> Event:
        return replace(self, same_visit_only=True)

    def ignore_observation_period(self) -> Event:
        return replace(self, outside_observation=True)

    def at_least(self, n: int) -> Event:
        return replace(self, occurrence=Occurrence(2, n))

    def at_most(self, n: int) -> Event:
        return replace(self, occurrence=Occurrence(1, n))

    def exactly(self, n: int) -> Event:
        return replace(self, occurrence=Occurrence(0, n))

    def correlated(self, occurrence: Occurrence | None = None) -> Correlated:
        return Correlated(self.criterion, self.window, None, occurrence or self.occurrence, self.same_visit_only, self.outside_observation)


def event(kind: str, codeset_id: int | None = None, **attributes) -> Event:
    """An event of a domain, such as event("ConditionOccurrence", 1, first=True)."""
    given = {k: v for k, v in {"codeset_id": codeset_id, **attributes}.items() if v is not None}
    return Event(Criterion(kind, tuple(sorted(given.items()))))


def concept_set(id: int, name: str, *concept_ids: int, descendants: bool = True) -> ConceptSet:
    return ConceptSet(id, name, tuple(ConceptItem(Concept(c), include_descendants=descendants) for c in concept_ids))


@dataclass(frozen=True)
class CohortBuilder:
    title: str | None = None
    sets: tuple[ConceptSet, ...] = ()
    entries: tuple[Criterion, ...] = ()
    rules: tuple[Rule, ...] = ()
    changes: tuple = ()

    def with_concept_sets(self, *sets: ConceptSet) -> CohortBuilder:
        return replace(self, sets=(*self.sets, *sets))

    def enter_on(self, *events: Event) -> CohortBuilder:
        return replace(self, entries=(*self.entries, *(e.criterion for e in events)))

    def _rule(self, name: str, group: Group) -> CohortBuilder:
        return replace(self, rules=(*self.rules, Rule(name, None, group)))

    def require(self, event: Event, name: str | None = None) -> CohortBuilder:
        return self._rule(name or f"requires {event.criterion.domain.noun}", Group("ALL", criteria=(event.correlated(),)))

    def exclude(self, event: Event, name: str | None = None) -> CohortBuilder:
        return self._rule(name or f"excludes {event.criterion.domain.noun}", Group("ALL", criteria=(event.correlated(Occurrence(0, 0)),)))

    def any_of(self, *events: Event, name: str = "any of") -> CohortBuilder:
        return self._rule(name, Group("ANY", criteria=tuple(e.correlated() for e in events)))

    def all_of(self, *events: Event, name: str = "all of") -> CohortBuilder:
        return self._rule(name, Group("ALL", criteria=tuple(e.correlated() for e in events)))

    def at_least_of(self, n: int, *events: Event, name: str = "at least") -> CohortBuilder:
        return self._rule(name, Group("AT_LEAST", n, tuple(e.correlated() for e in events)))

    def require_age(self, low: int | None = None, high: int | None = None) -> CohortBuilder:
        return self._changed(modifiers.set_age_criteria, low, high)

    def require_gender(self, *genders: str) -> CohortBuilder:
        return self._changed(modifiers.set_gender_criteria, *genders)

    def require_demographics(self, name: str = "demographics", **parts) -> CohortBuilder:
        return self._rule(name, Group("ALL", demographics=(Demographic(**parts),)))

    def with_observation(self, prior: int = 0, post: int = 0) -> CohortBuilder:
        return self._changed(modifiers.set_prior_observation, prior)._changed(modifiers.set_post_observation, post)

    def first_event_only(self) -> CohortBuilder:
        return self._changed(modifiers.set_limit_to_first_event)

    def exit_at(self, strategy: str, offset: int = 0, codeset_id: int | None = None, gap_days: int = 30) -> CohortBuilder:
        """observation_period, start_date or end_date (with an offset), or drug_era (of a concept set)."""
        if strategy == "drug_era" and codeset_id is None:
            raise ValueError("a drug era needs a concept set")
        options = {
            "observation_period": {"strategy": "end_of_observation"}, "drug_era": {"strategy": "custom_era", "codeset_id": codeset_id, "gap_days": gap_days, "offset": offset},
            "start_date": {"strategy": "fixed_duration", "days": offset}, "end_date": {"strategy": "fixed_duration", "days": offset, "date_field": "EndDate"},
        }
        return self._changed(lambda c: modifiers.set_end_date_strategy(c, **options.get(strategy, {"strategy": strategy})))

    def censor_on(self, event: Event) -> CohortBuilder:
        return self._changed(modifiers.set_censor_event, event.criterion)

    def collapse_within(self, days: int) -> CohortBuilder:
        return self._changed(modifiers.set_cohort_era, days)

    def between(self, start: str | None = None, end: str | None = None) -> CohortBuilder:
        return self._changed(modifiers.set_date_range, start, end)

    def _changed(self, change, *arguments) -> CohortBuilder:
        return replace(self, changes=(*self.changes, (change, arguments)))

    def build(self) -> Cohort:
        if not self.entries:
            raise ValueError("a cohort needs an entry event")
        cohort = Cohort(self.title, self.sets, Primary(self.entries), expression_limit="All", rules=self.rules)
        for change, arguments in self.changes:
            cohort = change(cohort, *arguments)
        return cohort


__all__ = ["CohortBuilder", "Event", "Range", "concept_set", "event"]
