"""Cohort expressions as Markdown sentences."""

from __future__ import annotations

import json
import re

from .domains import Attribute
from .model import (
    Cohort,
    Concept,
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
    Range,
    Selection,
    TextFilter,
    Window,
    _concept_set,
    from_json,
)

# Wordings.
NUMBER_OPS = {"lt": "&lt;", "lte": "&lt;=", "eq": "=", "!eq": "not =", "gt": "&gt;", "gte": "&gt;=", "bt": "between", "!bt": "not Between"}
DATE_OPS = {"lt": "before", "lte": "on or Before", "eq": "on", "!eq": "not on", "gt": "after", "gte": "on or after", "bt": "between", "!bt": "not between"}
TEXT_OPS = {"startswith": "starting with", "contains": "containing", "endswith": "ending with", "!startswith": "not starting with", "!contains": "not containing", "!endswith": "not ending with"}
LIMITS = {"All": "all events", "First": "earliest event", "Last": "latest event"}
GROUPS = {"ALL": "all", "ANY": "any"}
MONTHS = "January February March April May June July August September October November December".split()
HTML_NAMES = {"<": "&lt;", "<=": "&lt;=", ">": "&gt;", ">=": "&gt;="}


def number(v) -> str:
    try:
        x = float(v)
    except (TypeError, ValueError):
        return "" if v is None else str(v)
    return f"{int(x):,}" if x == int(x) else f"{x:,.10f}".rstrip("0")


def day(v: str | None) -> str:
    m = re.match(r"(\d{4})-(\d\d)-(\d\d)", str(v or ""))
    return f"{MONTHS[int(m[2]) - 1]} {int(m[3])}, {m[1]}" if m else f"_invalid date_ {v or ''}".strip()


def numeric(r: Range) -> str:
    op = r.op or "eq"
    return f"{NUMBER_OPS.get(op, op)} {number(r.value)}" + (f" and {number(r.extent)}" if op.endswith("bt") else "")


def dates(r: Range) -> str:
    op = r.op or "eq"
    return DATE_OPS.get(op, op) + (f" {day(r.value)}" if r.value else "") + (f" and {day(r.extent)}" if op.endswith("bt") and r.extent else "")


def concepts(listed: tuple[Concept, ...], quote: str = '"') -> str:
    names = [f"{quote}{HTML_NAMES.get(c.concept_name, c.concept_name.lower())}{quote}" for c in listed or () if c.concept_name]
    if not names:
        return "[none specified]"
    return names[0] if len(names) == 1 else ", ".join(names[:-1]) + " or " + names[-1]


def worded(t: TextFilter) -> str:
    return f'{TEXT_OPS.get((t.op or "").lower(), t.op or "equal to")} "{t.text or ""}"'


#: The sentences of a window, by what its two bounds say ("all before, 0 after"); the first that fits.
WINDOWS = (
    (r"all before, 0 .*", "anytime on or before {index}"),
    (r"all before, 1 before", "anytime prior to {index}"),
    (r"\d+ before, 1 before", "in the {first} days prior to {index}"),
    (r"all before, (?!1 )\d+ .*", "anytime up to {last} days {last_side} {index}"),
    (r"[1-9]\d* .*, all after", "{first} days {first_side} {index}"),
    (r".*", "between {first} days {first_side} and {last} days {last_side} {index}"),
)
#: A moved date, by the sign of its days; the sentence, by whether both dates start from the same one.
MOVED = {-1: "{} days before", 0: "on", 1: "{} days after"}
ADJUSTED = {True: "starting {start} and ending {end} the event {end_date}", False: "starting {start} the event {start_date} and ending {end} the event {end_date}"}
#: Ages, by whether one is asked for at the start and at the end.
AGES = {(False, False): "", (True, False): "{} years old", (False, True): "{1} years old at era end", (True, True): "{} years old at era start and {} years old at era end"}


def window(w: Window, index: str, event_end: bool) -> str:
    says = {}
    for name, bound in (("first", w.start), ("last", w.end)):
        says[name] = "all" if bound is None or bound.days is None else str(bound.days)
        says[f"{name}_side"] = "before" if bound is not None and bound.coeff < 0 else "after"
    both = "{first} {first_side}, {last} {last_side}".format(**says)
    sentence = next(text for pattern, text in WINDOWS if re.fullmatch(pattern, both))
    says |= {k: number(says[k]) for k in ("first", "last")}
    return f"{'ending' if event_end else 'starting'} " + sentence.format(index=f"{index} {'end' if w.use_index_end else 'start'} date", **says)


def adjustment(a: DateAdjustment) -> str:
    start, end = (MOVED[(n > 0) - (n < 0)].format(abs(n)) for n in (a.start_offset, a.end_offset))
    start_date, end_date = (x.replace("_", " ").lower() for x in (a.start_with, a.end_with))
    return ADJUSTED[a.start_with == a.end_with].format(start=start, end=end, start_date=start_date, end_date=end_date)


def period(p: Period) -> str:
    parts = [f"a user defined {which} date of {day(v)}" for which, v in (("start", p.start_date), ("end", p.end_date)) if v]
    return " and ".join(parts)


class Renderer:
    """Sentences that name concept sets by their names."""

    def __init__(self, sets: tuple[ConceptSet, ...] = ()):
        self.names = {s.id: s.name for s in sets}

    def codeset(self, id: int | None, default: str) -> str:
        if id is None:
            return default
        return f"'{self.names[id]}'" if self.names.get(id) else default

    def selection(self, s: Selection) -> str:
        return ("not " if s.is_exclusion else "") + f"in {self.codeset(s.codeset_id, 'any')} concept set"

    # parts of a criterion
    def people(self, c: Criterion | Demographic) -> str | None:
        asked = dict(c.attributes) if isinstance(c, Criterion) else vars(c)
        ages = [asked.get("age_at_start") or asked.get("age"), asked.get("age_at_end")]
        aged = AGES[tuple(map(bool, ages))].format(*(numeric(r) if r else "" for r in ages))
        genders, chosen = asked.get("gender") or (), asked.get("gender_cs")
        who = concepts(genders, "") if genders else f"gender {self.selection(chosen)}" if chosen else ""
        listing = len(genders) != 1  # a list or a set ends with a comma before the ages
        said = (", " if listing else " ").join(x for x in (who, aged) if x)
        return f"who are {said}" if said else None

    def when(self, c: Criterion) -> str | None:
        ranges = [(a.phrase, c.get(a.name)) for a in c.domain.attributes if a.kind == "date" and a.phrase and c.get(a.name)]
        return " and ".join(f"{how} {dates(r)}" for how, r in ranges) or None

    def attribute(self, a: Attribute, v, c: Criterion) -> str | None:
        if a.phrase is None or a.kind in ("date", "age") or a.name.startswith("gender"):
            return None
        if a.kind in ("number", "length"):
            return a.phrase.format(numeric(v))
        if a.kind == "concepts":
            verb = a.phrase
            if a.exclude:
                verb += " is not:" if c.get(a.exclude) else " is:"
            else:
                verb += ":"
            return f"{verb} {concepts(v)}"
        if a.kind == "selection":
            return f"{a.phrase.removesuffix(' that')} {self.selection(v)}"
        if a.kind == "text":
            return f"{a.phrase} {worded(v)}"
        if a.kind == "flag":
            return a.phrase if v else None
        if a.kind == "codeset":
            return f"{a.phrase} in {self.codeset(v, 'any')} concept set"
        return None

    def around(self, k: Correlated, index: str) -> str | None:
        """The windows (the first is of the event's start unless it says otherwise, the second of its end), then the rest."""
        bounded = [(w, w.use_event_end if w.use_event_end is not None else ends) for w, ends in ((k.start_window, False), (k.end_window, True)) if w and any(b is not None and b.days is not None for b in (w.start, w.end))]
        flags = {f"at same visit as {index}": k.restrict_visit, "allow events outside observation period": k.ignore_observation_period}
        said = [" and ".join(window(w, index, ends) for w, ends in bounded), " and ".join(text for text, on in flags.items() if on)]
        return "; ".join(filter(None, said)) or None

    def criterion(self, c: Criterion, level: int = 0, plural: bool = True, around: Correlated | None = None, index: str = "cohort entry") -> str:
        d, first = c.domain, bool(c.get("first"))
        attrs = [self.around(around, index) if around else None, self.people(c), adjustment(c.date_adjustment) if c.date_adjustment else None, self.when(c)]
        if c.get("user_defined_period"):
            attrs.append(period(c.get("user_defined_period")))
        attrs += [self.attribute(a, c.get(a.name), c) for a in d.attributes if c.get(a.name) is not None and not (a.kind == "codeset" and a.on is None)]
        noun = d.noun + ("s" if plural and not first and d.kind != "Death" else "")
        if d.concept:
            noun += f" of {self.codeset(c.get('codeset_id'), d.any_name)}"
            if d.source and c.get(d.source[0]) is not None:
                noun += f" (including {self.codeset(c.get(d.source[0]), d.any_name)} source concepts)"
        if first:
            noun += " (first observation period in person's history)" if d.kind == "ObservationPeriod" else " for the first time in the person's history"
        said = ", ".join([noun, "; ".join(a for a in attrs if a)]) if any(attrs) else noun
        if c.correlated and not c.correlated.empty:
            return f"{said}; {self.group(c.correlated, level, self.codeset(c.get('codeset_id'), d.any_name or d.noun))}"
        return f"{said}."

    def counted(self, k: Correlated, level: int, index: str) -> str:
        o = k.occurrence or Occurrence()
        many = "no" if o.type == 0 and o.count == 0 else f"{('exactly', 'at most', 'at least')[o.type]} {o.count}"
        distinct = f" distinct {(o.count_column or 'domain_concept_id').removesuffix('_id').replace('domain_concept', 'standard concept').replace('_', ' ')} from" if o.is_distinct else ""
        return f"having {many}{distinct} {self.criterion(k.criterion, level, o.count != 1, k, index)}"

    def demographic(self, d: Demographic) -> str:
        parts = [self.people(d)]
        ranges = [f"{how} {dates(r)}" for how, r in (("starting", d.occurrence_start_date), ("ending", d.occurrence_end_date)) if r]
        parts.append(" and ".join(ranges) or None)
        for what in ("race", "ethnicity"):
            if listed := getattr(d, what):
                parts.append(f"{what}: {concepts(listed)}")
            if s := getattr(d, f"{what}_cs"):
                parts.append(f"{what} {self.selection(s)}")
        said = "; ".join(p for p in parts if p)
        return f"with the following event criteria: {said}." if said else "any event (no demographic criteria specified)."

    def group(self, g: Group, level: int = 0, index: str = "cohort entry") -> str:
        children = [self.demographic(d) for d in g.demographics]
        if len(g.demographics) + len(g.criteria) > 1 or g.type not in GROUPS or g.groups:
            children += [self.counted(k, level + 1, index) for k in g.criteria]
            children += [self.group(x, level + 1, index) for x in g.groups]
            head = GROUPS.get(g.type) or f"{g.type.lower().replace('_', ' ')} {g.count}"
            pad = "   " * (level + 1)
            return f"with {head} of the following criteria:\n\n" + "\n".join(f"{pad}{i}. {x}" for i, x in enumerate(children, 1)) + "\n"
        return (children + [self.counted(k, level, index) for k in g.criteria] + [""])[0]

    def strategy(self, s: DateOffset | CustomEra | None) -> str:
        days = lambda n: f"{n} day" + ("" if n == 1 else "s")
        if s is None:
            return "The person exits the cohort at the end of continuous observation."  # fixed value, as the sentences below
        if isinstance(s, DateOffset):
            field = {"StartDate": "start date", "EndDate": "end date"}.get(s.date_field, s.date_field)
            return f"The cohort end date will be offset from index event's {field} plus {days(s.offset)}."
        use = f"forcing drug exposure days supply to: {days(s.days_supply_override)}." if s.days_supply_override is not None else "using days supply and exposure end date for exposure duration."
        return f"The cohort end date will be based on a continuous exposure to {self.codeset(s.drug_codeset_id, '_invalid drug specified_')}:\nallowing {s.gap_days} days between exposures, adding {days(s.offset)} after exposure ends, and {use}"

    def cohort(self, c: Cohort) -> str:
        out = ["### Cohort Entry Events"]
        if p := c.primary:
            observed = [f"{n} days {w}" for n, w in ((p.prior_days, "before"), (p.post_days, "after")) if n > 0]
            people = "People" + (f" with continuous observation of {' and '.join(observed)} event" if observed else "") + (" may" if c.rules or c.additional else "")
            entry = "\n".join(f"{i}. {self.criterion(x)}" for i, x in enumerate(p.criteria, 1))
            out.append(f"{people} enter the cohort when observing any of the following:\n\n{entry}")
            limit = p.limit or "First"
            if limit != "All":
                out.append(f"Limit cohort entry events to the {LIMITS.get(limit, limit)} per person.")
            if c.additional:
                out.append(f"Restrict entry events to {self.group(c.additional)}")
                if limit == "All" and (c.qualified_limit or "First") != "All":
                    out.append(f"Limit these restricted entry events to the {LIMITS[c.qualified_limit or 'First']} per person.")
        if c.rules:
            out.append("### Inclusion Criteria")
            for i, r in enumerate(c.rules, 1):
                out.append(f"#### {i}. {r.name or 'Unnamed Rule'}" + (f": {r.description}" if r.description else ""))
                out.append(f"Entry events {self.group(r.expression)}" if r.expression else "Entry events.")
        if c.primary and (c.primary.limit or "First") == "All" and (c.expression_limit or "All") != "All":
            out.append(f"Limit qualifying entry events to the {LIMITS.get(c.expression_limit, c.expression_limit)} per person.")
        out += ["### Cohort Exit", self.strategy(c.end_strategy)]
        if c.censoring:
            out.append("The person exits the cohort when encountering any of the following events:\n\n" + "\n".join(f"{i}. {self.criterion(x)}" for i, x in enumerate(c.censoring, 1)))
        out += ["### Cohort Eras", f"Remaining events will be combined into cohort eras if they are within {c.collapse.era_pad} days of each other."]
        if w := c.censor_window:
            out.append(" ".join([f"Left censor cohort start dates to {w.start_date}."] * bool(w.start_date) + [f"Right censor cohort end dates to {w.end_date}."] * bool(w.end_date)))
        return "\n\n".join(out) + "\n"


def concept_set_table(s: ConceptSet) -> str:
    yes = lambda b: "YES" if b else "NO"
    head = f"### {s.name or 'Unnamed concept set'}\n\n|Concept ID|Concept Name|Code|Vocabulary|Excluded|Descendants|Mapped\n|:---|:---------------------------------------|:--|:-----|:--:|:--:|:--:|\n"
    if not s.items:
        return head + "|There are no concept set items in this concept set.||||||\n"
    return head + "".join(f"|{i.concept.concept_id}|{i.concept.concept_name or ''}|{i.concept.concept_code or ''}|{i.concept.vocabulary_id or ''}|{yes(i.is_excluded)}|{yes(i.include_descendants)}|{yes(i.include_mapped)}|\n" for i in s.items)


def markdown(cohort: Cohort | str, title: str | None = None, include_concept_sets: bool = False) -> str:
    c = from_json(cohort) if isinstance(cohort, str) else cohort
    out = Renderer(c.concept_sets).cohort(c)
    if title or c.title:
        out = f"# {title or c.title}\n\n{out}"
    if include_concept_sets:
        out += "\n## Concept Sets\n\n" + "\n".join(concept_set_table(s) for s in c.concept_sets)
    return out


def concept_sets_markdown(sets: tuple[ConceptSet, ...] | str) -> str:
    """A list of concept sets, or its JSON, as tables."""
    if isinstance(sets, str):
        data = json.loads(sets)
        sets = tuple(_concept_set(x, f"$[{i}]") for i, x in enumerate(data if isinstance(data, list) else [data]))
    return "\n".join(concept_set_table(s) for s in sets)
