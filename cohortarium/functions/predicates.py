"""Comparisons of an expression as Spark columns. A comparison without a value is no condition: None."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Concept, Range, TextFilter


def _compare(column: Column, op: str | None, low: Column | None, high: Column | None) -> Column | None:
    op = (op or "eq").lower()
    if low is None or (op.endswith("bt") and high is None):
        return None
    if op == "lt":
        return column < low
    if op == "lte":
        return column <= low
    if op == "gt":
        return column > low
    if op == "gte":
        return column >= low
    if op == "eq":
        return column == low
    if op == "!eq":
        return column != low
    if op == "bt":
        return (column >= low) & (column <= high)
    if op == "!bt":
        return ~((column >= low) & (column <= high))
    raise ValueError(f"unknown comparison {op!r}")


def number(column: Column, r: Range, decimals: int | None = None) -> Column | None:
    """Whole numbers are cut, others rounded to ``decimals``, before they are compared."""

    def literal(v):
        if v is None:
            return None
        return F.lit(int(float(v))) if decimals is None else F.lit(round(float(v), decimals))

    return _compare(column, r.op, literal(r.value), literal(r.extent))


def date(column: Column, r: Range) -> Column | None:
    literal = lambda v: None if v is None else F.to_date(F.lit(str(v)[:10]))
    return _compare(column, r.op, literal(r.value), literal(r.extent))


def text(column: Column, t: TextFilter) -> Column | None:
    """% and _ in the text are wild cards; a backslash is a backslash."""
    if t.text is None:
        return None
    op, said = (t.op or "eq").lower(), t.text
    plain = said.replace("\\", "\\\\")
    shape = {"startswith": f"{plain}%", "endswith": f"%{plain}", "contains": f"%{plain}%"}.get(op.removeprefix("!"))
    hit = column == said if shape is None else column.like(shape)
    return ~hit if op.startswith("!") else hit


def concept_in(column: Column, concepts: tuple[Concept, ...], exclude: bool = False) -> Column:
    """An empty list is met by nothing (or, excluded, by every value that there is)."""
    ids = [c.concept_id for c in concepts if c.concept_id is not None]
    hit = column.isin(ids) if ids else column.isNotNull() & F.lit(False)
    return ~hit if exclude else hit


def both(conditions: list[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))
