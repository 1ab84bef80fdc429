"""Python source that builds a cohort expression."""

from __future__ import annotations

from dataclasses import fields, is_dataclass
from pathlib import Path

from . import model


def _source(value, depth: int = 1) -> str:
    pad, close = "    " * depth, "    " * (depth - 1)
    if isinstance(value, model.Criterion):
        parts = [repr(value.kind)] + ["(\n" + "".join(f"{pad}    ({k!r}, {_source(v, depth + 2)}),\n" for k, v in value.attributes) + f"{pad})"]
        parts += [f"{n}={_source(getattr(value, n), depth + 1)}" for n in ("date_adjustment", "correlated") if getattr(value, n) is not None]
        return "Criterion(" + ", ".join(parts) + ")"
    if is_dataclass(value):
        given = [f for f in fields(value) if getattr(value, f.name) != (f.default if f.default_factory is type(f.default) or f.default is not None else None) or f.default is None and getattr(value, f.name) is not None]
        said = [f"{pad}{f.name}={_source(getattr(value, f.name), depth + 1)},\n" for f in given if getattr(value, f.name) is not None or f.default is not None]
        return f"{type(value).__name__}(\n{''.join(said)}{close})" if said else f"{type(value).__name__}()"
    if isinstance(value, tuple):
        return "(\n" + "".join(f"{pad}{_source(v, depth + 1)},\n" for v in value) + f"{close})" if value else "()"
    return repr(value)


def to_python(cohort: model.Cohort, name: str = "cohort") -> str:
    """Source text; running it leaves an equal expression in a variable."""
    used = [c for c in ("Bound", "Cohort", "Collapse", "Concept", "ConceptItem", "ConceptSet", "Correlated", "Criterion", "CustomEra", "DateAdjustment", "DateOffset", "Demographic", "Group", "Occurrence", "Period", "Primary", "Range", "Rule", "Selection", "TextFilter", "Window")]
    body = f"{name} = {_source(cohort)}\n"
    return "from cohortarium.model import (\n" + "".join(f"    {u},\n" for u in used if f"{u}(" in body) + ")\n\n" + body


def save(cohort: model.Cohort, path: str, name: str = "cohort") -> None:
    Path(path).write_text(to_python(cohort, name))
