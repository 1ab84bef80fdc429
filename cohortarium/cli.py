"""Command line: validate, plan, render-markdown, generate-source, process, run.

Exit codes: 0 well, 1 critical findings or an error, 2 findings of lower severity (validate only).
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .checks import CRITICAL, check
from .codegen import to_python
from .model import Cohort, from_json
from .render import markdown


def _read(path: str) -> Cohort:
    return from_json(sys.stdin.read() if path == "-" else Path(path).read_text())


def _write(text: str, path: str | None) -> None:
    if path:
        Path(path).write_text(text)
    else:
        print(text)


def _validate(cohort: Cohort, quiet: bool = False) -> int:
    found = check(cohort)
    for f in found:
        if not quiet or f.severity == CRITICAL:
            print(f.to_message(), file=sys.stderr)
    if not found and not quiet:
        print("No findings.", file=sys.stderr)
    return 1 if any(f.severity == CRITICAL for f in found) else 2 if found else 0


def _result(cohort: Cohort, cdm: str, cohort_id: int):
    from pyspark.sql import SparkSession

    from .plans.engine import CohortEngine
    from .sources.cdm import Cdm

    spark = SparkSession.builder.getOrCreate()
    return CohortEngine(spark, Cdm.from_parquet(spark, cdm) if "/" in cdm else Cdm.from_catalog(spark, cdm)).run(cohort, cohort_id)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cohortarium", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("validate", "check an expression"), ("plan", "show Spark's plan"), ("render-markdown", "write it as Markdown"), ("generate-source", "write it as Python"), ("process", "validate, plan and render"), ("run", "write the cohort and its statistics")):
        p = commands.add_parser(name, help=text)
        p.add_argument("expression", help="JSON file, or - for the standard input")
        if name == "validate":
            p.add_argument("-q", "--quiet", action="store_true", help="show critical findings only")
        else:
            p.add_argument("--no-validate", action="store_true", help="don't stop at critical findings")
        if name == "process":
            p.add_argument("--plan-output", help="file of Spark's plan")
            p.add_argument("--md-output", help="file of the Markdown")
        if name not in ("validate", "run"):
            p.add_argument("-o", "--output")
        if name in ("plan", "process", "run"):
            p.add_argument("--cdm", required=name != "process", help="folder of Parquet tables, or a database of the catalogue")
            p.add_argument("--cohort-id", type=int, default=1)
        if name == "render-markdown":
            p.add_argument("--concept-sets", action="store_true")
            p.add_argument("-t", "--title")
        if name == "run":
            p.add_argument("--results", required=True, help="folder of the result tables")
            p.add_argument("--no-statistics", action="store_true")
    a = parser.parse_args(argv)
    try:
        cohort = _read(a.expression)
        if a.command == "validate":
            return _validate(cohort, a.quiet)
        if not a.no_validate and a.command != "process" and any(f.severity == CRITICAL for f in check(cohort)):
            return _validate(cohort, quiet=True)
        if a.command == "render-markdown":
            _write(markdown(cohort, a.title, a.concept_sets), a.output)
        elif a.command == "generate-source":
            _write(to_python(cohort), a.output)
        elif a.command == "plan":
            plan = _result(cohort, a.cdm, a.cohort_id).cohort._jdf.queryExecution().toString()
            _write(plan, a.output)
        elif a.command == "process":
            code = 0 if a.no_validate else _validate(cohort)
            text = markdown(cohort)
            plan = _result(cohort, a.cdm, a.cohort_id).cohort._jdf.queryExecution().toString() if a.cdm else ""
            if a.plan_output:
                _write(plan, a.plan_output)
            if a.md_output:
                _write(text, a.md_output)
            if not (a.plan_output and a.md_output):
                _write("\n".join(x for x, f in ((text, a.md_output), (plan, a.plan_output)) if x and not f), a.output)
            return 1 if code == 1 else 0
        elif a.command == "run":
            from .sources.sinks import write_result

            write_result(_result(cohort, a.cdm, a.cohort_id), a.results, not a.no_statistics)
        return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
