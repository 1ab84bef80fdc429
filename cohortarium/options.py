"""How a cohort is run: where its tables are, and what is written."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .model import Cohort, _flat
from .plans.engine import CohortEngine, CohortResult
from .sources.cdm import Cdm

_VOCABULARY = ("concept", "concept_ancestor", "concept_relationship")


@dataclass(frozen=True)
class RunOptions:
    """Names as in the options' JSON; schemas are databases of Spark's catalogue."""

    cohort_id_field_name: str = "cohort_definition_id"
    cohort_id: int = 1
    cdm_schema: str = "default"
    target_table: str | None = None
    result_schema: str | None = None
    vocabulary_schema: str | None = None
    generate_stats: bool = False

    @classmethod
    def from_json(cls, text: str) -> RunOptions:
        names = {_flat(f): f for f in cls.__dataclass_fields__}
        given = {names[_flat(k)]: v for k, v in json.loads(text).items() if _flat(k) in names and v is not None}
        return cls(**given)


def run(spark: SparkSession, expression: Cohort | str, options: RunOptions) -> CohortResult:
    """Runs the cohort from the catalogue; writes it (and its statistics) where options name tables."""

    def load(name: str):
        full = f"{options.vocabulary_schema or options.cdm_schema if name in _VOCABULARY else options.cdm_schema}.{name}"
        return spark.table(full) if spark.catalog.tableExists(full) else None

    result = CohortEngine(spark, Cdm(spark, load)).run(expression, options.cohort_id)
    if options.target_table:
        _replace(spark, result.cohort, options.target_table, options, "cohort_definition_id")
    if options.generate_stats and options.result_schema and result.expression.rules:
        for table, rows in (("cohort_inclusion_result", result.inclusion_result), ("cohort_inclusion_stats", result.inclusion_stats), ("cohort_summary_stats", result.summary_stats)):
            both = rows(0).unionByName(rows(1))
            _replace(spark, both, f"{options.result_schema}.{table}", options, "cohort_definition_id")
    return result


def _replace(spark: SparkSession, rows, table: str, options: RunOptions, key: str) -> None:
    """The cohort's partition of the table is replaced, also by no rows; the table is made if it isn't there."""
    column = options.cohort_id_field_name
    if not spark.catalog.tableExists(table):
        rows.withColumnRenamed(key, column).write.partitionBy(column).saveAsTable(table)
        return
    names = ", ".join(f"`{c}`" for c in spark.table(table).columns if c != column)
    spark.sql(f"insert overwrite table {table} partition (`{column}` = {int(options.cohort_id)}) select {names} from {{rows}}", rows=rows.drop(key))
