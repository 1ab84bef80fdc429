"""Results kept in tables partitioned by cohort: writing a cohort replaces that cohort only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Result tables and what they are partitioned by.
TABLES = {"cohort": ["cohort_definition_id"], "cohort_inclusion_result": ["cohort_definition_id", "mode_id"], "cohort_inclusion_stats": ["cohort_definition_id", "mode_id"], "cohort_summary_stats": ["cohort_definition_id", "mode_id"]}


def replace_rows(rows: DataFrame, path: str, table: str, **keys: int) -> None:
    """Overwrites the partition that keys name, also with no rows at all."""
    spark = rows.sparkSession
    where = "/".join(f"{k}={keys[k]}" for k in TABLES[table])
    rows.drop(*keys).write.mode("overwrite").parquet(f"{path}/{table}/{where}")
    spark.catalog.refreshByPath(f"{path}/{table}")


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{table}")
    return rows.withColumns({k: F.col(k).cast("int" if k == "mode_id" else "long") for k in TABLES[table]})


def write_result(result, path: str, statistics: bool = True) -> None:
    """The cohort of a CohortResult and, for both modes, its statistics; then gives back what the result stored."""
    key = {"cohort_definition_id": result.cohort_id}
    replace_rows(result.cohort, path, "cohort", **key)
    if statistics and result.expression.rules:
        for mode in (0, 1):
            for table, rows in (("cohort_inclusion_result", result.inclusion_result(mode)), ("cohort_inclusion_stats", result.inclusion_stats(mode)), ("cohort_summary_stats", result.summary_stats(mode))):
                replace_rows(rows, path, table, mode_id=mode, **key)
    result.release()
