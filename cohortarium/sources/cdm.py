"""The clinical data model as a catalogue of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns by table: l a long, i an int, d a date, f a double, s a string. Fixed by the data model.
SCHEMAS = {
    "person": "person_id l, year_of_birth i, gender_concept_id l, race_concept_id l, ethnicity_concept_id l",
    "observation_period": "observation_period_id l, person_id l, observation_period_start_date d, observation_period_end_date d, period_type_concept_id l",
    "visit_occurrence": "visit_occurrence_id l, person_id l, visit_concept_id l, visit_source_concept_id l, visit_start_date d, visit_end_date d, visit_type_concept_id l, provider_id l, care_site_id l",
    "visit_detail": "visit_detail_id l, person_id l, visit_detail_concept_id l, visit_detail_source_concept_id l, visit_detail_start_date d, visit_detail_end_date d, visit_detail_type_concept_id l, provider_id l, care_site_id l, visit_occurrence_id l, discharge_to_concept_id l",
    "condition_occurrence": "condition_occurrence_id l, person_id l, condition_concept_id l, condition_source_concept_id l, condition_start_date d, condition_end_date d, condition_type_concept_id l, condition_status_concept_id l, stop_reason s, provider_id l, visit_occurrence_id l, visit_detail_id l",
    "drug_exposure": "drug_exposure_id l, person_id l, drug_concept_id l, drug_source_concept_id l, drug_exposure_start_date d, drug_exposure_end_date d, drug_type_concept_id l, stop_reason s, refills i, quantity f, days_supply i, route_concept_id l, dose_unit_concept_id l, lot_number s, provider_id l, visit_occurrence_id l, visit_detail_id l",
    "procedure_occurrence": "procedure_occurrence_id l, person_id l, procedure_concept_id l, procedure_source_concept_id l, procedure_date d, procedure_type_concept_id l, modifier_concept_id l, quantity i, provider_id l, visit_occurrence_id l",
    "device_exposure": "device_exposure_id l, person_id l, device_concept_id l, device_source_concept_id l, device_exposure_start_date d, device_exposure_end_date d, device_type_concept_id l, unique_device_id s, quantity i, provider_id l, visit_occurrence_id l",
    "observation": "observation_id l, person_id l, observation_concept_id l, observation_source_concept_id l, observation_date d, value_as_number f, value_as_string s, value_as_concept_id l, unit_concept_id l, qualifier_concept_id l, observation_type_concept_id l, provider_id l, visit_occurrence_id l",
    "measurement": "measurement_id l, person_id l, measurement_concept_id l, measurement_source_concept_id l, measurement_date d, value_as_number f, range_low f, range_high f, value_as_concept_id l, operator_concept_id l, unit_concept_id l, measurement_type_concept_id l, provider_id l, visit_occurrence_id l",
    "specimen": "specimen_id l, person_id l, specimen_concept_id l, specimen_source_concept_id l, specimen_date d, specimen_type_concept_id l, quantity f, unit_concept_id l, anatomic_site_concept_id l, disease_status_concept_id l, specimen_source_id s, visit_occurrence_id l",
    "death": "person_id l, death_date d, death_type_concept_id l, cause_concept_id l, cause_source_concept_id l",
    "payer_plan_period": "payer_plan_period_id l, person_id l, payer_plan_period_start_date d, payer_plan_period_end_date d, payer_concept_id l, payer_source_concept_id l, plan_concept_id l, plan_source_concept_id l, sponsor_concept_id l, sponsor_source_concept_id l, stop_reason_concept_id l, stop_reason_source_concept_id l",
    "condition_era": "condition_era_id l, person_id l, condition_concept_id l, condition_era_start_date d, condition_era_end_date d, condition_occurrence_count i",
    "drug_era": "drug_era_id l, person_id l, drug_concept_id l, drug_era_start_date d, drug_era_end_date d, drug_exposure_count i, gap_days i",
    "dose_era": "dose_era_id l, person_id l, drug_concept_id l, unit_concept_id l, dose_value f, dose_era_start_date d, dose_era_end_date d",
    "location": "location_id l, region_concept_id l",
    "location_history": "location_history_id l, location_id l, entity_id l, domain_id s, start_date d, end_date d",
    "provider": "provider_id l, specialty_concept_id l",
    "care_site": "care_site_id l, place_of_service_concept_id l",
    "concept": "concept_id l, concept_name s, invalid_reason s",
    "concept_ancestor": "ancestor_concept_id l, descendant_concept_id l",
    "concept_relationship": "concept_id_1 l, concept_id_2 l, relationship_id s, invalid_reason s",
}
_TYPES = {"l": T.LongType(), "i": T.IntegerType(), "d": T.DateType(), "f": T.DoubleType(), "s": T.StringType()}


def schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in SCHEMAS[table].split(", "))])


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


class Cdm:
    """Tables by name. A column that a table lacks is null; a table that isn't there has no rows."""

    def __init__(self, spark: SparkSession, load: Mapping[str, DataFrame] | Callable[[str], DataFrame | None]):
        self.spark = spark
        self._load = load.get if isinstance(load, Mapping) else load
        self._seen: dict[str, DataFrame] = {}

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> Cdm:
        return cls(spark, lambda name: spark.read.parquet(f"{path}/{name}.parquet") if _exists(spark, f"{path}/{name}.parquet") else None)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> Cdm:
        return cls(spark, lambda name: spark.table(f"{database}.{name}") if spark.catalog.tableExists(f"{database}.{name}") else None)

    def table(self, name: str) -> DataFrame:
        if name == "location_region":
            return self._region
        if name not in self._seen:
            found, wanted = self._load(name), schema(name)
            if found is None:
                found = self.spark.createDataFrame([], wanted)
            have = {c.lower(): c for c in found.columns}
            self._seen[name] = found.select(*((F.col(have[f.name]) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
        return self._seen[name]

    @cached_property
    def _region(self) -> DataFrame:
        """Where people lived: location_history of persons with the location's region."""
        lived = self.table("location_history").filter("domain_id = 'PERSON'").withColumnRenamed("entity_id", "person_id")
        return lived.join(self.table("location"), "location_id")
