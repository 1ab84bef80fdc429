"""Concept sets resolved against the vocabulary, all sets of a cohort in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ConceptSet
from ..sources.cdm import Cdm


def codesets(cdm: Cdm, concept_sets: tuple[ConceptSet, ...]) -> DataFrame:
    """(codeset_id, concept_id) of all concept sets, distinct.

    An item stands for the named concept, if it exists, for its valid descendants, and for source concepts mapped to
    either; what a set's excluded items stand for goes from it. The items come with the expression, so they are
    broadcast and the vocabulary tables are scanned without a shuffle.
    """
    rows = [
        (n, s.id, i.concept.concept_id, bool(i.is_excluded), bool(i.include_descendants), bool(i.include_mapped))
        for n, s in enumerate(concept_sets) if any(not i.is_excluded for i in s.items) for i in s.items if i.concept.concept_id is not None
    ]
    if not rows:
        return cdm.spark.createDataFrame([], "codeset_id int, concept_id long")
    named = F.broadcast(cdm.spark.createDataFrame(rows, "n int, codeset_id int, concept_id long, excluded boolean, below boolean, mapped boolean"))
    columns, concept = ["n", "codeset_id", "concept_id", "excluded", "mapped"], cdm.table("concept")
    found = concept.select("concept_id").join(named, "concept_id").select(columns)
    if any(r[4] for r in rows):
        below = cdm.table("concept_ancestor").select(F.col("ancestor_concept_id").alias("concept_id"), "descendant_concept_id").join(named.filter("below"), "concept_id")
        below = below.withColumn("concept_id", F.col("descendant_concept_id")).select(columns)
        found = found.unionByName(below.join(concept.filter("invalid_reason is null").select("concept_id"), "concept_id", "left_semi").select(columns))
    if any(r[5] for r in rows):
        targets = found.filter("mapped").withColumnRenamed("concept_id", "concept_id_2").distinct()
        links = cdm.table("concept_relationship").filter("relationship_id = 'Maps to' and invalid_reason is null").select("concept_id_2", F.col("concept_id_1").alias("concept_id"))
        found = found.unionByName(links.join(targets, "concept_id_2").select(columns))
    kept = found.groupBy("n", "codeset_id", "concept_id").agg(F.max("excluded").alias("excluded")).filter("not excluded")
    return kept.select("codeset_id", "concept_id").distinct()


def resolve(cdm: Cdm, concept_set: ConceptSet) -> DataFrame:
    """concept_id of one concept set."""
    return codesets(cdm, (concept_set,)).select("concept_id")
