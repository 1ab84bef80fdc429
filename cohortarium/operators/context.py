"""What operators share while one cohort is planned: tables and resolved concept sets.

Concept sets are resolved once a cohort. Sets that together hold KNOWN concepts or fewer come to the driver; a
criterion then filters by its concepts themselves (up to LITERAL of them, which reach the scan) or by a broadcast of
proven size, and never shuffles a fact table on its concept column. Larger ones stay a stored table that is joined.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ConceptSet
from ..sources.cdm import Cdm
from .vocabulary import codesets

#: Concepts of all sets that the driver takes, at most; concepts of a set that become a filter, at most.
KNOWN, LITERAL = 200_000, 2_000


class Context:
    def __init__(self, cdm: Cdm, concept_sets: tuple[ConceptSet, ...], known: int = KNOWN, literal: int = LITERAL):
        self.cdm, self.concept_sets, self.known, self.literal = cdm, concept_sets, known, literal
        #: Stored DataFrames of the run.
        self.kept: list[DataFrame] = []

    @cached_property
    def codesets(self) -> DataFrame:
        """codeset_id, concept_id, distinct."""
        return self.keep(codesets(self.cdm, self.concept_sets))

    @cached_property
    def members(self) -> dict[int, list[int]] | None:
        """The concepts by set, or None if there are more than ``known``."""
        rows = self.codesets.limit(self.known + 1).collect() if self.concept_sets else []  # known + 1 rows at most
        if len(rows) > self.known:
            return None
        out = defaultdict(list)
        for r in rows:
            out[r["codeset_id"]].append(r["concept_id"])
        return {k: sorted(v) for k, v in out.items()}

    def keep(self, rows: DataFrame) -> DataFrame:
        self.kept.append(rows.cache())
        return rows

    def release(self) -> None:
        """Gives what is stored back."""
        while self.kept:
            self.kept.pop().unpersist()

    def is_in(self, column: str, codeset_id: int) -> Column | None:
        """Whether a concept is in the set, where the set is small enough for a filter; a null isn't."""
        if self.members is None or len(found := self.members.get(codeset_id, [])) > self.literal:
            return None
        return F.col(column).isNotNull() & F.col(column).isin(found) if found else F.lit(False)

    def codeset(self, codeset_id: int) -> DataFrame:
        """concept_id of a set; broadcast if its size is known."""
        if self.members is None:
            return self.codesets.filter(F.col("codeset_id") == codeset_id).select("concept_id")
        return F.broadcast(self.cdm.spark.createDataFrame([(x,) for x in self.members.get(codeset_id, [])], "concept_id long"))

    def keep_in(self, rows: DataFrame, column: str, codeset_id: int | None, exclude: bool = False) -> DataFrame:
        """Rows whose concept is in the concept set. Excluded: not in it, and a null never passes a set with concepts."""
        if codeset_id is None:
            return rows
        if self.members is not None and not self.members.get(codeset_id):
            return rows if exclude else rows.filter(F.lit(False))
        if (inside := self.is_in(column, codeset_id)) is not None:
            return rows.filter(F.col(column).isNotNull() & ~inside if exclude else inside)
        found = self.codeset(codeset_id).withColumnRenamed("concept_id", "_c")
        if not exclude:
            return rows.join(found, rows[column] == found["_c"], "left_semi")
        rest = rows.join(found, rows[column] == found["_c"], "left_anti")
        return rest if self.members is None and found.isEmpty() else rest.filter(F.col(column).isNotNull())
