"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage works on all that the one before it kept. All but the last give rows with the columns of documents; the
last packs what is left into sequences of token ids. A stage begins with the executors' memory as small as it gets.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cohortarium.llm.common import new_path, shrink_executors
from cohortarium.llm.decontaminate import without_leaks
from cohortarium.llm.jaccard import one_of_each
from cohortarium.llm.packing import pack_documents
from cohortarium.llm.quality import fit, keep_good
from cohortarium.llm.secrets import redact

#: Stages such as the tokenizer can't be said in SQL; the tests compare run() with a plain version.
ORACLE_SQL = None


def shrunk(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, before which the executors give back the memory that the one before it left."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


@shrunk
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the log-likelihood ratio go."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@shrunk
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one of the smallest id stays."""
    return one_of_each(docs, width=5, percent=80)


@shrunk
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@shrunk
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return redact(docs)


@shrunk
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens.

    Workers that have been through the other stages remember fewer chunks, for their memory's sake.
    """
    return pack_documents(docs, remembered=60_000)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
