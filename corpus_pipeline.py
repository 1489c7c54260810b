"""The corpus pipeline: filters, deduplicates, decontaminates, mixes and shards documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linelens.llm import decontam, mixing, sharding, simhash, toxicity
from linelens.llm.common import Scratch, table
from linelens.llm.queries import N_SHARDS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among docs."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels")).keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too many words of benchmark passages go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: some not at all, some up to three times."""
    return mixing.take(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, beside its columns."""
    return sharding.assign_shards(docs, N_SHARDS, carry=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("shards", shard),
]
#: The first stage learns a classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's result is written and read again.

    Null and empty texts pass the filters (as copies of each other) and are never mixed in;
    null ids are ids like any others. Repeated rows are copies, of which one stays. Empty
    tables give an empty result with the same columns; other columns come along, and
    those that have the name of a column of the last stage are renamed there.
    """
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
