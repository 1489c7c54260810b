"""Corpora as (file_id, directory, filename, lang, content): tables of texts, seen as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language

COLUMNS = ["file_id", "directory", "filename", "lang", "content"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """A file for each document, in a directory for each source."""
    source = F.coalesce("source", F.lit(""))
    return df.select(F.col("doc_id").alias("file_id"), source.alias("directory"), F.concat(source, F.lit("/"), F.col("doc_id")).alias("filename"), F.lit("").alias("lang"), F.col("text").alias("content"))


def pages(df: DataFrame) -> DataFrame:
    """A file for each page, in its host's directory, with the language of its path's extension."""
    path = F.regexp_replace(F.coalesce("url", F.lit("")), "[?#].*$", "")
    host = F.regexp_extract(path, "^[a-z]+://([^/]*)", 1)
    return df.select(F.col("page_id").alias("file_id"), host.alias("directory"), path.alias("filename"), language(path).alias("lang"), F.col("html").alias("content"))


def conversations(df: DataFrame) -> DataFrame:
    """A file for each conversation; its turns are its lines, each with its line ends as spaces."""
    turn = F.struct("turn", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("text"))
    whole = df.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return whole.select(F.col("conv_id").alias("file_id"), F.lit("conversations").alias("directory"), F.concat(F.lit("conversations/"), F.col("conv_id")).alias("filename"), F.lit("").alias("lang"), F.array_join(F.col("t.text"), "\n").alias("content"))


def benchmark(df: DataFrame) -> DataFrame:
    return df.select(F.col("item_id").alias("file_id"), F.lit("benchmark").alias("directory"), F.concat(F.lit("benchmark/"), F.col("item_id")).alias("filename"), F.lit("").alias("lang"), F.col("text").alias("content"))


ADAPTERS = {"documents": documents, "pages": pages, "conversations": conversations, "benchmark": benchmark}


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table that comes in fewer partitions than there are cores; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return ADAPTERS[name](spread(table(spark, sf_dir, name)))
