"""Lines and n-gram counts of texts as they come, in small batches.

Each batch is written under its number, so that a batch that runs again replaces what
it wrote: every text is counted once. `compact` merges the batches into an index, which is
what can be searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from ..operators import lines as L
from ..operators import postings as P
from ..plans.index import Index, build_lines_index


def ingest(corpus: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start to write lines and counts of a streaming corpus (file_id, content) under path."""

    def batch(df: DataFrame, number: int) -> None:
        lines = L.lines_of_text(df)
        lines.write.mode("overwrite").parquet(f"{path}/lines/batch={number}")
        P.ngram_counts(lines).write.mode("overwrite").parquet(f"{path}/ngram_counts/batch={number}")

    return corpus.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/lines")


def merged_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/ngram_counts").groupBy("ngram").agg(F.sum("count").alias("count"))


def compact(spark: SparkSession, path: str, index_path: str, *, files: DataFrame | None = None, **options) -> Index:
    """Build an index of all lines that have come; a file comes in one batch.

    `files` names them (file_id, directory, filename, lang); by default a file's name is its id.
    """
    lines = merged_lines(spark, path).drop("batch")
    if files is None:
        files = lines.select("file_id").distinct().select("file_id", F.lit("").alias("directory"), F.col("file_id").cast("string").alias("filename"), F.lit("").alias("lang"))
    return build_lines_index(lines, files, index_path, **options)
