"""Looking into an index: manifest, shards, integrity, n-gram report, workloads."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import BLOCK
from ..functions.text import prefixes, workload_lines
from ..operators import postings as P
from .index import Index


def inspect_config(index: Index) -> DataFrame:
    return index.spark.read.json(f"{index.path}/manifest")


def inspect_shards(index: Index, shard: int | None = None) -> DataFrame:
    """Keys and sizes of each shard of the postings, or of one."""
    return shard_summary(index.postings if shard is None else index.postings.where(F.col("shard") == shard))


def shard_summary(postings: DataFrame) -> DataFrame:
    per = postings.groupBy("shard").agg(
        F.count(F.lit(1)).alias("num_keys"), F.hex(F.min("ngram")).alias("min_key"), F.hex(F.max("ngram")).alias("max_key"),
        F.sum("n").alias("num_values"), F.max("n").alias("longest_list"),
    )
    return per.join(P.shard_sizes(postings).select("shard", "estimated_bytes"), "shard")


def fsck(index: Index, *, most_value_bytes: int = 16 << 20) -> DataFrame:
    """(check, violations) of the index's rules; all are zero in a sound one."""
    lines, postings, counts, files = index.lines, index.postings, index.ngram_counts, index.files
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    out = one(order_violations(lines), "lines in order")
    for more in (
        one(lines.groupBy("line_id").count().where("count > 1"), "line ids unique"),
        one(lines.where(F.octet_length("line") >= most_value_bytes), "values below the size limit"),
        one(lines.join(files, "file_id", "left_anti"), "lines have files"),
        one(postings.where(~F.col("line_ids").eqNullSafe(F.array_sort(F.array_distinct("line_ids"))) | (F.col("n") != F.size("line_ids"))), "postings sorted and distinct"),
        one(postings.where(F.octet_length("ngram") != index.manifest.ngram_size), "n-grams of one size"),
        one(P.counts_of_postings(postings).withColumnRenamed("count", "n").join(counts, "ngram", "full").where(~F.col("n").eqNullSafe(F.col("count"))), "counts agree with postings"),
        one(lines.agg(F.count(F.lit(1)).alias("n"), F.max("line_id").alias("m")).where((F.col("n") > 0) & (F.col("m") + 1 != F.col("n"))), "line ids dense"),
    ):
        out = out.unionByName(more)
    return out


def order_violations(lines: DataFrame) -> DataFrame:
    """Lines whose (file, line number) isn't behind that of the id before; compared in blocks of ids and at their borders."""
    block = F.floor(F.col("line_id") / BLOCK)
    key = F.struct("file_id", "file_line")
    inside = lines.withColumn("__k", key).withColumn("__b", block)
    w = Window.partitionBy("__b").orderBy("line_id")
    bad = inside.withColumn("__before", F.lag("__k").over(w)).where(F.col("__before") >= F.col("__k")).select("line_id")
    ends = inside.groupBy("__b").agg(F.min(F.struct("line_id", "__k")).alias("lo"), F.max(F.struct("line_id", "__k")).alias("hi"))
    at_borders = ends.withColumn("__before", F.lag("hi.__k").over(Window.orderBy("__b"))).where(F.col("__before") >= F.col("lo.__k")).select(F.col("lo.line_id").alias("line_id"))
    return bad.unionByName(at_borders)


def workload(queries: DataFrame) -> DataFrame:
    """(query_id, query): all beginnings of the queries of a file's lines (column value)."""
    kept = queries.where(workload_lines(F.col("value")))
    each = kept.select(F.posexplode(prefixes(F.col("value"))).alias("pos", "query"), "value")
    return each.select(F.xxhash64("value", "pos").alias("query_id"), "query").distinct()


def prefixes_of(terms: list[str]) -> Iterator[str]:
    for t in terms:
        if t and not t.startswith("#"):
            for n in range(1, len(t) + 1):
                yield t[:n]


def bench(spark: SparkSession, index: Index, terms: list[str], *, limit: int = 10, within_file: int = 10) -> dict[str, float]:
    """Run the workload of all beginnings as one batch: searches, seconds, queries a second."""
    from .search import search_many

    own = list(prefixes_of(terms))
    queries = spark.createDataFrame(list(enumerate(own)), "query_id long, query string")
    began = time.perf_counter()
    n = search_many(index, queries, limit=limit, within_file=within_file).count()
    took = time.perf_counter() - began
    return {"searches": len(own), "matches": n, "seconds": took, "ms_per_query": 1000 * took / max(1, len(own)), "queries_per_second": len(own) / took}


def bench_clients(index: Index, terms: list[str], *, clients: int = 1, iterations: int | None = None, limit: int = 10, within_file: int = 10) -> dict[str, float]:
    """Single searches by several clients at once, over and over through the workload: searches, ms of one, queries a second."""
    from ..schema import SearchRequest
    from .search import search_matches

    own = list(prefixes_of(terms))
    n = len(own) if iterations is None else iterations
    runs: list[tuple[int, float]] = []

    def run(k: int) -> None:
        began, done = time.perf_counter(), 0
        for i in range(k, n, clients):
            search_matches(index, SearchRequest(own[i % len(own)], limit, within_file)).count()
            done += 1
        runs.append((done, 1000 * (time.perf_counter() - began)))

    threads = [threading.Thread(target=run, args=(k,)) for k in range(clients)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return bench_summary(index.spark.createDataFrame(runs, "n long, ms double")).first().asDict()


def bench_summary(runs: DataFrame) -> DataFrame:
    """(searches, ms_per_query, queries_per_second) of runs (n, ms) by several clients at once."""
    return runs.agg(F.sum("n").cast("bigint").alias("searches"), (F.sum("ms") / F.sum("n")).alias("ms_per_query"), (1000.0 * F.sum("n") / F.max("ms")).alias("queries_per_second"))
