"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

The index is built once; its tables are then cached, and each query runs twice, of which
the shorter time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Their beginnings are the workload, 156 searches.
TERMS = (
    "thing", "ation", "that an", "inger", "entle", "there", "ouing", "edher", "innt", "herea", "onand", "erly", "stha", "with", "réeau", "tion de", "ung der",
    "lichen", "para el", "de la", "which", "ofther", "License", "Apache", "and the r", "rights reserved", "los",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from linelens import catalog
    from linelens.plans import tools
    from linelens.plans.search import search_many

    spark.read.parquet(f"{SF_DIR}/documents.parquet").agg(F.sum(F.octet_length("text"))).collect()
    seconds: dict[str, float] = {}

    def timed(name: str, f):
        best = None
        for _ in range(1 if name == "index_build" else 2):
            began = time.perf_counter()
            out = f()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        return out

    index = timed("index_build", lambda: catalog.index_of(spark, SF_DIR))
    n_lines = index.manifest.n_lines
    index.warm()
    workload = list(tools.prefixes_of(list(TERMS)))
    assert len(workload) == 156
    queries = spark.createDataFrame(list(enumerate(workload)), "query_id long, query string")
    timed("prefix_workload_156", lambda: search_many(index, queries, limit=10, within_file=10).count())
    for name in ("search_indexed", "search_scan", "search_multiword", "search_short_2", "search_no_hits", "context_lines", "ngram_counts", "ngram_report", "benchmark_passages", "batch_search", "rebuild_file", "asof_file"):
        timed(name, lambda name=name: catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1],
        "index_lines_per_second": round(n_lines / seconds["index_build"]), "batch_queries_per_second": round(len(workload) / seconds["prefix_workload_156"], 2),
        "single_query_ms": round(1000 * seconds["search_multiword"]),
    }))


if __name__ == "__main__":
    main()
