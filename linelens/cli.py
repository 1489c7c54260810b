"""Command line: python -m linelens.cli index|search|stats|fsck|inspect|serve|bench ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import results as R
from .plans import tools
from .plans.index import build_tree_index, open_index
from .plans.search import search, search_matches
from .plans.server import load_test, make_server
from .plans.service import Service
from .schema import SearchRequest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linelens")
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("index", help="index source trees")
    build.add_argument("src_dir", nargs="+")
    build.add_argument("--db-path", required=True)
    build.add_argument("--preserve", action="store_true", help="don't replace an index")
    build.add_argument("--ngram-size", type=int, default=3)
    build.add_argument("--shard-lines", type=int, default=1 << 15)
    find = sub.add_parser("search", help="search an index")
    find.add_argument("query")
    find.add_argument("--db-path", required=True)
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--within-file-limit", type=int, default=10)
    find.add_argument("--offset", type=int, default=0)
    find.add_argument("--no-print", action="store_true", help="print the number of results only")
    find.add_argument("--color", action="store_true")
    for name in ("stats", "fsck", "inspect", "serve", "bench"):
        sub.add_parser(name).add_argument("--db-path", required=True)
    sub.choices["inspect"].add_argument("--shard", type=int, help="one shard only")
    sub.choices["serve"].add_argument("--host", default="127.0.0.1")
    sub.choices["serve"].add_argument("--port", type=int, default=8080)
    sub.choices["bench"].add_argument("queries", help="a file with a term on each line; # begins a comment")
    sub.choices["bench"].add_argument("--clients", type=int, default=1)
    sub.choices["bench"].add_argument("--iterations", type=int, help="searches; by default each beginning once")
    sub.choices["bench"].add_argument("--url", help="load this server instead of the index itself")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("linelens").getOrCreate()
    if args.command == "index":
        built = build_tree_index(spark, args.src_dir, args.db_path, preserve=args.preserve, lines_per_shard=args.shard_lines, size=args.ngram_size)
        print(f"{built.manifest.n_files} files, {built.manifest.n_lines} lines, {built.manifest.n_ngrams} n-grams")
        return 0
    index = open_index(spark, args.db_path)
    if args.command == "search":
        request = SearchRequest(args.query, args.limit, args.within_file_limit, args.offset)
        if args.no_print:
            print(f"{R.result_count(search_matches(index, request)).first()['n_files']} search results")
            return 0
        shown = search(index, request).select("file_id", F.col("line_num").alias("file_line"), F.col("line_text").alias("line"), "is_matched_line")
        # The limits bound what is shown.
        for row in R.text_output(shown, index.files, args.query, color=args.color).orderBy("file_id", "seq").collect():
            print(row["out"])
    elif args.command == "stats":
        for row in report_rows(index):
            print(f"{row['shown']} {row['count']} {row['percent']:.4f} {row['running_percent']:.4f}")
    elif args.command == "fsck":
        rows = tools.fsck(index).collect()
        for row in rows:
            print(row["check"], row["violations"])
        return int(any(r["violations"] for r in rows))
    elif args.command == "serve":
        make_server(Service(index.warm()), args.host, args.port).serve_forever()
    elif args.command == "bench":
        with open(args.queries, encoding="utf-8") as f:
            terms = f.read().splitlines()
        if args.url:
            for r in load_test(args.url, terms, clients=args.clients):
                print(f"{r['query']}\t{r['status']}\t{r['num_results']}\t{r['ms']:.0f} ms")
        else:
            got = tools.bench_clients(index.warm(), terms, clients=args.clients, iterations=args.iterations)
            print(f"{got['searches']} searches, {got['ms_per_query']:.2f} ms per query, {got['queries_per_second']:.2f} queries per second")
    else:
        tools.inspect_config(index).show(truncate=False)
        tools.inspect_shards(index, args.shard).orderBy("shard").show(truncate=False)
    return 0


def report_rows(index):
    """The n-gram report row by row, in order of rank."""
    from .operators.postings import report

    return report(index.ngram_counts).orderBy("rank").toLocalIterator()


if __name__ == "__main__":
    sys.exit(main())
