"""Planning and running literal searches.

A query of three bytes or more is answered by its rarest n-grams: their counts, a few
rows, are looked up first; if one is missing nothing matches. The lists of the
rarest meet shard by shard, and the lines that are left are read by their ids and
tested for the whole query. If even the rarest is common, a scan of the lines is cheaper and is taken.
Shorter queries go through the n-grams that contain them, so that lines under three
bytes are never found.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ngrams import as_bytes, query_trigrams, trigrams
from ..operators import postings as P
from ..operators import results as R
from ..schema import SearchRequest
from ..storage import shared_dir
from .index import Index, few_ranges

#: n-grams whose lists are joined, and the share of all lines from which on a scan is taken.
RAREST, SCAN_SHARE = 3, 0.1
#: Files up to which the first lines are tried by themselves, and line ids that the driver turns into ranges at most.
MOST_PROBED, MOST_IDS = 10_000, 10_000
IDS = ("line_id", "file_id", "file_line")
#: Queries up to which a batch is planned on the driver, and lines of a shard for each file wanted from which on a query is frequent.
MOST_PLANNED, FREQUENT = 10_000, 4


@dataclass(frozen=True)
class Plan:
    """How a query will be run: 'empty', 'scan', 'ngrams' or 'fragment'."""

    kind: str
    query: str
    ngrams: tuple[bytes, ...] = ()


def make_plan(index: Index, query: str, *, rarest: int = RAREST, scan_share: float = SCAN_SHARE) -> Plan:
    grams = query_trigrams(query, index.manifest.ngram_size)
    if not grams:
        return Plan("fragment", query)
    # A row for each n-gram of the query.
    counts = {bytes(r["ngram"]): r["count"] for r in index.ngram_counts.where(F.col("ngram").isin(*[bytearray(g) for g in grams])).collect()}
    if len(counts) < len(grams):
        return Plan("empty", query)
    order = sorted(grams, key=lambda g: (counts[g], g))
    if counts[order[0]] >= scan_share * index.manifest.n_lines:
        return Plan("scan", query)
    return Plan("ngrams", query, tuple(order[:rarest]))


def matching_lines(index: Index, query: str, *, plan: Plan | None = None, short_lines: bool = False) -> DataFrame:
    """(line_id, file_id, file_line, line) of all lines that contain the query, byte for byte.

    `short_lines` lets queries of one or two bytes find lines under three bytes too.
    """
    plan = plan or make_plan(index, query)
    lines = index.lines.select("line_id", "file_id", "file_line", "line")
    holds = F.contains("line", F.lit(query))
    if plan.kind == "empty":
        return lines.where(F.lit(False))
    if plan.kind == "scan":
        return lines.where(holds)
    if plan.kind == "ngrams":
        candidates = P.intersect(index.postings, list(plan.ngrams))
        ids = [r["line_id"] for r in candidates.limit(MOST_IDS + 1).collect()]
        if len(ids) <= MOST_IDS:
            # Few row groups are read; the ids in them are tested like the rest.
            return index.lines_in(few_ranges(ids)).select(*lines.columns).where(F.col("line_id").isin(ids) & holds)
        return lines.join(candidates, "line_id", "left_semi").where(holds)
    if short_lines:
        return lines.where(holds)
    if not query:
        return lines.where(F.octet_length("line") >= index.manifest.ngram_size)
    some = index.ngram_counts.where(F.contains("ngram", F.lit(query.encode()))).select("ngram")
    ids = index.postings.join(some, "ngram", "left_semi").select(F.explode("line_ids").alias("line_id")).distinct()
    return lines.join(ids, "line_id", "left_semi").where(holds)


def _first_range(index: Index, hits: DataFrame, files_wanted: int) -> DataFrame:
    """Only the first lines, if they already have more files with hits than are wanted.

    Lines are in the order of file ids, so what lies behind can't be among the first
    files; of the files found the last may go on behind the range, hence one more is
    asked for. Ranges grow by a factor of 16.
    """
    high = index.manifest.lines_per_shard
    while high < index.manifest.n_lines and files_wanted < MOST_PROBED:
        some = hits.where(F.col("line_id") < high)
        if some.select("file_id").distinct().limit(files_wanted + 1).count() > files_wanted:
            return some
        high *= 16
    return hits


def search_matches(index: Index, request: SearchRequest, *, plan: Plan | None = None, short_lines: bool = False) -> DataFrame:
    """The matches that a request's limits leave."""
    plan = plan or make_plan(index, request.query)
    hits = matching_lines(index, request.query, plan=plan, short_lines=short_lines)
    if plan.kind in ("scan", "fragment") and request.limit is not None:
        hits = _first_range(index, hits, request.offset + request.limit)
    return R.limit_matches(hits, limit=request.limit, within_file=request.within_file_limit, offset=request.offset)


def search(index: Index, request: SearchRequest | str, *, around: int = 1, **options) -> DataFrame:
    """Result lines with context, in order of files and lines: file_id, filename, lang, line_num, line_text, is_matched_line, overwritten_flag, island."""
    request = SearchRequest(request) if isinstance(request, str) else request
    found = search_matches(index, request, **options).select(*IDS)
    if None not in (request.limit, request.within_file_limit) and request.limit * request.within_file_limit <= MOST_IDS:
        # A file's lines have consecutive ids: a match's neighbours, and one more to tell a final empty line.
        hits = [tuple(r) for r in found.collect()]
        found = _local(index.spark, hits, **{c: pa.int64() for c in IDS})
        lines = index.lines_in(few_ranges([h[0] for h in hits], around + 1)) if hits else index.lines.where(F.lit(False))
    else:
        lines = index.lines
    # Files with matches are few (the limit), so their lines are taken before anything is grouped.
    own = R.without_final_empty(lines.select("file_id", "file_line", "line").join(found.select("file_id").distinct(), "file_id", "left_semi"))
    shown = R.islands(R.context(found, own, around=around))
    return shown.join(index.files.select("file_id", "filename", "lang"), "file_id").select(
        "file_id", "filename", "lang", F.col("file_line").alias("line_num"), F.col("line").alias("line_text"), "is_matched_line", "overwritten_flag", "island"
    ).orderBy("file_id", "line_num")


def search_nested(index: Index, request: SearchRequest | str, *, around: int = 1) -> DataFrame:
    """A row for each file: file_id, filename, lang, lines."""
    shown = search(index, request, around=around).select("file_id", F.col("line_num").alias("file_line"), F.col("line_text").alias("line"), "is_matched_line")
    return R.nested(shown, index.files)


def search_many(index: Index, queries: DataFrame, *, limit: int | None = 100, within_file: int | None = 10, offset: int = 0, rarest: int = RAREST) -> DataFrame:
    """A batch of (query_id, query): (query_id, query, line_id, file_id, file_line, line), in no order.

    Every query's n-grams are ranked by their counts, the rarest joined with the
    postings, and lines that have all of them tested. Queries that are frequent are
    tried on the first shard: those that find more files there than they want are done,
    so that no list of a frequent n-gram is read whole; the others go through all shards.
    A batch of up to MOST_PLANNED queries is planned on the driver, a larger one in a join.
    """
    queries = queries.where(F.col("query").isNotNull()).select("query_id", "query")
    wanted = MOST_PROBED if limit is None else offset + limit
    limits = {"within_file": within_file, "by": ("query_id",)}
    every = index.manifest.n_shards
    some = queries.limit(MOST_PLANNED + 1).collect()
    if len(some) <= MOST_PLANNED:
        queries = _local(index.spark, [tuple(r) for r in some], query_id=pa.int64(), query=pa.string())
        chosen, short, frequent = _planned(index, [tuple(r) for r in some], rarest, wanted)
    else:
        chosen, short, frequent = _joined(index, queries, rarest), queries.where(F.octet_length("query") < index.manifest.ngram_size), queries.select("query_id")

    def full(kept: DataFrame) -> DataFrame:
        # Lines' texts come last, for what is left.
        return kept.join(index.lines.select("line_id", "line"), "line_id").join(queries, "query_id").select("query_id", "query", *IDS, "line")

    if every <= 1 or wanted >= MOST_PROBED:
        return full(R.limit_matches(_batch(index, queries, chosen, short), limit=limit, offset=offset, **limits))

    path = f"{shared_dir(index.spark)}/linelens/batch-{uuid.uuid4().hex}"
    # One more file than wanted is kept at most, so that this table follows the queries, not the corpus.
    # Frequent queries and short ones in the first shard, the others in all; in one shard short ones are looked for in the lines themselves.
    reach = chosen.join(frequent.withColumn("__shards", F.lit(1)), "query_id", "left").withColumn("__shards", F.coalesce("__shards", F.lit(every)))
    tried = _batch(index, queries, reach, None)
    lines = index.lines.select("line_id", "file_id", "file_line", "line").where(F.col("line_id") < index.manifest.lines_per_shard)
    scanned = lines.where(F.octet_length("line") >= index.manifest.ngram_size).join(short, F.contains("line", F.col("query"))).select("query_id", *IDS)
    R.limit_matches(tried.unionByName(scanned), limit=wanted + 1, **limits).write.parquet(path)
    first = index.spark.read.parquet(path)
    filled = first.groupBy("query_id").agg(F.countDistinct("file_id").alias("n")).where(F.col("n") > wanted).select("query_id")
    unfilled = frequent.join(filled, "query_id", "left_anti")
    done = R.limit_matches(first.join(unfilled, "query_id", "left_anti"), limit=limit, offset=offset, **limits)
    if unfilled.isEmpty():
        return full(done)
    rest = _batch(index, queries, chosen.join(unfilled, "query_id", "left_semi"), short.join(unfilled, "query_id", "left_semi"))
    return full(done.unionByName(R.limit_matches(rest, limit=limit, offset=offset, **limits)))


def _planned(index: Index, rows: list[tuple], rarest: int, wanted: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chosen, short, frequent) of a batch, planned on the driver from the counts of its n-grams."""
    size, spark = index.manifest.ngram_size, index.spark
    grams = {i: query_trigrams(q, size) for i, q in rows}
    own = _local(spark, [(g,) for g in {g for gs in grams.values() for g in gs}], ngram=pa.binary())
    # A row for each different n-gram of the batch.
    counts = {bytes(r["ngram"]): r["count"] for r in index.ngram_counts.join(F.broadcast(own), "ngram").collect()}
    chosen, frequent = [], []
    for i, gs in grams.items():
        if not gs:
            frequent.append((i,))
        elif all(g in counts for g in gs):
            order = sorted(gs, key=lambda g: (counts[g], g))[:rarest]
            chosen += [(i, g, len(order)) for g in order]
            if counts[order[0]] >= FREQUENT * max(1, wanted) * index.manifest.n_shards:
                frequent.append((i,))
    short = [(i, q) for i, q in rows if not grams[i]]
    return _local(spark, chosen, query_id=pa.int64(), ngram=pa.binary(), __k=pa.int64()), _local(spark, short, query_id=pa.int64(), query=pa.string()), _local(spark, frequent, query_id=pa.int64())


def _local(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """Rows that stand in the plan itself, so that Spark knows their size."""
    data = list(zip(*rows)) if rows else [[] for _ in columns]
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(data, columns.values())], names=list(columns)))


def _joined(index: Index, queries: DataFrame, rarest: int) -> DataFrame:
    """chosen of a batch of any size: (query_id, ngram, __k)."""
    size = index.manifest.ngram_size
    grams = queries.where(F.octet_length("query") >= size).select("query_id", F.explode(trigrams(F.col("query"), size)).alias("ngram"))
    # Left join, so that a missing n-gram ends its query.
    known = grams.join(index.ngram_counts, "ngram", "left")
    by_query = Window.partitionBy("query_id")
    ranked = known.withColumns({"__missing": F.max(F.col("count").isNull().cast("int")).over(by_query), "__r": F.row_number().over(by_query.orderBy("count", "ngram")), "__k": F.least(F.count(F.lit(1)).over(by_query), F.lit(rarest))})
    return ranked.where((F.col("__missing") == 0) & (F.col("__r") <= rarest)).select("query_id", "ngram", "__k")


def _batch(index: Index, queries: DataFrame, chosen: DataFrame, short: DataFrame | None) -> DataFrame:
    """All matches of chosen n-grams, in the first __shards shards if that is told, and of short queries."""
    postings, lines = index.postings, index.lines.select("line_id", "file_id", "file_line", "line")
    listed = chosen.join(postings, "ngram")
    if "__shards" in chosen.columns:
        listed = listed.where(F.col("shard") < F.col("__shards"))
    hits = listed.groupBy("query_id", "shard", "__k").agg(F.collect_list("line_ids").alias("l")).where(F.size("l") == F.col("__k"))
    both = F.aggregate(F.slice("l", F.lit(2), F.size("l")), F.col("l")[0], lambda acc, x: F.array_intersect(acc, x))
    candidates = hits.select("query_id", F.explode(both).alias("line_id"))
    if short is not None:
        # Fragments have few forms: 256 ** (n - 1) at most for n-grams of n bytes.
        containing = index.ngram_counts.select("ngram").join(short.select("query").distinct(), F.contains("ngram", as_bytes(F.col("query"))))
        more = containing.join(postings, "ngram").select("query", F.explode("line_ids").alias("line_id")).distinct().join(short, "query").select("query_id", "line_id")
        candidates = candidates.unionByName(more)
    found = candidates.join(lines, "line_id").join(queries, "query_id").where(F.contains("line", F.col("query")))
    return found.select("query_id", *IDS)
