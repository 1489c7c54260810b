"""n-grams of lines: postings, counts and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ngrams import SIZE, trigrams
from ..functions.text import printable

#: Lines of a shard, at most 2**LINE_BITS.
LINES_PER_SHARD, LINE_BITS = 1 << 15, 31


def ngram_rows(lines: DataFrame, *, size: int = SIZE, keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """(ngram, ...) once for each line that has it."""
    return lines.select(*keep, F.explode(trigrams(F.col("line"), size)).alias("ngram"))


def ngram_counts(lines: DataFrame, *, size: int = SIZE) -> DataFrame:
    """(ngram, count): lines that have each n-gram."""
    return ngram_rows(lines, size=size, keep=()).groupBy("ngram").agg(F.count(F.lit(1)).alias("count"))


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total_count"), F.count(F.lit(1)).alias("total_ngrams"))


def postings(lines: DataFrame, *, lines_per_shard: int = LINES_PER_SHARD, size: int = SIZE) -> DataFrame:
    """(shard, ngram, n, line_ids sorted) by a group aggregate over all (line, n-gram) pairs."""
    rows = ngram_rows(lines, size=size).select(F.floor(F.col("line_id") / lines_per_shard).alias("shard"), "ngram", "line_id")
    return rows.groupBy("shard", "ngram").agg(F.sort_array(F.collect_list("line_id")).alias("line_ids")).select("shard", "ngram", F.size("line_ids").cast("bigint").alias("n"), "line_ids")


def build_postings(lines: DataFrame, *, lines_per_shard: int = LINES_PER_SHARD, size: int = SIZE) -> DataFrame:
    """The same, a shard at a time and without shuffling pairs: only the lines are dealt out, by shard.

    A shard holds a range of lines, so its lists can be made where its lines are, by
    sorting numbers that stand for (n-gram, line). Rows come in the order of shard, then n-gram.
    """
    if not 1 <= size <= 4:
        raise ValueError("n-grams of one to four bytes")
    dealt = lines.select(F.floor(F.col("line_id") / lines_per_shard).alias("shard"), "line_id", "line").repartition("shard").sortWithinPartitions("shard", "line_id")

    def emit(shard: int, parts: list[np.ndarray], first: int) -> pa.RecordBatch:
        pairs = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        codes = pairs >> LINE_BITS
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
        offsets = np.append(starts, len(pairs)).astype(np.int32)
        ids = (pairs & ((1 << LINE_BITS) - 1)) + first
        grams = codes[starts].astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - size :]
        binary = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.arange(len(starts) + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(grams).tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), shard, np.int64)), binary, pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["shard", "ngram", "n", "line_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shards[a] != shard:
                    if parts:
                        yield emit(shard, parts, shard * lines_per_shard)
                    shard, parts = int(shards[a]), []
                parts += pairs_of(batch.column(1).slice(a, b - a).to_numpy() - shard * lines_per_shard, batch.column(2).slice(a, b - a), size)
        if parts:
            yield emit(shard, parts, shard * lines_per_shard)

    return dealt.mapInArrow(run, "shard bigint, ngram binary, n bigint, line_ids array<bigint>")


def pairs_of(places: np.ndarray, lines: pa.Array, size: int, chunk: int = 4 << 20) -> list[np.ndarray]:
    """Distinct (n-gram, line) pairs as numbers, for runs of lines of about `chunk` bytes."""
    texts = lines.cast(pa.binary()).to_pylist()
    out, start, held = [], 0, 0
    for i, text in enumerate(texts):
        held += len(text or b"")
        if held < chunk and i + 1 < len(texts):
            continue
        own = [t or b"" for t in texts[start : i + 1]]
        data = np.frombuffer(b"".join(own), np.uint8).astype(np.int64)
        lengths = np.array([len(t) for t in own])
        n = len(data) - size + 1
        if n > 0:
            code = data[:n].copy()
            for k in range(1, size):
                code = (code << 8) | data[k : n + k]
            line = np.repeat(places[start : i + 1], lengths)
            # A window has to end in the line in which it starts.
            same = np.repeat(np.arange(len(own)), lengths)
            whole = same[:n] == same[size - 1 :]
            out.append(np.unique((code[whole] << LINE_BITS) | line[:n][whole]))
        start, held = i + 1, 0
    return out


def counts_of_postings(found: DataFrame) -> DataFrame:
    return found.groupBy("ngram").agg(F.sum("n").alias("count"))


def shard_sizes(found: DataFrame) -> DataFrame:
    """Bytes that each shard would have as a buffer, by the estimate that triggers a new one."""
    per = found.groupBy("shard").agg(F.count(F.lit(1)).alias("n_ngrams"), F.sum("n").alias("n_values"))
    return per.withColumn("estimated_bytes", F.floor(F.lit(16) + 16 * F.col("n_ngrams") + 8 * F.col("n_values") / 6))


def report(counts: DataFrame) -> DataFrame:
    """n-grams by falling count, ties by bytes: rank, shown form, share and running share in percent.

    Counts are grouped before the running sums: those go over distinct counts only, and
    ranks inside a count come from a window of that count, in two levels.
    """
    by_count = counts.groupBy("count").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = by_count.select("count", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"), F.coalesce(F.sum(F.col("__n") * F.col("count")).over(ahead), F.lit(0)).alias("__sum"), F.sum(F.col("__n") * F.col("count")).over(whole).alias("__all"))
    # n-grams of one count, by their first byte.
    first = F.substring("ngram", 1, 1)
    cells = counts.groupBy("count", first.alias("__first")).agg(F.count(F.lit(1)).alias("__n"))
    cells = cells.select("count", "__first", F.coalesce(F.sum("__n").over(Window.partitionBy("count").orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("count", "__first").orderBy("ngram")
    ranked = counts.withColumn("__first", first).withColumn("__rn", F.row_number().over(inside)).join(cells, ["count", "__first"]).join(steps, "count")
    place = F.col("__before") + F.col("__rn")
    return ranked.select(
        (F.col("__ahead") + place).cast("bigint").alias("rank"), "ngram", printable(F.col("ngram")).alias("shown"), "count",
        (100.0 * F.col("count") / F.col("__all")).alias("percent"), (100.0 * (F.col("__sum") + place * F.col("count")) / F.col("__all")).alias("running_percent"),
    )


def fragment_ngrams(counts: DataFrame, fragment: str | bytes) -> DataFrame:
    """n-grams that have a fragment of one or two bytes, most frequent first."""
    b = fragment.encode() if isinstance(fragment, str) else fragment
    return counts.where(F.contains("ngram", F.lit(b))).orderBy(F.desc("count"), "ngram")


def intersect(found: DataFrame, ngrams: list[bytes]) -> DataFrame:
    """(line_id) of the lines that have all n-grams: each shard's lists meet by themselves."""
    wanted = found.where(F.col("ngram").isin(*[bytearray(g) for g in ngrams]))
    lists = wanted.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("n", F.col("line_ids").alias("ids")))).alias("l")).where(F.size("l") == len(ngrams))
    # Shortest first, as then least is carried on.
    both = F.aggregate(F.slice("l", F.lit(2), F.size("l")), F.col("l")[0]["ids"], lambda acc, x: F.array_intersect(acc, x["ids"]))
    return lists.select(F.explode(both).alias("line_id"))

