"""Matches to results: limits, context, runs of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limit_matches(matches: DataFrame, *, limit: int | None, within_file: int | None, offset: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Of the matches (file_id, file_line), the first of the files with the smallest ids.

    Keeps `limit` files behind `offset` (for each value of `by`, if given) and the first
    `within_file` lines of each. None is no limit, and then nothing is ranked for it.
    """
    first = Window.partitionBy(*by, "file_id").orderBy("file_line")
    if by:
        # Lines first, which leaves a few of each file; then files, of which each task hands on the first ones.
        some = matches if within_file is None else matches.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= within_file)
        if limit is None and not offset:
            return some.drop("__rn")
        ranked = some.withColumn("__r", F.dense_rank().over(Window.partitionBy(*by).orderBy("file_id")))
        ranked = ranked if limit is None else ranked.where(F.col("__r") <= offset + limit)
        return ranked.where(F.col("__r") > offset).drop("__rn", "__r")
    some = matches
    if limit is not None or offset:
        # A global rank would bring all rows to one task; this keeps the best of each.
        kept = matches.select("file_id").distinct().orderBy("file_id").offset(offset)
        some = matches.join(kept if limit is None else kept.limit(limit), "file_id", "left_semi")
    if within_file is None:
        return some
    return some.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= within_file).drop("__rn")


def context(matches: DataFrame, lines: DataFrame, *, around: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Lines within `around` of the matches, once each, with is_matched_line and the flag overwritten_flag.

    Each match gives its neighbours' numbers, which are then looked up by equality.
    overwritten_flag is what a last-writer map would keep: only the last of adjacent
    matches stays marked. The empty line behind a final line end isn't shown.
    """
    near = matches.select(*by, "file_id", F.col("file_line").alias("__match"), F.explode(F.sequence(F.col("file_line") - around, F.col("file_line") + around)).alias("file_line"))
    shown = near.groupBy(*by, "file_id", "file_line").agg(F.max((F.col("__match") == F.col("file_line")).cast("int")).alias("__hit"), F.max("__match").alias("__last"))
    found = shown.join(lines, ["file_id", "file_line"])
    hit = F.col("__hit") == 1
    return found.withColumns({"is_matched_line": hit, "overwritten_flag": hit & (F.col("__last") == F.col("file_line"))}).drop("__hit", "__last")


def without_final_empty(lines: DataFrame) -> DataFrame:
    """Lines but for the empty one that follows a file's final line end."""
    ends = lines.groupBy("file_id").agg(F.max("file_line").alias("__end"))
    return lines.join(ends, "file_id").where(~((F.col("line") == "") & (F.col("file_line") == F.col("__end")) & (F.col("file_line") > 1))).drop("__end")


def islands(shown: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Add island: the number, from 1 in each file, of the run of consecutive lines that a line is in."""
    w = Window.partitionBy(*by, "file_id").orderBy("file_line")
    breaks = shown.withColumn("__new", (F.lag("file_line").over(w).isNull() | (F.col("file_line") != F.lag("file_line").over(w) + 1)).cast("int"))
    return breaks.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def island_ranges(shown: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    marked = islands(shown, by=by)
    return marked.groupBy(*by, "file_id", "island").agg(F.min("file_line").alias("first_line"), F.max("file_line").alias("last_line"), F.sum(F.col("is_matched_line").cast("bigint")).alias("n_matches"))


def nested(shown: DataFrame, files: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, filename, lang, lines array<struct<line_num, line_text, is_matched_line>>), a row for each file."""
    one = F.struct(F.col("file_line").alias("line_num"), F.col("line").alias("line_text"), "is_matched_line")
    per = shown.groupBy(*by, "file_id").agg(F.sort_array(F.collect_list(one)).alias("lines"))
    return per.join(files.select("file_id", "filename", "lang"), "file_id").select(*by, "file_id", "filename", "lang", "lines")


def result_count(matches: DataFrame) -> DataFrame:
    """Numbers of files with matches and of matches."""
    return matches.agg(F.countDistinct("file_id").alias("n_files"), F.count(F.lit(1)).alias("n_matches"))


def overflow(matches: DataFrame, limit: int) -> DataFrame:
    """(n_shown, overflow): whether there are more files than `limit`; at most one more is looked for."""
    some = matches.select("file_id").distinct().limit(limit + 1)
    n = some.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(limit)).cast("bigint").alias("n_shown"), (F.col("n") > limit).alias("overflow"))


def text_output(shown: DataFrame, files: DataFrame, query: str, *, color: bool = False) -> DataFrame:
    """Terminal lines, in order of (file_id, seq): header, underline, marked lines, dots between runs."""
    from ..functions.text import highlight_ansi

    marked = islands(shown).join(files.select("file_id", "filename"), "file_id")
    text: Column = highlight_ansi(F.col("line"), query, F.col("is_matched_line")) if color else F.col("line")
    body = marked.select("file_id", (F.col("file_line") * 2 + 1).alias("seq"), F.concat(F.when(F.col("is_matched_line"), "* ").otherwise("  "), text).alias("out"))
    first = marked.groupBy("file_id", "filename", "island").agg(F.min("file_line").alias("at"))
    dots = first.where("island > 1").select("file_id", (F.col("at") * 2).alias("seq"), F.lit("........").alias("out"))
    heads = first.where("island = 1").select("file_id", F.explode(F.array(F.struct(F.lit(-1).cast("bigint").alias("seq"), F.col("filename").alias("out")), F.struct(F.lit(0).cast("bigint").alias("seq"), F.repeat(F.lit("-"), F.length("filename")).alias("out")))).alias("h")).select("file_id", "h.seq", "h.out")
    return body.unionByName(dots).unionByName(heads)
