"""Files to lines with ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import dense_ids, running_start
from ..functions.text import lenient_utf8, split_lines

Keep = Callable[[DataFrame], DataFrame]


def number_files(files: DataFrame, keep: Keep) -> DataFrame:
    """Add file_id, dense from 0 in the order of (path, directory, filename)."""
    return dense_ids(files, ["path", "directory", "filename"], "file_id", keep)


def explode_text(corpus: DataFrame) -> DataFrame:
    """(file_id, file_line, line) of a corpus with string content; null content has no lines."""
    return corpus.select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).select("file_id", (F.col("pos") + 1).cast("bigint").alias("file_line"), "line")


def lines_of_text(corpus: DataFrame) -> DataFrame:
    """(file_id, file_line, phys_line, file_offset, line) of a corpus with string content."""
    return _offsets(explode_text(corpus).withColumn("phys_line", F.col("file_line")))


def lines_of_bytes(files: DataFrame, *, allow_null: bool = False) -> DataFrame:
    """The same of binary content. Lines that aren't valid are left out: they take up bytes, but no line number."""
    each = files.select("file_id", F.posexplode(split_lines(F.col("content"))).alias("pos", "__bytes"))
    each = each.select("file_id", (F.col("pos") + 1).cast("bigint").alias("phys_line"), "__bytes", lenient_utf8(F.col("__bytes"), allow_null=allow_null).alias("__valid"))
    order = Window.partitionBy("file_id").orderBy("phys_line")
    each = each.withColumn("file_line", F.sum(F.col("__valid").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = _offsets(each.withColumn("line", F.col("__bytes").cast("string")), F.octet_length("__bytes"))
    return each.where("__valid").select("file_id", "file_line", "phys_line", "file_offset", "line")


def _offsets(lines: DataFrame, size=None) -> DataFrame:
    """Add the byte at which each line starts."""
    before = Window.partitionBy("file_id").orderBy("phys_line").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("line") if size is None else size
    return lines.withColumn("file_offset", F.coalesce(F.sum(size + 1).over(before), F.lit(0)).cast("bigint"))


def counts_of_text(corpus: DataFrame) -> DataFrame:
    """(file_id, n): lines of each file, without taking them apart."""
    return corpus.where(F.col("content").isNotNull()).select("file_id", F.size(F.split("content", "\n", -1)).alias("n"))


def with_line_ids(lines: DataFrame, counts: DataFrame | None = None, *, block: int = 1 << 16) -> DataFrame:
    """Add line_id, dense from 0 in the order of (file_id, file_line), by prefix sums of the files' counts.

    `counts` (file_id, n) spares counting the lines.
    """
    counts = counts if counts is not None else lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = running_start(counts, "file_id", F.col("n"), "__first", block=block).select("file_id", "__first")
    return lines.join(firsts, "file_id").withColumn("line_id", F.col("__first") + F.col("file_line") - 1).drop("__first")


def file_start_lines(lines: DataFrame) -> DataFrame:
    """(file_id, first_line)."""
    return lines.groupBy("file_id").agg(F.min("line_id").alias("first_line"))


def rebuild(lines: DataFrame) -> DataFrame:
    """(file_id, content) from lines."""
    one = F.struct("file_line", "line")
    return lines.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["line"]), "\n").alias("content"))


def asof_file(points: DataFrame, start_lines: DataFrame, *, point_col: str = "line_id") -> DataFrame:
    """Add the file with the greatest first line that isn't behind a point; past the end it is the last file.

    Starts and points are put in one order and the last start is carried on, by blocks
    of ids, with the last start before each block found over the blocks alone.
    """
    block = 1 << 16
    events = start_lines.select(F.col("first_line").alias("__at"), F.col("file_id").alias("__file"), F.lit(0).alias("__kind")).unionByName(
        points.select(F.col(point_col).alias("__at"), F.lit(None).cast("bigint").alias("__file"), F.lit(1).alias("__kind"))
    )
    events = events.withColumn("__block", F.floor(F.col("__at") / block))
    last = events.groupBy("__block").agg(F.max(F.when(F.col("__file").isNotNull(), F.struct("__at", "__file"))).alias("__last"))
    carried = last.select("__block", F.last("__last", ignorenulls=True).over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    inside = Window.partitionBy("__block").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("__own", F.last("__file", ignorenulls=True).over(inside)).join(carried, "__block")
    return found.where("__kind = 1").select(F.col("__at").alias(point_col), F.coalesce("__own", "__carry.__file").alias("file_id"))
