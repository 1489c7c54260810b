"""The index: Parquet tables and a manifest that is written last."""

from __future__ import annotations

import dataclasses
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ngrams import SIZE
from ..operators import lines as L
from ..operators import postings as P
from ..schema import LINES, Manifest
from ..sources.source_tree import read_tree
from ..storage import delete, empty, exists, shared_dir

TABLES = ("files", "lines", "postings", "ngram_counts", "file_start_lines")
#: Shards in a folder of the lines and in a file there, and ranges of ids that a filter has at most.
FOLDER_SHARDS, FILE_SHARDS, MOST_RANGES = 256, 16, 64


def few_ranges(ids: list[int], around: int = 0, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most `most` ranges (first, last) that hold all ids and `around` more on either side; the smallest gaps are closed."""
    ranges: list[tuple[int, int]] = []
    for i in sorted(set(ids)):
        if ranges and i - around <= ranges[-1][1] + 1:
            ranges[-1] = ranges[-1][0], i + around
        else:
            ranges.append((i - around, i + around))
    gaps = sorted(range(1, len(ranges)), key=lambda k: ranges[k][0] - ranges[k - 1][1], reverse=True)
    cuts = sorted(gaps[: most - 1])
    return [(ranges[a][0], ranges[b - 1][1]) for a, b in zip([0, *cuts], [*cuts, len(ranges)])] if ranges else []


@dataclass
class Index:
    spark: SparkSession
    path: str
    manifest: Manifest

    cached: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name in self.cached:
            return self.cached[name]
        # An index of no lines has no folder to tell the schema from.
        return (self.spark.read.schema(f"{LINES}, folder int") if name == "lines" else self.spark.read).parquet(f"{self.path}/{name}")

    def warm(self) -> Index:
        """Hold the tables in the executors' memory, or on their disks, for many searches."""
        for name in TABLES:
            self.cached[name] = self.table(name).cache()
            self.cached[name].count()
        return self

    def cool(self) -> None:
        for df in self.cached.values():
            df.unpersist()
        self.cached.clear()

    @property
    def files(self) -> DataFrame:
        return self.table("files")

    @property
    def lines(self) -> DataFrame:
        return self.table("lines").drop("folder")

    def lines_in(self, ranges: list[tuple[int, int]]) -> DataFrame:
        """The lines with ids in ranges (first, last): folders by name, then row groups by their smallest and largest ids."""
        per = self.manifest.lines_per_shard * FOLDER_SHARDS
        folders = sorted({f for a, b in ranges for f in range(max(0, a) // per, max(0, b) // per + 1)})
        held = F.lit(False)
        for a, b in ranges:
            held = held | F.col("line_id").between(a, b)
        return self.table("lines").where(F.col("folder").isin(folders) & held).drop("folder")

    @property
    def postings(self) -> DataFrame:
        return self.table("postings")

    @property
    def ngram_counts(self) -> DataFrame:
        return self.table("ngram_counts")

    @property
    def file_start_lines(self) -> DataFrame:
        return self.table("file_start_lines")


def open_index(spark: SparkSession, path: str) -> Index:
    """A built index; one without a manifest isn't complete."""
    if not exists(spark, f"{path}/manifest"):
        raise FileNotFoundError(f"no complete index at {path}")
    row = spark.read.schema("source_root string, ngram_size int, state string, n_files long, n_lines long, n_ngrams long, n_shards long, lines_per_shard long").json(f"{path}/manifest").first()
    return Index(spark, path, Manifest(**row.asDict()))


def _prepare(spark: SparkSession, path: str, preserve: bool) -> None:
    if exists(spark, path):
        if preserve:
            raise FileExistsError(path)
        # Whatever else may be there stays.
        if not empty(spark, path) and not any(exists(spark, f"{path}/{name}") for name in ("manifest", "files")):
            raise FileExistsError(f"{path} is not an index")
        delete(spark, path)


def build_index(corpus: DataFrame, path: str, *, source_root: str = "", preserve: bool = False, lines_per_shard: int = P.LINES_PER_SHARD, size: int = SIZE) -> Index:
    """Index a corpus of (file_id, directory, filename, lang, content string).

    An index that is there is replaced, unless `preserve` is set.
    """
    _prepare(corpus.sparkSession, path, preserve)
    files = corpus.select("file_id", "directory", "filename", "lang", F.lit(None).cast("timestamp").alias("time_indexed"), F.lit(None).cast("timestamp").alias("time_archive"))
    return _write(corpus.sparkSession, files, L.with_line_ids(L.lines_of_text(corpus), L.counts_of_text(corpus)), path, source_root, lines_per_shard, size)


def build_lines_index(lines: DataFrame, files: DataFrame, path: str, *, source_root: str = "", preserve: bool = False, lines_per_shard: int = P.LINES_PER_SHARD, size: int = SIZE) -> Index:
    """Index lines (file_id, file_line, phys_line, file_offset, line) that are there already, of files (file_id, directory, filename, lang)."""
    _prepare(lines.sparkSession, path, preserve)
    files = files.select("file_id", "directory", "filename", "lang", F.lit(None).cast("timestamp").alias("time_indexed"), F.lit(None).cast("timestamp").alias("time_archive"))
    return _write(lines.sparkSession, files, L.with_line_ids(lines), path, source_root, lines_per_shard, size)


def build_tree_index(spark: SparkSession, roots: str | list[str], path: str, *, preserve: bool = False, lines_per_shard: int = P.LINES_PER_SHARD, size: int = SIZE) -> Index:
    """Index source trees: files are numbered in the order of (canonical path, root, name)."""
    _prepare(spark, path, preserve)
    scratch = f"{shared_dir(spark)}/linelens/tree-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        df.write.parquet(scratch)
        return spark.read.parquet(scratch)

    found = L.number_files(read_tree(spark, roots), keep)
    files = found.select("file_id", "directory", "filename", "lang", F.lit(None).cast("timestamp").alias("time_indexed"), F.lit(None).cast("timestamp").alias("time_archive"))
    try:
        return _write(spark, files, L.with_line_ids(L.lines_of_bytes(found)), path, roots if isinstance(roots, str) else roots[0], lines_per_shard, size)
    finally:
        delete(spark, scratch)


def _write(spark: SparkSession, files: DataFrame, lines: DataFrame, path: str, source_root: str, lines_per_shard: int, size: int) -> Index:
    files.write.parquet(f"{path}/files")
    # Folders and files of some shards each, sorted by id, in small row groups: a lookup reads few of them.
    folder = F.floor(F.col("line_id") / (lines_per_shard * FOLDER_SHARDS)).cast("int").alias("folder")
    own = lines.select("line_id", "file_id", "file_offset", "file_line", "phys_line", "line", folder).repartition(F.floor(F.col("line_id") / (lines_per_shard * FILE_SHARDS)))
    own.sortWithinPartitions("folder", "line_id").write.partitionBy("folder").option("parquet.block.size", 1 << 20).parquet(f"{path}/lines")
    lines = spark.read.schema(f"{LINES}, folder int").parquet(f"{path}/lines").drop("folder")
    # Small row groups: a query reads those of its n-grams alone.
    P.build_postings(lines, lines_per_shard=lines_per_shard, size=size).sortWithinPartitions("ngram", "shard").write.option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
    found = spark.read.parquet(f"{path}/postings")
    P.counts_of_postings(found).repartitionByRange("ngram").sortWithinPartitions("ngram").write.parquet(f"{path}/ngram_counts")
    L.file_start_lines(lines).write.parquet(f"{path}/file_start_lines")
    sizes = lines.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("line_id"), F.lit(-1)).alias("last")).first()
    manifest = Manifest(
        source_root, size, "COMPLETE", spark.read.parquet(f"{path}/files").count(), sizes["n"],
        spark.read.parquet(f"{path}/ngram_counts").count(), sizes["last"] // lines_per_shard + 1, lines_per_shard,
    )
    spark.createDataFrame([tuple(dataclasses.asdict(manifest).values())], "source_root string, ngram_size int, state string, n_files long, n_lines long, n_ngrams long, n_shards long, lines_per_shard long").coalesce(1).write.json(f"{path}/manifest")
    return Index(spark, path, manifest)
