"""Source trees as a data source: spark.read.format("source_tree").option("roots", ...).load().

Spark's own file sources pass over names that begin with a dot or an underscore, so
trees are walked here. The walk runs on the driver and only lists paths; contents are
read by the tasks, a batch of paths each. Roots have to be reachable from executors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import BAD_EXTENSIONS, BAD_FOLDERS, content_indexable, language, path_indexable

SCHEMA = "root string, path string, directory string, filename string, content binary"


class Paths(InputPartition):
    def __init__(self, files: list[tuple[str, str, str, str]]):
        self.files = files


def walk(root: str) -> Iterator[tuple[str, str, str, str]]:
    """(root, canonical path, directory, name under the root) of the regular files below a root.

    Links to files are files under each of their names. Paths that aren't valid UTF-8
    or can't be resolved are passed over, and so are those that the path rules leave out.
    """
    base = root.rstrip("/") or "/"
    for folder, folders, names in os.walk(base):
        folders.sort()
        for name in sorted(names):
            full = os.path.join(folder, name)
            try:
                full.encode("utf-8")
                real = os.path.realpath(full, strict=True)
            except (OSError, UnicodeEncodeError):
                continue
            if not os.path.isfile(real) or any(f"/{bad}/" in real for bad in BAD_FOLDERS) or real.rsplit(".", 1)[-1] in BAD_EXTENSIONS:
                continue
            yield base, real, base, os.path.relpath(full, base)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"]) if options.get("roots", "").startswith("[") else [options.get("roots") or options["path"]]
        self.batch = int(options.get("batchfiles", 200))

    def partitions(self) -> list[Paths]:
        out, now = [], []
        for root in self.roots:
            for found in walk(root):
                now.append(found)
                if len(now) == self.batch:
                    out.append(Paths(now))
                    now = []
        return [*out, Paths(now)] if now or not out else out

    def read(self, partition: Paths) -> Iterator[tuple]:
        for root, path, directory, name in partition.files:
            with open(path, "rb") as f:
                yield root, path, directory, name, f.read()


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, roots: str | list[str], *, batch_files: int = 200) -> DataFrame:
    """Indexable files of source trees, with (root, path, directory, filename, lang, content binary)."""
    spark.dataSource.register(SourceTree)
    roots = [roots] if isinstance(roots, str) else roots
    found = spark.read.format("source_tree").option("roots", json.dumps(roots)).option("batchFiles", batch_files).load()
    kept = found.where(path_indexable(F.col("path"))).where(content_indexable(F.col("content")))
    return kept.withColumn("lang", language(F.col("path")))
