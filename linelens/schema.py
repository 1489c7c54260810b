"""Schemas of the index tables, requests and results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


FILES = "file_id bigint, directory string, filename string, lang string, time_indexed timestamp, time_archive timestamp"
LINES = "line_id bigint, file_id bigint, file_offset bigint, file_line bigint, phys_line bigint, line string"
POSTINGS = "shard bigint, ngram binary, n bigint, line_ids array<bigint>"
NGRAM_COUNTS = "ngram binary, count bigint"
START_LINES = "file_id bigint, first_line bigint"
QUERIES = "query_id bigint, query string"
RESULT = "filename string, lang string, lines array<struct<line_num:bigint,line_text:string,is_matched_line:boolean>>"


@dataclass(frozen=True)
class SearchRequest:
    """A literal query and its limits; None is no limit."""

    query: str
    limit: int | None = 100
    within_file_limit: int | None = 10
    offset: int = 0

    def __post_init__(self) -> None:
        if min(self.limit or 0, self.within_file_limit or 0, self.offset) < 0:
            raise ValueError("limits and offset can't be negative")


@dataclass(frozen=True)
class Manifest:
    """What is known of a built index; written last, so that its presence means completeness."""

    source_root: str
    ngram_size: int = 3
    state: str = "COMPLETE"
    n_files: int = 0
    n_lines: int = 0
    n_ngrams: int = 0
    n_shards: int = 0
    lines_per_shard: int = 0
