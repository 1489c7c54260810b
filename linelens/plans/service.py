"""What a server in front of an index calls: requests in, plain Python values out."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import functions as F

from ..functions.text import xhtml_escape
from ..operators.lines import rebuild
from ..schema import SearchRequest
from .index import Index
from .search import search

#: Results that a request may ask for, and bytes of a file that are handed out.
LEAST_LIMIT, MOST_LIMIT, MOST_FILE_BYTES = 10, 100, 1 << 20


class Forbidden(Exception):
    """A request outside what is allowed."""


class Missing(Exception):
    """A file that isn't in the index."""


@dataclass
class Service:
    index: Index

    def search(self, query: str, *, limit: int = LEAST_LIMIT, offset: int = 0, within_file: int = 10, highlight: bool = False) -> dict[str, Any]:
        """Files with their runs of lines, and whether there are more.

        Small limits are raised to the least one; large ones are refused. One more file
        than wanted is looked for, which tells whether there are more.
        """
        if limit > MOST_LIMIT:
            raise Forbidden(f"limit above {MOST_LIMIT}")
        limit = max(limit, LEAST_LIMIT)
        shown = search(self.index, SearchRequest(query, limit + 1, within_file, offset))
        text = F.col("line_text")
        if highlight:
            q = xhtml_escape(F.lit(query))
            text = F.replace(xhtml_escape(text), q, F.concat(F.lit("<strong>"), q, F.lit("</strong>"))) if query else xhtml_escape(text)
        # The limits bound what is collected.
        rows = shown.select("file_id", "filename", "lang", "island", "line_num", text.alias("line_text"), "is_matched_line").orderBy("file_id", "line_num").collect()
        files: dict[int, dict[str, Any]] = {}
        for r in rows:
            own = files.setdefault(r["file_id"], {"filename": r["filename"], "lang": r["lang"], "groups": []})
            if len(own["groups"]) < r["island"]:
                own["groups"].append([])
            own["groups"][-1].append({"line_num": r["line_num"], "line_text": r["line_text"], "is_matched_line": r["is_matched_line"]})
        results = list(files.values())
        return {"query": query, "num_results": min(len(results), limit), "overflow": len(results) > limit, "results": results[:limit]}

    def call(self, request: dict[str, Any]) -> dict[str, Any]:
        """A numbered request {request_num, search_query: {query, limit, within_file_limit, offset}} and its answer with the time taken in ms."""
        began = time.perf_counter()
        if "search_query" not in request:
            raise Forbidden("no known request")
        wanted = SearchRequest(**{"limit": 100, "within_file_limit": 10, "offset": 0} | request["search_query"])
        rows = search(self.index, wanted).orderBy("file_id", "line_num").collect()
        results: dict[int, dict[str, Any]] = {}
        for r in rows:
            results.setdefault(r["file_id"], {"filename": r["filename"], "lang": r["lang"], "lines": []})["lines"].append({"line_num": r["line_num"], "line_text": r["line_text"], "is_matched_line": r["is_matched_line"]})
        return {"request_num": request.get("request_num", 0), "time_elapsed": round(1000 * (time.perf_counter() - began)), "search_response": {"results": list(results.values())}}

    def raw_file(self, filename: str) -> str:
        """A file's text, put together from its lines."""
        if filename.startswith("/") or ".." in filename.split("/"):
            raise Forbidden(filename)
        found = self.index.files.where(F.col("filename") == filename).select("file_id").limit(1)
        lines = self.index.lines.join(found, "file_id", "left_semi")
        size = lines.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes")).first()
        if not size["n"]:
            raise Missing(filename)
        if size["bytes"] - 1 > MOST_FILE_BYTES:
            raise Forbidden(f"{filename} has more than {MOST_FILE_BYTES} bytes")
        return rebuild(lines).first()["content"]
