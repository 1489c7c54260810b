"""An HTTP server in front of an index, and a client that loads it.

GET  /?q=...&limit=&offset=                     a page of results
GET  /api/search?query=...&limit=&offset=       the same as JSON
GET, HEAD /:path                                a file's text, with Last-Modified
GET  /view/path?hl=3,7                          a page of the file with numbered lines
POST /rpc                                       a numbered request as JSON (see Service.call)
"""

from __future__ import annotations

import gzip
import html
import json
import threading
import time
from collections import OrderedDict
from email.utils import formatdate, parsedate_to_datetime
from hashlib import sha1
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import HTTPError
from urllib.parse import parse_qs, quote, unquote, urlsplit
from urllib.request import urlopen

from .service import LEAST_LIMIT, Forbidden, Missing, Service
from .tools import prefixes_of

#: Pages of files that a server remembers.
MOST_PAGES = 256


def parse_query(query_string: str) -> tuple[str, int, int]:
    """(query without white space around it, limit, offset) of a query string; the query is under q or query."""
    got = parse_qs(query_string, keep_blank_values=True)
    first = lambda *names: next((got[n][0] for n in names if n in got), None)
    return (first("q", "query") or "").strip(), int(first("limit") or LEAST_LIMIT), int(first("offset") or 0)


def results_page(query: str, found: dict) -> str:
    """Results as HTML; the texts of lines are escaped and marked already."""
    out = [f"<title>{html.escape(query)}</title><p>{found['num_results']} files{', and more' if found['overflow'] else ''}"]
    for r in found["results"]:
        link = f"/view/{quote(r['filename'])}"
        rows = "\n........\n".join("\n".join(f"{x['line_num']:6} {x['line_text']}" for x in group) for group in r["groups"])
        out.append(f"<h2><a href='{link}'>{html.escape(r['filename'])}</a></h2><pre>{rows}</pre>")
    return "<!doctype html><meta charset=utf-8>" + "".join(out)


def file_page(filename: str, text: str, marked: tuple[int, ...] = ()) -> str:
    """A file as HTML, a row for each line, with some of them marked."""
    rows = (f"<a id=line-{n}{' class=marked' if n in marked else ''}>{n:6}</a> {html.escape(x)}" for n, x in enumerate(text.split("\n"), 1))
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(filename)}</title><pre>" + "\n".join(rows) + "</pre>"


class Pages:
    """Compressed pages by a key over name, time, version and marked lines; the least used go."""

    def __init__(self, most: int = MOST_PAGES):
        self.most, self.held, self.lock = most, OrderedDict(), threading.Lock()

    def get(self, parts: tuple, make) -> bytes:
        key = sha1("-".join(map(str, parts)).encode()).hexdigest()
        with self.lock:
            if key in self.held:
                self.held.move_to_end(key)
                return self.held[key]
        page = gzip.compress(make().encode(), mtime=0)
        with self.lock:
            self.held[key] = page
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        return page


class Handler(BaseHTTPRequestHandler):
    service: Service
    pages: Pages
    #: Seconds since 1970 at which the index was opened: its files don't change.
    changed: int

    def do_GET(self) -> None:
        self._answer(self._get)

    do_HEAD = do_GET

    def do_POST(self) -> None:
        self._answer(self._post)

    def log_message(self, *args) -> None:
        pass

    def _answer(self, make) -> None:
        try:
            status, kind, body, more = make()
        except Forbidden as e:
            status, kind, body, more = 403, "text/plain", str(e).encode(), {}
        except Missing as e:
            status, kind, body, more = 404, "text/plain", str(e).encode(), {}
        except (ValueError, KeyError, TypeError) as e:
            status, kind, body, more = 400, "text/plain", str(e).encode(), {}
        self.send_response(status)
        for name, value in {"Content-Type": f"{kind}; charset=utf-8", "Content-Length": str(len(body)), **more}.items():
            self.send_header(name, value)
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def _get(self) -> tuple[int, str, bytes, dict]:
        url = urlsplit(self.path)
        if url.path.startswith("/:"):
            return self._unchanged() or (200, "text/plain", self.service.raw_file(unquote(url.path[2:])).encode(), self._time())
        if url.path.startswith("/view/"):
            name = unquote(url.path[6:])
            marked = tuple(sorted({int(n) for n in parse_qs(url.query).get("hl", [""])[0].split(",") if n}))
            page = self.pages.get((name, self.changed, 1, marked), lambda: file_page(name, self.service.raw_file(name), marked))
            return self._unchanged() or (200, "text/html", page, {**self._time(), "Content-Encoding": "gzip"})
        query, limit, offset = parse_query(url.query)
        if url.path == "/api/search":
            return 200, "application/json", json.dumps(self.service.search(query, limit=limit, offset=offset)).encode(), {}
        if url.path == "/":
            found = self.service.search(query, limit=limit, offset=offset, highlight=True) if query else {"num_results": 0, "overflow": False, "results": []}
            return 200, "text/html", results_page(query, found).encode(), {}
        raise Missing(url.path)

    def _post(self) -> tuple[int, str, bytes, dict]:
        if urlsplit(self.path).path != "/rpc":
            raise Missing(self.path)
        request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
        return 200, "application/json", json.dumps(self.service.call(request)).encode(), {}

    def _time(self) -> dict:
        return {"Last-Modified": formatdate(self.changed, usegmt=True)}

    def _unchanged(self):
        since = self.headers.get("If-Modified-Since")
        if since and parsedate_to_datetime(since).timestamp() >= self.changed:
            return 304, "text/plain", b"", self._time()
        return None


def make_server(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server with a thread for each request; `serve_forever` runs it."""
    own = type("IndexHandler", (Handler,), {"service": service, "pages": Pages(), "changed": int(time.time())})
    return ThreadingHTTPServer((host, port), own)


def load_test(url: str, terms: list[str], *, clients: int = 1) -> list[dict]:
    """Search for all beginnings of the terms over HTTP: query, status, results and milliseconds of each, in order."""
    work = list(enumerate(prefixes_of(terms)))
    out: list[dict] = []

    def run(own: list) -> None:
        for i, q in own:
            began = time.perf_counter()
            try:
                with urlopen(f"{url}/api/search?query={quote(q)}") as r:
                    status, n = r.status, json.load(r)["num_results"]
            except HTTPError as e:
                status, n = e.code, 0
            out.append({"at": i, "query": q, "status": status, "num_results": n, "ms": 1000 * (time.perf_counter() - began)})

    threads = [threading.Thread(target=run, args=(work[k::clients],)) for k in range(clients)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return sorted(out, key=lambda r: r["at"])
