import random

import pytest
from pyspark.sql import functions as F

from linelens.functions.ngrams import query_trigrams
from linelens.operators import lines as L
from linelens.operators import postings as P
from linelens.operators import results as R
from linelens.plans import tools
from linelens.plans.index import build_index, build_tree_index, open_index
from linelens.plans.search import make_plan, matching_lines, search, search_many, search_matches, search_nested
from linelens.schema import SearchRequest

FILES = {
    "a.c": b"int foo;\nint bar;\nfoo(bar);\n",
    "b.py": b"x\nab\nabab foo\n\nfoo\nfoo2",
    "c.txt": b"ok line is here, long enough\n\xff\nfoo after bad\n",
    "d/Makefile": b"all:\n\tfoo\n",
    ".git/config.py": b"foo\n",
    "x.png": b"foo\n",
    "empty.txt": b"",
    "_hidden.py": b"zzz\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    for name, data in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


@pytest.fixture(scope="module")
def index(spark, tree, tmp_path_factory):
    return build_tree_index(spark, tree, str(tmp_path_factory.mktemp("db") / "i"), lines_per_shard=5)


def names(index):
    return {r["file_id"]: r["filename"] for r in index.files.collect()}


def test_tree_files(index):
    assert [names(index)[i] for i in sorted(names(index))] == ["_hidden.py", "a.c", "b.py", "c.txt", "d/Makefile"]
    assert {r["filename"]: r["lang"] for r in index.files.collect()} == {"_hidden.py": "python", "a.c": "c", "b.py": "python", "c.txt": "text", "d/Makefile": ""}


def test_tree_lines(index):
    rows = [(r["line_id"], names(index)[r["file_id"]], r["file_offset"], r["file_line"], r["phys_line"], r["line"]) for r in index.lines.orderBy("line_id").collect()]
    assert rows[:2] == [(0, "_hidden.py", 0, 1, 1, "zzz"), (1, "_hidden.py", 4, 2, 2, "")]
    assert rows[2:6] == [(2, "a.c", 0, 1, 1, "int foo;"), (3, "a.c", 9, 2, 2, "int bar;"), (4, "a.c", 18, 3, 3, "foo(bar);"), (5, "a.c", 28, 4, 4, "")]
    # The bad line takes bytes, but neither an id nor a number.
    assert rows[12:15] == [(12, "c.txt", 0, 1, 1, "ok line is here, long enough"), (13, "c.txt", 31, 2, 3, "foo after bad"), (14, "c.txt", 45, 3, 4, "")]


def test_manifest_and_fsck(spark, index, tree):
    again = open_index(spark, index.path)
    assert again.manifest == index.manifest and again.manifest.state == "COMPLETE" and again.manifest.n_files == 5
    assert {r["violations"] for r in tools.fsck(index).collect()} == {0}
    with pytest.raises(FileExistsError):
        build_tree_index(spark, tree, index.path, preserve=True)
    with pytest.raises(FileNotFoundError):
        open_index(spark, index.path + "-none")
    bad = index.lines.withColumn("file_line", F.when(F.col("line_id") == 3, 9).otherwise(F.col("file_line")))
    assert [r["line_id"] for r in tools.order_violations(bad).collect()] == [4]


def found(df):
    return sorted(r["line_id"] for r in df.collect())


@pytest.mark.parametrize("query, lines", [("foo", [2, 4, 8, 10, 11, 13, 16]), ("ab", [8]), ("x", []), ("nope", []), ("foo2", [11]), ("\n", []), ("FOO", []), ("foo(", [4])])
def test_search_lines(index, query, lines):
    assert found(matching_lines(index, query)) == lines


def test_empty_query(index):
    assert found(matching_lines(index, "")) == [r["line_id"] for r in index.lines.where("octet_length(line) >= 3").orderBy("line_id").collect()]
    assert found(matching_lines(index, "ab", short_lines=True)) == [7, 8]


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_postings_by_shard_equal_the_aggregate(index, size):
    row = lambda r: (r["shard"], bytes(r["ngram"]), r["n"], r["line_ids"])
    one = sorted(map(row, P.postings(index.lines, lines_per_shard=4, size=size).collect()))
    assert one and one == sorted(map(row, P.build_postings(index.lines, lines_per_shard=4, size=size).collect()))


def test_false_positive_candidate(spark, tmp_path):
    corpus = spark.createDataFrame([(0, "d", "f", "", "file_index = 1;\nindes_codex ndex inde\n")], "file_id long, directory string, filename string, lang string, content string")
    built = build_index(corpus, str(tmp_path / "i"))
    both = sorted(r["line_id"] for r in P.intersect(built.postings, query_trigrams("index")).collect())
    assert 0 in both and found(matching_lines(built, "index")) == [0]


def shown(index, *args, **kw):
    out = {}
    for r in search(index, SearchRequest(*args, **kw)).collect():
        out.setdefault(names(index)[r["file_id"]], []).append((r["line_num"], r["is_matched_line"], r["overwritten_flag"], r["island"]))
    return {k: sorted(v) for k, v in out.items()}


def test_context(index):
    got = shown(index, "foo", 10, 10)
    assert got["a.c"] == [(1, True, True, 1), (2, False, False, 1), (3, True, True, 1)]
    assert got["b.py"] == [(2, False, False, 1), (3, True, True, 1), (4, False, False, 1), (5, True, False, 1), (6, True, True, 1)]
    assert got["c.txt"] == [(1, False, False, 1), (2, True, True, 1)]
    assert got["d/Makefile"] == [(1, False, False, 1), (2, True, True, 1)]


def test_limits(index):
    assert {k: [x[:2] for x in v] for k, v in shown(index, "foo", 2, 1).items()} == {"a.c": [(1, True), (2, False)], "b.py": [(2, False), (3, True), (4, False)]}
    assert set(shown(index, "foo", 2, 1, 1)) == {"b.py", "c.txt"}
    assert shown(index, "foo", 0, 1) == {}
    with pytest.raises(ValueError):
        SearchRequest("x", -1)


def test_nested_and_text(index):
    rows = {r["filename"]: [(x["line_num"], x["is_matched_line"]) for x in r["lines"]] for r in search_nested(index, "foo").collect()}
    assert rows["d/Makefile"] == [(1, False), (2, True)]
    df = search(index, "bar").select("file_id", F.col("line_num").alias("file_line"), F.col("line_text").alias("line"), "is_matched_line")
    out = [r["out"] for r in R.text_output(df, index.files, "bar").orderBy("file_id", "seq").collect()]
    assert out == ["a.c", "---", "  int foo;", "* int bar;", "* foo(bar);"]


def test_islands_and_dots(spark):
    rows = spark.createDataFrame([(1, n, "l", n == 2) for n in (1, 2, 3, 7, 8, 12)], "file_id long, file_line long, line string, is_matched_line boolean")
    got = [(r["island"], r["first_line"], r["last_line"]) for r in R.island_ranges(rows).orderBy("island").collect()]
    assert got == [(1, 1, 3), (2, 7, 8), (3, 12, 12)]
    files = spark.createDataFrame([(1, "f")], "file_id long, filename string")
    assert [r["out"] for r in R.text_output(rows, files, "q").orderBy("seq").collect()].count("........") == 2


def test_asof(index):
    points = index.lines.select("line_id").union(index.spark.createDataFrame([(1000,)], "line_id long"))
    got = {r["line_id"]: r["file_id"] for r in L.asof_file(points, index.file_start_lines).collect()}
    truth = {r["line_id"]: r["file_id"] for r in index.lines.collect()}
    assert all(got[k] == v for k, v in truth.items()) and got[1000] == max(truth.values())


def test_rebuild(index):
    got = {names(index)[r["file_id"]]: r["content"] for r in L.rebuild(index.lines).collect()}
    assert got["b.py"].encode() == FILES["b.py"] and got["a.c"].encode() == FILES["a.c"]


def test_running_start_in_blocks(spark):
    from linelens.functions.ids import running_start

    df = spark.range(100).select("id", (F.col("id") % 7).alias("n"))
    got = {r["id"]: r["s"] for r in running_start(df, "id", F.col("n"), "s", block=8).collect()}
    assert got == {i: sum(j % 7 for j in range(i)) for i in range(100)}


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(i, "d", f"d/{i}", "", "\n".join("".join(rng.choice("ab é%_*c") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6)))) for i in range(120)]
    corpus = spark.createDataFrame(rows, "file_id long, directory string, filename string, lang string, content string")
    return build_index(corpus, str(tmp_path_factory.mktemp("db") / "big"), lines_per_shard=50), rows


def test_index_equals_scan(big, monkeypatch):
    """No path may lose a line that a plain test finds."""
    index, rows = big
    rng = random.Random(9)
    lines = [(r["line_id"], r["line"]) for r in index.lines.collect()]
    queries = ["é", "%", "_", "a", "ab", "éa", "zzz", ""]
    while len(queries) < 24:
        s = rng.choice(rows)[4].replace("\n", " ")
        if len(s) > 8:
            at = rng.randrange(len(s) - 7)
            queries.append(s[at : at + rng.randrange(1, 7)])
    kinds = set()
    for q in queries:
        for share in (0.0, 2.0):
            plan = make_plan(index, q, scan_share=share)
            kinds.add(plan.kind)
            want = sorted(i for i, x in lines if q in x and (len(q.encode()) >= 3 or len(x.encode()) >= 3))
            assert found(matching_lines(index, q, plan=plan)) == want, (q, plan)
    assert kinds == {"empty", "scan", "ngrams", "fragment"}
    batch = index.spark.createDataFrame([*enumerate(queries), (99, None)], "query_id long, query string")
    got = search_many(index, batch, limit=3, within_file=2)
    many = {}
    for r in got.collect():
        many.setdefault(r["query_id"], set()).add(r["line_id"])
    for i, q in enumerate(queries[:10]):
        assert many.get(i, set()) == set(found(search_matches(index, SearchRequest(q, 3, 2)))), q
    monkeypatch.setattr("linelens.plans.search.MOST_PLANNED", 1)
    key = lambda df: sorted((r["query_id"], r["line_id"]) for r in df.collect())
    assert key(search_many(index, batch, limit=3, within_file=2)) == key(got)
    assert key(search_many(index, batch, limit=2, within_file=2, offset=1)) != []


def test_empty_corpus(spark, tmp_path):
    corpus = spark.createDataFrame([], "file_id long, directory string, filename string, lang string, content string")
    index = build_index(corpus, str(tmp_path / "none"))
    assert index.manifest.n_lines == 0 and index.manifest.n_ngrams == 0
    for q in ("foo", "a", ""):
        assert search(index, q).count() == 0


def test_null_content(spark, tmp_path):
    corpus = spark.createDataFrame([(0, None, None, None, None), (1, "d", "f", "", "abc")], "file_id long, directory string, filename string, lang string, content string")
    index = build_index(corpus, str(tmp_path / "n"))
    assert index.manifest.n_files == 2 and found(matching_lines(index, "abc")) == [0]


def test_workload_and_bench(index):
    values = index.spark.createDataFrame([("# no",), ("",), ("foo",), ("ab",)], "value string")
    assert sorted(r["query"] for r in tools.workload(values).collect()) == ["a", "ab", "f", "fo", "foo"]
    got = tools.bench(index.spark, index, ["foo", "#x"])
    assert got["searches"] == 3 and got["matches"] > 0


def test_report(index):
    rows = P.report(index.ngram_counts).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0]["shown"] == "foo" and rows[0]["count"] == 7 and abs(rows[-1]["running_percent"] - 100) < 1e-9
    assert [(-r["count"], bytes(r["ngram"])) for r in rows] == sorted((-r["count"], bytes(r["ngram"])) for r in rows)


def test_cli(spark, tree, tmp_path, capsys):
    from linelens.cli import main

    db = str(tmp_path / "db")
    assert main(["index", tree, "--db-path", db], spark) == 0
    assert main(["search", "foo2", "--db-path", db], spark) == 0
    assert main(["search", "foo", "--db-path", db, "--no-print"], spark) == 0
    assert main(["fsck", "--db-path", db], spark) == 0
    out = capsys.readouterr().out
    assert "* foo2" in out and "4 search results" in out and "5 files" in out


def test_streaming(spark, tmp_path):
    from linelens.streaming.ingest import ingest, merged_counts, merged_lines

    source = tmp_path / "in"
    rows = [(i, f"line {i}\nfoo") for i in range(6)]
    for k in range(2):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], "file_id long, content string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("file_id long, content string").option("maxFilesPerTrigger", 1).parquet(str(source))
    for _ in range(2):  # a second run finds nothing new
        ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert merged_lines(spark, str(tmp_path / "out")).count() == 12
    counts = {bytes(r["ngram"]): r["count"] for r in merged_counts(spark, str(tmp_path / "out")).collect()}
    assert counts[b"foo"] == 6 and counts[b"lin"] == 6
    from linelens.streaming.ingest import compact

    built = compact(spark, str(tmp_path / "out"), str(tmp_path / "index"), lines_per_shard=5)
    assert built.manifest.n_lines == 12 and built.manifest.n_files == 6
    assert [(r["filename"], r["line_num"]) for r in search(built, "line 4").where("is_matched_line").collect()] == [("4", 1)]
    assert {r["check"]: r["violations"] for r in tools.fsck(built).collect()} == dict.fromkeys([r["check"] for r in tools.fsck(built).collect()], 0)


def test_service(index):
    from linelens.plans.service import Forbidden, Missing, Service

    service = Service(index)
    got = service.search("foo", limit=1)
    assert got["num_results"] == 4 and not got["overflow"]
    assert [[x["line_num"] for x in g] for g in got["results"][1]["groups"]] == [[2, 3, 4, 5, 6]]
    assert "<strong>foo</strong>" in service.search("foo", highlight=True)["results"][0]["groups"][0][0]["line_text"]
    with pytest.raises(Forbidden):
        service.search("foo", limit=101)
    answer = service.call({"request_num": 7, "search_query": {"query": "foo", "limit": 1}})
    assert answer["request_num"] == 7 and [r["filename"] for r in answer["search_response"]["results"]] == ["a.c"]
    with pytest.raises(Forbidden):
        service.call({"request_num": 1})
    assert service.raw_file("b.py").encode() == FILES["b.py"]
    with pytest.raises(Missing):
        service.raw_file("none")
    for bad in ("/etc/passwd", "../x"):
        with pytest.raises(Forbidden):
            service.raw_file(bad)


def test_few_ranges():
    from linelens.plans.index import few_ranges

    rng = random.Random(5)
    assert few_ranges([]) == [] and few_ranges([4], 1) == [(3, 5)] and few_ranges([1, 2, 3, 9]) == [(1, 3), (9, 9)]
    for _ in range(200):
        ids, around, most = [rng.randrange(500) for _ in range(rng.randrange(1, 60))], rng.randrange(3), rng.randrange(1, 9)
        got = few_ranges(ids, around, most)
        assert len(got) <= most and all(b < c for (_, b), (c, _) in zip(got, got[1:]))
        assert all(any(a <= i + k <= b for a, b in got) for i in ids for k in (-around, around))
        if len(set(ids)) <= most:
            assert sum(b - a + 1 for a, b in got) == len({i + k for i in ids for k in range(-around, around + 1)})


def test_few_row_groups_are_read(spark, tmp_path):
    """An indexed search filters lines by folder and id before it reads them; context reads the matches' neighbours."""
    rows = [(i, "d", f"f{i}", "", "\n".join(f"line {i} {k}" + (" needle" if (i, k) == (40, 3) else "") for k in range(50))) for i in range(100)]
    index = build_index(spark.createDataFrame(rows, "file_id long, directory string, filename string, lang string, content string"), str(tmp_path / "i"), lines_per_shard=2)
    assert index.table("lines").select("folder").distinct().count() > 5
    hits = matching_lines(index, "needle")
    assert make_plan(index, "needle").kind == "ngrams" and found(hits) == [40 * 50 + 3]
    plan = hits._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(line_id,2003)" in plan
    got = [(r["line_num"], r["is_matched_line"]) for r in search(index, "needle").collect()]
    assert got == [(3, False), (4, True), (5, False)]


def test_no_limits(index):
    everything = sorted(r["line_id"] for r in matching_lines(index, "foo").collect())
    request = SearchRequest("foo", None, None)
    assert found(search_matches(index, request)) == everything
    assert [r["is_matched_line"] for r in search(index, request).collect()].count(True) == len(everything)
    assert sorted(r["line_id"] for r in search_many(index, index.spark.createDataFrame([(1, "foo")], "query_id long, query string"), limit=None, within_file=None).collect()) == everything
    with pytest.raises(ValueError):
        SearchRequest("foo", -1)


def test_results_are_ordered(index):
    got = [(r["file_id"], r["line_num"]) for r in search(index, "foo").collect()]
    assert got == sorted(got) and len(got) > 3


def test_other_folders_are_not_replaced(spark, tmp_path):
    (tmp_path / "precious").mkdir()
    (tmp_path / "precious" / "file").write_text("x")
    corpus = spark.createDataFrame([(0, "d", "f", "", "abc")], "file_id long, directory string, filename string, lang string, content string")
    with pytest.raises(FileExistsError):
        build_index(corpus, str(tmp_path / "precious"))
    assert (tmp_path / "precious" / "file").exists()


def test_server(index):
    import gzip
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from linelens.plans.server import load_test, make_server, parse_query
    from linelens.plans.service import Service

    assert parse_query("q=+a%20b+&limit=20&offset=3") == ("a b", 20, 3) and parse_query("query=x") == ("x", 10, 0) and parse_query("") == ("", 10, 0)
    server = make_server(Service(index), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def get(path, method="GET", data=None, **headers):
        try:
            with urlopen(Request(base + path, method=method, data=data, headers=headers)) as r:
                return r.status, r.read(), r.headers
        except HTTPError as e:
            return e.code, e.read(), e.headers

    try:
        status, body, _ = get("/api/search?query=foo&limit=1")
        assert status == 200 and json.loads(body)["results"] and not json.loads(body)["overflow"]
        name = json.loads(body)["results"][0]["filename"]
        assert get("/api/search?query=foo&limit=101")[0] == 403 and get("/api/search?query=foo&limit=x")[0] == 400 and get("/nothing")[0] == 404
        status, body, _ = get("/?q=foo")
        assert status == 200 and b"<strong>foo</strong>" in body and get("/")[0] == 200
        status, text, headers = get(f"/:{name}")
        assert status == 200 and b"foo" in text and headers["Content-Type"].startswith("text/plain")
        assert get(f"/:{name}", **{"If-Modified-Since": headers["Last-Modified"]})[0] == 304
        assert get(f"/:{name}", method="HEAD")[1] == b"" and get("/:../x")[0] == 403 and get("/:no/file")[0] == 404
        status, page, headers = get(f"/view/{name}?hl=1")
        assert status == 200 and headers["Content-Encoding"] == "gzip" and b"id=line-1 class=marked" in gzip.decompress(page)
        status, body, _ = get("/rpc", "POST", json.dumps({"request_num": 7, "search_query": {"query": "foo"}}).encode())
        assert status == 200 and json.loads(body)["request_num"] == 7 and get("/rpc", "POST", b"{}")[0] == 403
        runs = load_test(base, ["fo", "#c"], clients=2)
        assert [(r["query"], r["status"]) for r in runs] == [("f", 200), ("fo", 200)] and all(r["ms"] > 0 for r in runs)
    finally:
        server.shutdown()


def test_bench_clients(index):
    from linelens.plans import tools

    got = tools.bench_clients(index, ["foo"], clients=2, iterations=4)
    assert got["searches"] == 4 and got["ms_per_query"] > 0 and got["queries_per_second"] > 0
