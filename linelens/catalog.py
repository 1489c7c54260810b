"""The registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ngrams as N
from .functions import text as X
from .operators import lines as L
from .operators import postings as P
from .operators import results as R
from .plans import tools
from .plans.index import Index, build_index, open_index
from .plans.search import RAREST, matching_lines, search, search_many, search_matches
from .schema import SearchRequest
from .sources.corpus import corpus, table
from .storage import exists, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Terms of the batch queries.
TERMS = ("ation", "that an", "%%%", "é", "x", "mmap")
LINES_PER_SHARD = 4096


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the documents, built once for each session and folder."""
    name = "".join(c if c.isalnum() else "_" for c in sf_dir)
    path = f"{shared_dir(spark)}/linelens/index-{spark.sparkContext.applicationId}-{name}"
    if not exists(spark, f"{path}/manifest"):
        build_index(corpus(spark, sf_dir), path, source_root=sf_dir, lines_per_shard=LINES_PER_SHARD)
    return open_index(spark, path)


def own_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with ids straight from the documents."""
    return L.with_line_ids(L.lines_of_text(corpus(spark, sf_dir)))


# The documents' lines with ids, and their n-grams, in DuckDB.
LINES = """l0 AS (SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS file_line FROM documents),
lines AS (SELECT row_number() OVER (ORDER BY file_id, file_line) - 1 AS line_id, file_id, file_line,
  coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file_id ORDER BY file_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS file_offset, line FROM l0)"""
GRAMS = f"""{LINES},
grams AS (SELECT line_id, unnest(list_distinct(list_transform(range(1, strlen(line) - 1), lambda i: substr(hex(encode(line)), 2 * i - 1, 6)))) AS ngram FROM lines WHERE strlen(line) >= 3),
counts AS (SELECT ngram, count(*) AS count FROM grams GROUP BY ngram)"""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches_sql(term: str, limit: int | None = 10, within: int | None = 10, offset: int = 0) -> str:
    """CTEs up to `kept`: the matches that the limits leave."""
    limit, within = limit or 10**15, within or 10**15
    short = " AND strlen(line) >= 3" if len(term.encode()) < 3 else ""
    return f"""{LINES},
hits AS (SELECT line_id, file_id, file_line, line FROM lines WHERE contains(line, {quoted(term)}){short}),
ranked AS (SELECT *, dense_rank() OVER (ORDER BY file_id) AS fr, row_number() OVER (PARTITION BY file_id ORDER BY file_line) AS lr FROM hits),
kept AS (SELECT line_id, file_id, file_line, line FROM ranked WHERE fr > {offset} AND fr <= {offset + limit} AND lr <= {within})"""


def context_sql(term: str, limit: int | None = 10, within: int | None = 10) -> str:
    """CTEs up to `shown`: lines with context and flags."""
    return f"""{matches_sql(term, limit, within)},
ends AS (SELECT file_id, max(file_line) AS last_line FROM lines GROUP BY file_id),
shown AS (SELECT l.file_id, l.file_line, l.line, bool_or(k.file_line = l.file_line) AS is_matched_line, bool_or(k.file_line = l.file_line) AND max(k.file_line) = l.file_line AS overwritten_flag
  FROM kept k JOIN lines l ON l.file_id = k.file_id AND l.file_line BETWEEN k.file_line - 1 AND k.file_line + 1 JOIN ends e ON e.file_id = l.file_id
  WHERE NOT (l.line = '' AND l.file_line = e.last_line AND l.file_line > 1) GROUP BY l.file_id, l.file_line, l.line)"""


# Lines and ids


@query(f"WITH {LINES} SELECT file_id, file_line, file_offset, line FROM lines")
def lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lines_of_text(corpus(spark, sf_dir)).select("file_id", "file_line", "file_offset", "line")


@query(f"WITH {LINES} SELECT line_id, file_id, file_line FROM lines")
def line_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own_lines(spark, sf_dir).select("line_id", "file_id", "file_line")


@query(f"WITH {LINES} SELECT file_id, min(line_id) AS first_line FROM lines GROUP BY file_id")
def file_start_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.file_start_lines(own_lines(spark, sf_dir))


@query("SELECT doc_id AS file_id, coalesce(source, '') AS directory, coalesce(source, '') || '/' || doc_id AS filename, '' AS lang FROM documents")
def files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).files.select("file_id", "directory", "filename", "lang")


@query(f"WITH {LINES} SELECT max(line_id) AS max_line_id FROM lines")
def max_line_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).lines.agg(F.max("line_id").alias("max_line_id"))


@query(f"WITH {LINES} SELECT line_id, file_id, file_line, line FROM lines WHERE line_id IN (0, 7, 500, 901)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).lines.where(F.col("line_id").isin(0, 7, 500, 901)).select("line_id", "file_id", "file_line", "line")


@query(f"WITH {LINES} SELECT line_id, line FROM lines WHERE line_id >= 250 AND line_id < 300")
def sorted_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).lines.where((F.col("line_id") >= 250) & (F.col("line_id") < 300)).select("line_id", "line")


@query(f"WITH {LINES}, starts AS (SELECT file_id, min(line_id) AS first_line FROM lines GROUP BY file_id), points AS (SELECT line_id FROM lines WHERE contains(line, 'ation')) SELECT p.line_id, s.file_id FROM points p ASOF JOIN starts s ON p.line_id >= s.first_line")
def asof_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    return L.asof_file(index.lines.where(F.contains("line", F.lit("ation"))).select("line_id"), index.file_start_lines)


@query("SELECT doc_id AS file_id, md5(text) AS content_md5 FROM documents WHERE text IS NOT NULL")
def rebuild_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rebuild(index_of(spark, sf_dir).lines).select("file_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


# n-grams


@query(f"WITH {GRAMS} SELECT ngram, count FROM counts")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ngram_counts(L.explode_text(corpus(spark, sf_dir))).select(F.hex("ngram").alias("ngram"), "count")


@query(f"WITH {GRAMS} SELECT coalesce(sum(count), 0)::BIGINT AS total_count, count(*) AS total_ngrams FROM counts")
def ngram_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.totals(index_of(spark, sf_dir).ngram_counts)


@query(f"""WITH {GRAMS} SELECT row_number() OVER (ORDER BY count DESC, ngram) AS rank, ngram, count, round(100.0::DOUBLE * count / sum(count) OVER (), 6) AS percent,
round(100.0::DOUBLE * (sum(count) OVER (ORDER BY count DESC, ngram ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / sum(count) OVER (), 6) AS running_percent FROM counts""")
def ngram_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.report(index_of(spark, sf_dir).ngram_counts).select("rank", F.hex("ngram").alias("ngram"), "count", F.round("percent", 6).alias("percent"), F.round("running_percent", 6).alias("running_percent"))


@query(f"WITH {GRAMS} SELECT ngram, array_to_string(list_transform(range(1, 4), lambda i: CASE WHEN substr(ngram, 2 * i - 1, 2) BETWEEN '21' AND '7E' THEN chr(('0x' || substr(ngram, 2 * i - 1, 2))::INTEGER) ELSE '\\x' || lower(substr(ngram, 2 * i - 1, 2)) END), '') AS shown FROM counts")
def printable_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).ngram_counts.select("ngram", X.printable(F.col("ngram")).alias("shown")).withColumn("ngram", F.hex("ngram"))


@query(f"WITH {GRAMS} SELECT ngram, count(*) AS n, min(line_id) AS first_id, max(line_id) AS last_id, sum(line_id)::BIGINT AS sum_ids FROM grams GROUP BY ngram")
def postings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = index_of(spark, sf_dir).postings.select("ngram", F.explode("line_ids").alias("id"))
    return each.groupBy("ngram").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("id").alias("sum_ids")).withColumn("ngram", F.hex("ngram"))


@query(f"WITH {GRAMS}, ids AS (SELECT (line_id // {LINES_PER_SHARD})::BIGINT AS shard, ngram, list(line_id ORDER BY line_id) AS ids FROM grams GROUP BY ALL) SELECT shard, ngram, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: ids[i] - coalesce(CASE WHEN i > 1 THEN ids[i - 1] END, 0)), ',') AS gaps FROM ids")
def postings_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).postings.select("shard", F.hex("ngram").alias("ngram"), F.array_join(N.delta_encode(F.col("line_ids")).cast("array<string>"), ",").alias("gaps"))


@query(f"WITH {GRAMS} SELECT g.line_id FROM grams g WHERE ngram IN ('617469', '74696F', '696F6E') GROUP BY g.line_id HAVING count(*) = 3")
def postings_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.intersect(index_of(spark, sf_dir).postings, N.query_trigrams("ation"))


@query(f"WITH {GRAMS} SELECT row_number() OVER (ORDER BY count, ngram) AS place, ngram, count FROM counts WHERE ngram IN ('746861', '686174', '617420', '742061', '20616E')")
def ngram_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    some = index_of(spark, sf_dir).ngram_counts.where(F.col("ngram").isin(*[bytearray(g) for g in N.query_trigrams("that an")]))
    # A row for each n-gram of one query.
    return some.select(F.row_number().over(Window.orderBy("count", "ngram")).cast("bigint").alias("place"), F.hex("ngram").alias("ngram"), "count")


@query(f"WITH {GRAMS} SELECT ngram, count FROM counts WHERE substr(ngram, 1, 4) = 'C3A9' OR substr(ngram, 3, 4) = 'C3A9'")
def fragment_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fragment_ngrams(index_of(spark, sf_dir).ngram_counts, "é").select(F.hex("ngram").alias("ngram"), "count")


@query(f"""WITH {GRAMS}, per AS (SELECT (line_id // {LINES_PER_SHARD})::BIGINT AS shard, ngram, count(*) AS n FROM grams GROUP BY ALL)
SELECT shard, count(*) AS num_keys, min(ngram) AS min_key, max(ngram) AS max_key, sum(n)::BIGINT AS num_values, max(n) AS longest_list, floor(16 + 16 * count(*) + 8 * sum(n)::DOUBLE / 6)::BIGINT AS estimated_bytes FROM per GROUP BY shard""")
def shard_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.inspect_shards(index_of(spark, sf_dir))


FSCK = ("lines in order", "line ids unique", "values below the size limit", "lines have files", "postings sorted and distinct", "n-grams of one size", "counts agree with postings", "line ids dense")


@query(f"SELECT unnest([{', '.join(quoted(c) for c in FSCK)}]) AS \"check\", 0::BIGINT AS violations")
def fsck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.fsck(index_of(spark, sf_dir))


# Search

RESULT = "SELECT line_id, file_id, file_line, line FROM kept"


def _search(name: str, term: str, limit: int | None = 10, within: int | None = 10, offset: int = 0) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search_matches(index_of(spark, sf_dir), SearchRequest(term, limit, within, offset))

    QUERIES[name] = run
    ORACLE[name] = f"WITH {matches_sql(term, limit, within, offset)} {RESULT}"


@query(f"WITH {matches_sql('the')} {RESULT}")
def search_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an index: the semantics that all other paths have to keep."""
    hits = own_lines(spark, sf_dir).where(F.contains("line", F.lit("the"))).select("line_id", "file_id", "file_line", "line")
    return R.limit_matches(hits, limit=10, within_file=10)


for _name, _term, *_limits in (
    ("search_indexed", "License"), ("search_multiword", "rights reserved"), ("search_special_percent", "%%%"), ("search_special_star", "***"), ("search_special_pipe", " | "),
    ("search_utf8", "éau"), ("search_utf8_short", "é"), ("search_no_hits", "mmap"), ("search_missing_ngram", "qzx"), ("search_short_1", "x"), ("search_short_2", "th"),
    ("search_short_percent", "%"), ("search_empty", ""), ("search_line_end", "a\nb"), ("search_limits", "ation", 5, 2), ("search_offset", "ation", 5, 2, 5), ("search_all", "ation", None, None),
):
    _search(_name, _term, *_limits)


@query(f"WITH {matches_sql('ation')}, n AS (SELECT count(DISTINCT file_id) AS n FROM hits) SELECT n AS n_files, (SELECT count(*) FROM hits) AS n_matches FROM n")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.result_count(matching_lines(index_of(spark, sf_dir), "ation"))


@query(f"WITH {matches_sql('ation')} SELECT least(count(DISTINCT file_id), 10) AS n_shown, count(DISTINCT file_id) > 10 AS overflow FROM hits")
def overflow_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overflow(matching_lines(index_of(spark, sf_dir), "ation"), 10)


def _shown(spark: SparkSession, sf_dir: str, term: str = "ation", limit: int | None = None) -> DataFrame:
    return search(index_of(spark, sf_dir), SearchRequest(term, limit, 10))


@query(f"WITH {context_sql('ation', None)} SELECT file_id, file_line AS line_num, line AS line_text, is_matched_line FROM shown")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir).select("file_id", "line_num", "line_text", "is_matched_line")


@query(f"WITH {context_sql('the', None)} SELECT file_id, file_line AS line_num, is_matched_line, overwritten_flag FROM shown")
def context_compat_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, "the").select("file_id", "line_num", "is_matched_line", "overwritten_flag")


@query(f"""WITH {context_sql('ation', None)}, runs AS (SELECT *, file_line - row_number() OVER (PARTITION BY file_id ORDER BY file_line) AS g FROM shown)
SELECT file_id, dense_rank() OVER (PARTITION BY file_id ORDER BY g)::INTEGER AS island, min(file_line) AS first_line, max(file_line) AS last_line, count(*) FILTER (WHERE is_matched_line) AS n_matches FROM runs GROUP BY file_id, g""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _shown(spark, sf_dir).select("file_id", F.col("line_num").alias("file_line"), "is_matched_line")
    return R.island_ranges(shown)


@query(f"WITH {context_sql('ation')} SELECT s.file_id, coalesce(source, '') || '/' || s.file_id AS filename, '' AS lang, string_agg(CASE WHEN is_matched_line THEN '*' ELSE '-' END || file_line || ':' || line, chr(10) ORDER BY file_line) AS lines FROM shown s JOIN documents d ON d.doc_id = s.file_id GROUP BY ALL")
def search_nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.search import search_nested

    found = search_nested(index_of(spark, sf_dir), SearchRequest("ation", 10, 10))
    text = F.transform("lines", lambda x: F.concat(F.when(x["is_matched_line"], "*").otherwise("-"), x["line_num"].cast("string"), F.lit(":"), x["line_text"]))
    return found.select("file_id", "filename", "lang", F.array_join(text, "\n").alias("lines"))


@query(f"""WITH {context_sql('ation')}, g AS (SELECT *, file_line - row_number() OVER (PARTITION BY file_id ORDER BY file_line) AS g FROM shown),
i AS (SELECT *, dense_rank() OVER (PARTITION BY file_id ORDER BY g) AS island FROM g), names AS (SELECT DISTINCT file_id, coalesce(source, '') || '/' || file_id AS filename FROM shown JOIN documents ON doc_id = file_id)
SELECT file_id, (file_line * 2 + 1)::BIGINT AS seq, CASE WHEN is_matched_line THEN '* ' ELSE '  ' END || line AS out FROM i
UNION ALL SELECT file_id, (min(file_line) * 2)::BIGINT, '........' FROM i WHERE island > 1 GROUP BY file_id, island
UNION ALL SELECT file_id, -1, filename FROM names UNION ALL SELECT file_id, 0, repeat('-', length(filename)) FROM names""")
def text_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _shown(spark, sf_dir, limit=10).select("file_id", F.col("line_num").alias("file_line"), F.col("line_text").alias("line"), "is_matched_line")
    return R.text_output(shown, index_of(spark, sf_dir).files, "ation")


@query(f"WITH {context_sql('the', None)} SELECT file_id, file_line AS line_num, replace(replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'), 'the', '<strong>the</strong>') AS html FROM shown")
def highlight_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, "the").select("file_id", "line_num", X.highlight_html(F.col("line_text"), "the").alias("html"))


@query(f"WITH {context_sql('ation', None)} SELECT file_id, file_line AS line_num, CASE WHEN is_matched_line THEN replace(line, 'ation', chr(27) || '[1;31mation' || chr(27) || '[0m') ELSE line END AS ansi FROM shown")
def highlight_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir).select("file_id", "line_num", X.highlight_ansi(F.col("line_text"), "ation", F.col("is_matched_line")).alias("ansi"))


@query(f"WITH {matches_sql('ation')} SELECT line_id, coalesce(source, '') || '/' || file_id || '@@line-' || file_line AS locator FROM kept JOIN documents ON doc_id = file_id")
def line_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    found = search_matches(index, SearchRequest("ation", 10, 10)).join(index.files.select("file_id", "filename"), "file_id")
    return found.select("line_id", X.locator(F.col("filename"), F.col("file_line")).alias("locator"))


# Batches

_TERMS_SQL = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {quoted(t)})" for i, t in enumerate(TERMS)) + ") t(query_id, query))"


def _many_sql(terms: str, limit: int | None, within: int | None) -> str:
    limit, within = limit or 10**15, within or 10**15
    return f"""WITH {LINES}, {terms},
hits AS (SELECT q.query_id, q.query, l.line_id, l.file_id, l.file_line, l.line FROM terms q JOIN lines l ON contains(l.line, q.query) AND (strlen(q.query) >= 3 OR strlen(l.line) >= 3)),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY file_id) AS fr, row_number() OVER (PARTITION BY query_id, file_id ORDER BY file_line) AS lr FROM hits)
SELECT query_id, query, line_id, file_id, file_line, line FROM ranked WHERE fr <= {limit} AND lr <= {within}"""


@query(_many_sql(_TERMS_SQL, 10, 10))
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = spark.createDataFrame(list(enumerate(TERMS)), "query_id long, query string")
    return search_many(index_of(spark, sf_dir), queries, limit=10, within_file=10)


_PREFIX_TERMS = ("ation", "that an", "thing")
_PREFIX_SQL = "terms AS (SELECT row_number() OVER (ORDER BY t, n) - 1 AS query_id, substr(t, 1, n) AS query FROM (SELECT t, unnest(range(1, length(t) + 1)) AS n FROM (VALUES " + ", ".join(f"({quoted(t)})" for t in _PREFIX_TERMS) + ") v(t)))"


@query(_many_sql(_PREFIX_SQL, 10, 10).replace("SELECT query_id, query, line_id", "SELECT query, line_id"))
def prefix_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = spark.createDataFrame(list(enumerate(tools.prefixes_of(list(_PREFIX_TERMS)))), "query_id long, query string")
    return search_many(index_of(spark, sf_dir), queries, limit=10, within_file=10).drop("query_id")


@query(_many_sql("terms AS (SELECT item_id * 1000 + i AS query_id, q AS query FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS q, unnest(range(len(string_split(text, chr(10))))) AS i FROM benchmark WHERE text IS NOT NULL) WHERE q <> '')", None, None))
def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every benchmark item, searched in all documents, without limits."""
    each = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "query"))
    queries = each.where("query != ''").select((F.col("item_id") * 1000 + F.col("i")).alias("query_id"), "query")
    return search_many(index_of(spark, sf_dir), queries, limit=None, within_file=None)


@query(f"WITH {LINES} SELECT l.file_id, count(*) AS n_lines, count(*) FILTER (WHERE contains(line, 'the')) AS n_matches, max(quality) AS quality FROM lines l LEFT JOIN labels b ON b.doc_id = l.file_id GROUP BY l.file_id")
def matches_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = index_of(spark, sf_dir).lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.contains("line", F.lit("the")).cast("bigint")).alias("n_matches"))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("file_id")).agg(F.max("quality").alias("quality"))
    return per.join(labels, "file_id", "left")


# Other corpora and functions

_PATH = "regexp_replace(coalesce(url, ''), '[?#].*$', '')"
_EXT = f"regexp_extract({_PATH}, '[^.]*$')"
_LANG = "CASE e " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in X.LANGUAGES.items()) + " ELSE '' END"


@query(f"SELECT page_id, e AS extension, {_LANG} AS lang, NOT (e IN ({', '.join(quoted(b) for b in X.BAD_EXTENSIONS)}) OR " + " OR ".join(f"contains(p, '/{d}/')" for d in X.BAD_FOLDERS) + f") AS indexable FROM (SELECT page_id, {_PATH} AS p, {_EXT} AS e FROM pages)")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.coalesce("url", F.lit("")), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", X.extension(path).alias("extension"), X.language(path).alias("lang"), X.path_indexable(path).alias("indexable"))


@query(f"SELECT lang, count(*) AS n_files FROM (SELECT {_LANG} AS lang FROM (SELECT {_EXT} AS e FROM pages)) GROUP BY lang")
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "pages").groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"))


def _corpus_search(name: str, corpus_name: str, term: str, base: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = L.explode_text(corpus(spark, sf_dir, corpus_name)).where(F.contains("line", F.lit(term)))
        return R.limit_matches(hits, limit=50, within_file=5).select("file_id", "file_line", "line")

    QUERIES[name] = run
    ORACLE[name] = f"""WITH c AS ({base}), l AS (SELECT file_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS file_line FROM c),
r AS (SELECT *, dense_rank() OVER (ORDER BY file_id) AS fr, row_number() OVER (PARTITION BY file_id ORDER BY file_line) AS lr FROM l WHERE contains(line, {quoted(term)}))
SELECT file_id, file_line::BIGINT AS file_line, line FROM r WHERE fr <= 50 AND lr <= 5"""


_corpus_search("pages_search", "pages", "</title>", "SELECT page_id AS file_id, html AS t FROM pages")
_corpus_search("conversations_search", "conversations", "ation", "SELECT conv_id AS file_id, string_agg(replace(coalesce(text, ''), chr(10), ' '), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id")
_corpus_search("benchmark_search", "benchmark", "the", "SELECT item_id AS file_id, text AS t FROM benchmark")

_UTF8_HEX = "(0[1-9A-F]|[1-7][0-9A-F]|[CD][0-9A-F]{F}|E[0-9A-F]{F}{F}|F[0-7]{F}{F}{F}|F[89AB]{F}{F}{F}{F}|F[CD]{F}{F}{F}{F}{F})*".replace("{F}", "[89AB][0-9A-F]")


@query(f"SELECT doc_id, regexp_full_match(substr(h, 1, greatest(length(h) - 2 * k, 0)), '{_UTF8_HEX}') AS cut_end, regexp_full_match(substr(h, 2 * k + 1), '{_UTF8_HEX}') AS cut_start FROM (SELECT doc_id, hex(encode(text)) AS h, doc_id % 3 + 1 AS k FROM documents WHERE text IS NOT NULL)")
def utf8_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts but for one to three bytes, which may be parts of characters, on either side."""
    b, k = F.col("text").cast("binary"), (F.col("doc_id") % 3 + 1).cast("int")
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.lenient_utf8(F.substring(b, F.lit(1), F.greatest(n - k, F.lit(0)))).alias("cut_end"), X.lenient_utf8(F.substring(b, k + 1, n)).alias("cut_start"))


@query("SELECT doc_id, strlen(text) > 0 AND regexp_replace(text, '\\n', '', 'g') <> '' AS indexable FROM documents WHERE text IS NOT NULL")
def indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.content_indexable(F.col("text").cast("binary")).alias("indexable"))


@query(f"""WITH {LINES} SELECT line_id, lpad(printf('%X', line_id), 16, '0') AS big_endian, lpad(hex(encode(line)), greatest(16, strlen(line) * 2)::INTEGER, '0') AS padded, ((8 - strlen(line) % 8) % 8)::INTEGER AS padding,
CASE WHEN strlen(line) = 0 THEN 0 ELSE (2 ** ceil(log2(strlen(line))))::BIGINT END AS next_power FROM lines""")
def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("line")
    return index_of(spark, sf_dir).lines.select(
        "line_id", F.hex(N.big_endian(F.col("line_id"))).alias("big_endian"), F.hex(N.pad_key(F.col("line").cast("binary"))).alias("padded"),
        N.word_padding(n).cast("int").alias("padding"), N.next_power_of_two(n.cast("bigint")).alias("next_power"),
    )


@query(f"SELECT page_id, {_PATH} LIKE 'https://%' AS confined, substr(md5(html), 1, 5) AS version, sha1(url || '-' || page_id) AS cache_key, array_to_string(list_transform(range(1, length(url) + 1), lambda i: '&#x' || lower(printf('%X', unicode(substr(url, i, 1)))) || ';'), '') AS entities FROM pages WHERE url IS NOT NULL")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").where("url IS NOT NULL").select(
        "page_id", X.confined(F.regexp_replace(url, "[?#].*$", ""), "https:/").alias("confined"), X.static_version(F.col("html").cast("binary")).alias("version"),
        X.cache_key(url, F.col("page_id")).alias("cache_key"), X.entities(url).alias("entities"),
    )


@query("SELECT count(*) AS searches, sum(value) / count(*) AS ms_per_query FROM events")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.lit(1).alias("n"), F.col("value").alias("ms"))
    return tools.bench_summary(runs).select("searches", "ms_per_query")


__all__ = ["LINES_PER_SHARD", "ORACLE", "QUERIES", "RAREST", "index_of"]
