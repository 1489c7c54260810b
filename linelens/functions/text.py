"""Functions on text, paths and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions and their languages.
LANGUAGES = {
    "C": "c++",
    "LICENSE": "text",
    "Makefile": "make",
    "NOTICE": "text",
    "README": "text",
    "S": "asm",
    "ada": "ada",
    "am": "make",
    "asm": "asm",
    "bash": "shell",
    "bat": "shell",
    "c": "c",
    "cc": "c++",
    "clj": "clojure",
    "conf": "text",
    "cpp": "c++",
    "cs": "csharp",
    "css": "css",
    "el": "elisp",
    "gitignore": "text",
    "go": "go",
    "h": "c",
    "hh": "c++",
    "hpp": "c++",
    "hs": "haskell",
    "htm": "html",
    "html": "html",
    "in": "make",
    "ipp": "c++",
    "java": "java",
    "js": "javascript",
    "json": "javascript",
    "lua": "lua",
    "m": "obj-c",
    "m4": "m4",
    "man": "man",
    "md": "text",
    "mk": "make",
    "ml": "ml",
    "mm": "obj-c",
    "php": "php",
    "pl": "perl",
    "pm": "perl",
    "proto": "protobuf",
    "py": "python",
    "rb": "ruby",
    "s": "asm",
    "sh": "shell",
    "sql": "sql",
    "tex": "tex",
    "txt": "text",
    "vb": "vb",
    "vbs": "vb",
    "xhtml": "html",
    "xml": "xml",
    "xsd": "xml",
    "yaml": "yaml",
    "yml": "yaml",
}
#: Extensions and folders that are never indexed.
BAD_EXTENSIONS = ("a", "jpeg", "jpg", "mo", "o", "pdf", "png", "so", "swp")
BAD_FOLDERS = (".git", ".hg", ".repo", ".svn")
#: Bytes of a file that are looked at, and valid ones wanted for each invalid one.
LOOKED_AT, VALID_SHARE = 10_000, 20

#: Units of UTF-8 as it was first defined: up to six bytes, overlong forms and surrogates too; no NUL.
UTF8_UNIT = "[\\x01-\\x7F]|[\\xC0-\\xDF][\\x80-\\xBF]|[\\xE0-\\xEF][\\x80-\\xBF]{2}|[\\xF0-\\xF7][\\x80-\\xBF]{3}|[\\xF8-\\xFB][\\x80-\\xBF]{4}|[\\xFC-\\xFD][\\x80-\\xBF]{5}"
NUL_UNIT = "|\\x00"


def lenient_utf8(b: Column, *, allow_null: bool = False) -> Column:
    """True if bytes are a row of UTF-8 units by the lenient rule."""
    # Lead and following bytes are apart, so taking out units anywhere equals reading from the start.
    return F.regexp_replace(F.decode(b, "ISO-8859-1"), UTF8_UNIT + (NUL_UNIT if allow_null else ""), "") == ""


def strict_utf8(b: Column) -> Column:
    return F.is_valid_utf8(b.cast("string"))


def split_lines(content: Column) -> Column:
    """Lines of binary content as binary; one more than there are line ends."""
    return F.transform(F.split(F.decode(content, "ISO-8859-1"), "\n", -1), lambda x: F.encode(x, "ISO-8859-1"))


def extension(path: Column) -> Column:
    """What follows the last dot of the whole path; without a dot the path."""
    return F.regexp_extract(path, "[^.]*$", 0)


def language(path: Column, *, by_basename: bool = False) -> Column:
    """The language of a path's extension, or an empty string.

    Bare names such as Makefile never match an absolute path unless `by_basename` is set.
    """
    name = F.regexp_extract(path, "[^/]*$", 0) if by_basename else path
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, extension(name)), F.lit(""))


def path_indexable(path: Column) -> Column:
    """Path rules: folders of version control, and extensions of binary files, are left out."""
    out = ~extension(path).isin(*BAD_EXTENSIONS)
    for folder in BAD_FOLDERS:
        out = out & ~path.contains(f"/{folder}/")
    return out


def content_indexable(content: Column, *, looked_at: int = LOOKED_AT, share: int = VALID_SHARE) -> Column:
    """Enough valid bytes in the lines that start among the first `looked_at` bytes.

    Line ends count for neither side. Content without a valid byte isn't indexed.
    """
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("bad"))

    def step(acc: Column, line: Column) -> Column:
        n = F.octet_length(line).cast("bigint")
        seen = acc["at"] < looked_at
        good = lenient_utf8(line)
        return F.struct((acc["at"] + n + 1).alias("at"), (acc["good"] + F.when(seen & good, n).otherwise(0)).alias("good"), (acc["bad"] + F.when(seen & ~good, n).otherwise(0)).alias("bad"))

    # A line that starts within the first bytes counts whole; those behind aren't looked at.
    return F.aggregate(split_lines(content), state, step, lambda acc: (acc["good"] > 0) & (acc["good"] >= share * acc["bad"]))


def printable(b: Column) -> Column:
    """Visible ASCII as it is, other bytes as \\xNN."""
    h = F.hex(b)
    each = F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.substring(h, i * 2 - 1, F.lit(2)))
    shown = F.transform(each, lambda x: F.when((x >= "21") & (x <= "7E"), F.char(F.conv(x, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\x"), F.lower(x))))
    return F.when(F.octet_length(b) == 0, F.lit("")).otherwise(F.array_join(shown, ""))


def xhtml_escape(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def highlight_html(line: Column, query: str, before: str = "<strong>", after: str = "</strong>") -> Column:
    """Escape the line and mark the escaped query in it."""
    q = xhtml_escape(F.lit(query))
    return F.replace(xhtml_escape(line), q, F.concat(F.lit(before), q, F.lit(after))) if query else xhtml_escape(line)


def highlight_ansi(line: Column, query: str, matched: Column, before: str = "\x1b[1;31m", after: str = "\x1b[0m") -> Column:
    """Mark every occurrence in matched lines, from left to right."""
    return F.when(matched, F.replace(line, F.lit(query), F.lit(before + query + after))).otherwise(line) if query else line


def locator(filename: Column, line_num: Column) -> Column:
    return F.concat(filename, F.lit("@@line-"), line_num.cast("string"))


def prefixes(query: Column) -> Column:
    """All beginnings of a query, from one character on."""
    n = F.length(query)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(query, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def workload_lines(line: Column) -> Column:
    """True for the lines of a query file that are queries."""
    return (line != "") & ~line.startswith("#")


def entities(c: Column) -> Column:
    """Every character as a numeric entity."""
    return F.array_join(F.transform(F.filter(F.split(c, "", -1), lambda x: x != ""), lambda x: F.concat(F.lit("&#x"), F.lower(F.hex(F.ascii(x))), F.lit(";"))), "")


def static_version(content: Column) -> Column:
    """Five hex digits that change with the content."""
    return F.substring(F.md5(content), 1, 5)


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("-", *(p.cast("string") for p in parts)))


def confined(path: Column, root: str) -> Column:
    """True for the root itself and for paths below it."""
    base = root.rstrip("/")
    return (path == base) | path.startswith(base + "/")
