import pytest
from pyspark.sql import functions as F

from linelens.functions import ngrams as N
from linelens.functions import text as X


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, (bytes, bytearray)) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "data, lenient, strict",
    [
        (b"", True, True), (b"a\x00", False, True), (b"\xc3\xa9", True, True), (b"\xc3\xc3\xa9", False, False), (b"\x80", False, False),
        (b"\xed\xa0\x80", True, False), (b"\xc0\x80", True, False), (b"\xf8\x88\x80\x80\x80", True, False), (b"\xfc\x84\x80\x80\x80\x80", True, False),
        (b"\xfe", False, False), (b"\xc3", False, False), (b"a\rb", True, True),
    ],
)
def test_utf8(spark, data, lenient, strict):
    assert one(spark, X.lenient_utf8(F.col("b")), b=bytearray(data)) is lenient
    assert one(spark, X.strict_utf8(F.col("b")), b=bytearray(data)) is strict


def test_utf8_allow_null(spark):
    assert one(spark, X.lenient_utf8(F.col("b"), allow_null=True), b=bytearray(b"a\x00")) is True


@pytest.mark.parametrize(
    "path, ext, lang, ok",
    [
        ("/s/a.cc", "cc", "c++", True), ("/s/a.h", "h", "c", True), ("/s/a.C", "C", "c++", True), ("/s/.gitignore", "gitignore", "text", True),
        ("/s/__init__.py", "py", "python", True), ("/s/Makefile", "/s/Makefile", "", True), ("/a.b/Makefile", "b/Makefile", "", True),
        ("/s/x.unknown", "unknown", "", True), ("/s/x.pdf", "pdf", "", False), ("/s/x.so", "so", "", False), ("/s/.git/config.py", "py", "python", False),
    ],
)
def test_paths(spark, path, ext, lang, ok):
    p = F.col("p")
    assert one(spark, X.extension(p), p=path) == ext
    assert one(spark, X.language(p), p=path) == lang
    assert one(spark, X.path_indexable(p), p=path) is ok


def test_language_by_basename(spark):
    assert one(spark, X.language(F.col("p"), by_basename=True), p="/s/Makefile") == "make"


@pytest.mark.parametrize(
    "content, ok",
    [(b"", False), (b"\n\n", False), (b"x", True), (b"a" * 20 + b"\n\xff", True), (b"a" * 20 + b"\n\xff\xff", False), (b"a" * 10_000 + b"\n" + b"\xff" * 5_000, True), (b"a" * 9_990 + b"\n" + b"\xff" * 5_000, False)],
)
def test_content_indexable(spark, content, ok):
    assert one(spark, X.content_indexable(F.col("b")), b=bytearray(content)) is ok


def test_trigrams(spark):
    assert [bytes(b) for b in one(spark, N.trigrams(F.col("s")), s="index")] == [b"ind", b"nde", b"dex"]
    assert one(spark, N.trigrams(F.col("s")), s="ab") == []
    assert one(spark, N.trigrams(F.col("s")), s="") == []
    assert [bytes(b) for b in one(spark, N.trigrams(F.col("s")), s="aaaa")] == [b"aaa"]
    assert N.query_trigrams("éa") == ["éa".encode()]
    assert N.query_trigrams("ab") == []


def test_codecs(spark):
    df = spark.sql("SELECT array(3L, 7L, 8L, 20L) AS ids, array(3L) AS single, CAST(array() AS array<bigint>) AS none")
    for name in ("ids", "single", "none"):
        back = df.select(F.col(name).alias("a"), N.delta_decode(N.delta_encode(F.col(name))).alias("b")).first()
        assert back["a"] == back["b"]
    assert df.select(N.delta_encode(F.col("ids")).alias("g")).first()["g"] == [3, 4, 1, 12]
    assert bytes(one(spark, N.big_endian(F.col("n")), n=258)) == bytes([0] * 6 + [1, 2])
    assert one(spark, N.from_big_endian(N.big_endian(F.col("n"))), n=2**40 + 5) == 2**40 + 5
    assert bytes(one(spark, N.pad_key(F.col("b")), b=bytearray(b"abc"))) == b"\0\0\0\0\0abc"
    assert [one(spark, N.word_padding(F.col("n")), n=n) for n in (0, 1, 8, 9)] == [0, 7, 0, 7]
    assert [one(spark, N.next_power_of_two(F.col("n")), n=n) for n in (0, 1, 2, 3, 4, 5, 1000, 2**40, 2**40 + 1)] == [0, 1, 2, 4, 4, 8, 1024, 2**40, 2**41]


def test_printable_and_highlight(spark):
    assert one(spark, X.printable(F.col("b")), b=bytearray(b"a b\\\xc3\x00")) == "a\\x20b\\\\xc3\\x00"
    assert one(spark, X.printable(F.col("b")), b=bytearray(b"")) == ""
    assert one(spark, X.highlight_html(F.col("s"), "a<"), s="xa<y'") == "x<strong>a&lt;</strong>y&#39;"
    assert one(spark, X.highlight_ansi(F.col("s"), "aa", F.lit(True), "[", "]"), s="aaaaa") == "[aa][aa]a"
    assert one(spark, X.highlight_ansi(F.col("s"), "aa", F.lit(False), "[", "]"), s="aaaaa") == "aaaaa"
    assert one(spark, X.prefixes(F.col("s")), s="mmap") == ["m", "mm", "mma", "mmap"]
    assert one(spark, X.prefixes(F.col("s")), s="") == []
    assert one(spark, X.entities(F.col("s")), s="a@") == "&#x61;&#x40;"
    assert one(spark, X.locator(F.col("s"), F.lit(3)), s="f") == "f@@line-3"


def test_confined(spark):
    assert [one(spark, X.confined(F.col("p"), "/src"), p=p) for p in ("/src", "/src/a", "/src-evil", "/etc")] == [True, True, False, False]
