"""Byte n-grams of lines and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 3


def as_bytes(c: Column) -> Column:
    """A string's bytes as they are; encode() would replace malformed ones."""
    return c.cast("binary")


def trigrams(line: Column, size: int = SIZE) -> Column:
    """Distinct windows of `size` bytes; shorter lines have none."""
    b, n = as_bytes(line), F.octet_length(line)
    # The guard matters: sequence(1, 0) counts down. Spark hashes strings for a distinct,
    # but compares binaries pair by pair; the casts keep the bytes as they are.
    windows = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(b, i, F.lit(size)).cast("string"))
    distinct = F.transform(F.array_distinct(windows), lambda x: x.cast("binary"))
    return F.when(n >= size, distinct).otherwise(F.array().cast("array<binary>"))


def query_trigrams(query: str | bytes, size: int = SIZE) -> list[bytes]:
    """Distinct n-grams of a query in byte order."""
    b = query.encode() if isinstance(query, str) else query
    return sorted({b[i : i + size] for i in range(len(b) - size + 1)})


def delta_encode(ids: Column) -> Column:
    """Sorted ids to gaps; the first gap is from zero."""
    return F.transform(ids, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.element_at(ids, F.greatest(i, F.lit(1)))))


def delta_decode(gaps: Column) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out"))
    return F.aggregate(gaps, start, step, lambda acc: acc["out"])


def big_endian(n: Column, width: int = 8) -> Column:
    """A number as bytes whose order is that of the numbers."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2 * width, "0"))


def from_big_endian(b: Column) -> Column:
    return F.conv(F.hex(b), 16, 10).cast("bigint")


def pad_key(b: Column, width: int = 8) -> Column:
    """Bytes filled with NUL on the left; longer ones stay as they are."""
    return F.when(F.octet_length(b) >= width, b).otherwise(F.lpad(b, width, b"\x00"))


def word_padding(n: Column, word: int = 8) -> Column:
    """What a size lacks to a multiple of `word`."""
    return F.pmod(F.lit(word) - n % word, F.lit(word))


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two that isn't below n; zero stays."""
    # 64 less the leading zeros of n - 1, counted as the length of its binary form.
    bits = F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.expr("1L").cast("bigint") * F.pow(F.lit(2.0), bits).cast("bigint"))
