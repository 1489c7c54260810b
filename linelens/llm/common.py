"""Helpers that the operators share: scratch tables and texts as bytes."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, shared_dir

#: Bytes of text that a Python worker turns into words at a time.
BLOCK_BYTES = 4 << 20
#: Bytes of an Arrow batch for a Python worker.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: ASCII capitals to small letters, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> Column:
    """All columns as one, so that none can clash with a name of ours."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row")


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("__row").getField(c).alias(c) for c in names]


class Scratch:
    """Tables written to the shared folder, which cut the lineage at that point."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/linelens/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and give back the table as written."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Delete a table that no later step reads."""
        delete(self.spark, kept._scratch_path)


def raw(array: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column's UTF-8 bytes, undecoded."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_string(array.type):
        array = array.cast(pa.binary())
    elif pa.types.is_large_string(array.type):
        array = array.cast(pa.large_binary())
    return array.to_pylist()


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow in batches of a few MB, so that long texts don't pile up in the workers.

    The bound is a setting of the session; one that is set already stays.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


class Sent:
    """An object broadcast with its class, so that workers need no copy of this package.

    A worker holds the last few that it used; others are read from the broadcast again.
    """

    HELD = 3
    used: list = []

    def __init__(self, spark: SparkSession, value):
        self._broadcast = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._broadcast.value)
            self.used.append(self)
            if len(self.used) > self.HELD:
                self.used.pop(0)._value = None
        return self._value


def blocks(texts: list[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a list of texts of about `limit` bytes each; a longer text is alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if texts:
        yield start, len(texts)


def content_key(text: Column) -> Column:
    """32 bytes that stand for a text; null and empty texts have keys of their own."""
    return F.when(text.isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(text.cast("binary"), 256)))
