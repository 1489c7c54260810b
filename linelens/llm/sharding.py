"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with the same text form a group that stays together. A partial partition is
a vector of k sums. Differencing takes the two partial partitions with the
largest spread (largest sum less smallest) and adds them in opposite order, so
that the large sums of one meet the small sums of the other, until one is left.

The groups are differenced in buckets of bounded size, each of which leaves one
partial partition; those are differenced again, up to `fan_in` at a time, until
one is left. So no task holds more than a bucket, whatever the input's size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, content_key, packed

#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over n partial partitions of k sums each.

    Gives the place, an (n, k) array that says to which final part each part of
    each input goes, and the k final sums. Ties go by input order.
    """
    n, k = vectors.shape
    if n == 0:
        return np.zeros((0, k), np.int32), np.zeros(k, np.int64)
    total = 2 * n - 1
    child = np.full((total, 2), -1, np.int64)
    # order[node]: for each part of the node, the part of its first and second child.
    order = np.zeros((total, 2, k), np.int16)
    sums: list[np.ndarray | None] = [v for v in vectors]
    heap = [(-int(v.max() - v.min()), i) for i, v in enumerate(vectors)]
    heapq.heapify(heap)
    node = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        down = np.argsort(-sums[a], kind="stable")
        up = np.argsort(sums[b], kind="stable")
        both = sums[a][down] + sums[b][up]
        child[node] = a, b
        order[node, 0], order[node, 1] = down, up
        sums[a] = sums[b] = None
        sums.append(both)
        heapq.heappush(heap, (-int(both.max() - both.min()), node))
        node += 1
    place = np.zeros((total, k), np.int32)
    place[total - 1] = np.arange(k)
    for at in range(total - 1, n - 1, -1):
        for side in (0, 1):
            place[child[at, side], order[at, side]] = place[at]
    return place[:n], sums[total - 1]


def _first_level(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Largest first, ties by key, so that reruns agree.
        pdf = pdf.sort_values(["__bytes", "__key"], ascending=[False, True], kind="stable")
        vectors = np.zeros((len(pdf), k), np.int64)
        vectors[:, 0] = pdf["__bytes"].to_numpy()
        place, _ = difference(vectors)
        return pd.DataFrame({"__key": pdf["__key"], "__bytes": pdf["__bytes"], "__node": pdf["__node"], "__part": place[:, 0].astype(np.int32)})

    return run


def _next_level(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.sort(pdf["__node"].unique())
        vectors = np.zeros((len(nodes), k), np.int64)
        vectors[np.searchsorted(nodes, pdf["__node"].to_numpy()), pdf["__part"].to_numpy()] = pdf["__bytes"].to_numpy()
        place, sums = difference(vectors)
        up = int(pdf["__up"].iloc[0])
        return pd.DataFrame({
            "__node": np.repeat(nodes, k), "__part": np.tile(np.arange(k, dtype=np.int32), len(nodes)),
            "__up": np.full(len(nodes) * k, up, np.int64), "__up_part": place.reshape(-1).astype(np.int32),
            "__sum": np.tile(sums, len(nodes)).astype(np.int64),
        })

    return run


def group_shards(groups: DataFrame, n_shards: int, scratch: Scratch, *, bucket_groups: int = 20_000, fan_in: int = 500) -> DataFrame:
    """Shards of groups: (__key binary, __bytes long) to (__key, __shard int)."""
    count = groups.count()
    n_buckets = max(1, -(-count // bucket_groups))
    placed = scratch.keep(
        groups.withColumn("__node", F.pmod(F.xxhash64("__key"), F.lit(n_buckets)))
        .groupBy("__node")
        .applyInPandas(_first_level(n_shards), "__key binary, __bytes long, __node long, __part int"),
        "groups",
    )
    sums = placed.groupBy("__node", "__part").agg(F.sum("__bytes").alias("__bytes"))
    while n_buckets > 1:
        up = scratch.keep(
            sums.withColumn("__up", F.expr(f"__node div {fan_in}"))
            .groupBy("__up")
            .applyInPandas(_next_level(n_shards), "__node long, __part int, __up long, __up_part int, __sum long"),
            "level",
        )
        placed = placed.join(up.select("__node", "__part", "__up", "__up_part"), ["__node", "__part"]).select("__key", F.col("__up").alias("__node"), F.col("__up_part").alias("__part"))
        sums = up.groupBy("__up", "__up_part", "__sum").agg(F.count(F.lit(1)).alias("__n")).select(F.col("__up").alias("__node"), F.col("__up_part").alias("__part"), F.col("__sum").alias("__bytes"))
        n_buckets = -(-n_buckets // fan_in)
    return placed.select("__key", F.col("__part").alias("__shard"))


def assign_shards(
    docs: DataFrame, n_shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text",
    carry: bool = False, block_rows: int = 20_000, bucket_groups: int = 20_000, fan_in: int = 500,
) -> DataFrame:
    """Deal rows into shards whose bytes are near equal; equal texts stay together.

    Returns id, size (UTF-8 bytes of the text plus 16), text_crc32, law ('bytes'),
    shard, slot (gapless from 0 in each shard) and grown_shard (null: the law is not
    'key'). With `carry` the input's other columns follow; one that has the name of
    a result column gets `_in` behind its name, once more if that is taken, too.

    Null texts have size 16 and a null crc32; they are one group, empty texts
    another. Rows with the same id are dealt like any others. An empty table gives an
    empty result. Rows of a shard are in order of a hash block, then of id, crc32
    and size.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")
    crc = F.crc32(text.cast("binary"))
    named = [F.col(id_col), size.alias("size"), crc.alias("text_crc32"), content_key(text).alias("__key")]
    out = [id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    light = scratch.keep(docs.select(*named), "rows")
    groups = light.groupBy("__key").agg(F.sum("size").alias("__bytes"))
    shards = scratch.keep(group_shards(groups, n_shards, scratch, bucket_groups=bucket_groups, fan_in=fan_in), "shards")

    rows = light.count()
    n_blocks = max(4, -(-rows // (n_shards * block_rows)))
    block = F.pmod(F.xxhash64(F.col(id_col), F.col("text_crc32")), F.lit(n_blocks)).alias("__block")

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(shards, "__key").select("*", block)

    # Only counts meet here: n_shards * n_blocks rows.
    ahead = Window.partitionBy("__shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt(light).groupBy("__shard", "__block").agg(F.count(F.lit(1)).alias("__n")).select("__shard", "__block", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    more: dict[str, str] = {}
    for c in docs.columns if carry else []:
        if c != id_col:
            name = c
            while name in out or name in more.values() or (name != c and name in docs.columns):
                name += "_in"
            more[c] = name
    full = docs.select(*named, packed(docs)) if carry else light
    inside = Window.partitionBy("__shard", "__block").orderBy(id_col, "text_crc32", "size")
    return (
        dealt(full)
        .withColumn("__rn", F.row_number().over(inside))
        .join(starts, ["__shard", "__block"])
        .select(
            id_col, "size", "text_crc32", F.lit("bytes").alias("law"), F.col("__shard").alias("shard"),
            (F.col("__start") + F.col("__rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(F.col("__row").getField(c).alias(n) for c, n in more.items()),
        )
    )
