"""SimHash near duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at up to four differing bits. Cut into three
segments, at least one segment of a linked pair differs in at most one bit (two
in each would be six). A segment is indexed once for each of its bits with that
bit left out; two segments that differ in at most one bit agree in such a
variant. Rows are joined by equal variants, and the whole fingerprints compared.

Only distinct fingerprints are indexed, so copies cost nothing more. In buckets of few
fingerprints a linked pair is kept at one of the variants that it shares, so it comes
out once; of a larger bucket only a spanning forest of its links comes out, which
connects the same fingerprints. So links are no more than a few for each variant,
however many near copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, map_batches, packed, raw, unpacked

WORDS, SEED, MOST = 4, 42, 4
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Borders of the pieces of the bits outside a segment, and fingerprints from which on they lengthen the keys.
PIECES, MANY = (0, 9, 18, 27, 35, 43), 1 << 26
#: Shingles hashed at a time.
CHUNK = 1 << 16
#: Fingerprints of a bucket up to which all its linked pairs come out, and of a forest's front that are compared at a time.
FEW, FRONT = 9, 64
#: Neighbours from which on a node is a hub at least, and hubs at most (their rows go to all tasks).
HUB, MOST_HUBS = 200, 100_000


def fingerprint(text: bytes | None) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' hashes."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(WORDS, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, __fp long) of every row; the long has the fingerprint's 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x) for x in raw(batch.column(1))], "<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], [id_col, "__fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, __fp long")


def _home(x: np.ndarray) -> np.ndarray:
    """The variant at which a pair with these differing bits is kept."""
    out = np.full(len(x), 64, np.int64)
    for first, width in reversed(SEGMENTS):
        y = x >> np.uint64(first) & np.uint64((1 << width) - 1)
        # For a power of two, the bits below it count its place.
        at = first + np.where(y == 0, 0, np.bitwise_count(y - np.uint64(1))).astype(np.int64)
        out = np.where(np.bitwise_count(y) <= 1, at, out)
    return out


def forest(prints: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what links of at most `most` differing bits connect; less than there are fingerprints."""
    rest = prints
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            now, front = front[:FRONT], front[FRONT:]
            near = np.bitwise_count(now[:, None] ^ rest[None]) <= most
            found = near.any(0)
            if found.any():
                linked = rest[found]
                yield now[near[:, found].argmax(0)], linked
                front, rest = np.concatenate((front, linked)), rest[~found]


def bucket_links(keys: np.ndarray, prints: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of buckets: rows in order of keys and fingerprints, and the variant that a key belongs to."""
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((begins, [len(keys)])))
    size = np.repeat(sizes, sizes)
    for step in range(1, FEW):
        i = np.flatnonzero((keys[:-step] == keys[step:]) & (size[:-step] <= FEW)) if step < len(keys) else np.zeros(0, np.int64)
        differ = prints[i] ^ prints[i + step]
        i, differ = i[ok := np.bitwise_count(differ) <= most], differ[ok]
        i = i[_home(differ) == at[i]]
        yield prints[i], prints[i + step]
    for first, n in zip(begins[sizes > FEW], sizes[sizes > FEW]):
        yield from forest(prints[first : first + n], most)


def links(prints: DataFrame, *, most: int = MOST, anchored: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints (column __fp) that link; of large groups those that connect it.

    With very many fingerprints a variant's key of some 20 bits meets too many others.
    `anchored` keys are longer by one of five pieces of the other two segments: of the
    at most four bits that differ there, one piece has none. There are five times as many
    keys, each of which meets about 400 times fewer others; what is connected is the same.
    """
    if anchored and most > 4:
        raise ValueError("five pieces have an equal one for at most four differing bits")
    shift = F.expr("CASE WHEN __at < 22 THEN 0 WHEN __at < 43 THEN 22 ELSE 43 END")
    width = F.expr("CASE WHEN __at < 22 THEN 22 ELSE 21 END")
    at = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("__at")
    part = F.expr("shiftrightunsigned(__fp, __shift) & (shiftleft(1L, __width) - 1) & ~shiftleft(1L, __at - __shift)")
    variants = prints.select("__fp", at).select("__fp", "__at", shift.alias("__shift"), width.alias("__width")).select("__fp", "__shift", "__width", (F.shiftleft(F.col("__at").cast("long"), 22) + part).alias("__key"))
    low = 22
    if anchored:
        # The bits outside the segment stand above it after a rotation.
        rest = "shiftrightunsigned(shiftrightunsigned(__fp, __shift) | shiftleft(__fp, 64 - __shift), __width)"
        piece = [F.expr(f"shiftrightunsigned({rest}, {PIECES[j]}) & {(1 << PIECES[j + 1] - PIECES[j]) - 1}L") for j in range(5)]
        pieces = F.explode(F.array(*(F.lit(j * 512) + v for j, v in enumerate(piece)))).alias("__piece")
        variants = variants.select("__fp", "__key", pieces).withColumn("__key", F.col("__key") * 4096 + F.col("__piece"))
        low += 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            own = np.concatenate((own, batch.column(1).to_numpy().view(np.uint64)))
            # The last bucket may go on in the next batch.
            stop = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield from found(keys[:stop], own[:stop])
            keys, own = keys[stop:], own[stop:]
        yield from found(keys, own)

    def found(keys: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in bucket_links(keys, own, keys >> low, most) if len(keys) else ():
            if len(a):
                a, b = a.view(np.int64), b.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = variants.select("__key", "__fp").repartition("__key").sortWithinPartitions("__key", "__fp")
    return map_batches(dealt, run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The smallest node of each node's component: (a, b) to (u, root).

    Alternates the large star and the small star (Kiveris et al., 2014) until
    nothing changes; each round is an aggregate and a join on the node, written to
    the shared folder.
    """
    now = scratch.keep(edges.select("a", "b"), "edges")
    state = None
    while True:
        before, state = state, now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if state == before:
            return now.select(F.col("a").alias("u"), F.col("b").alias("root"))
        # Large star: each larger neighbour of u goes to the smallest of u and its neighbours.
        both = now.union(now.select("b", "a"))
        large = _with_least(both, both.where("b > a"), 2 * state[0], scratch).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a != b").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them; here a > b always.
        large = scratch.keep(large, "large")
        small = _with_least(large, large, 2 * state[0], scratch).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        after = scratch.keep(small, "small")
        scratch.drop(now)
        scratch.drop(large)
        now = after


def _with_least(pairs: DataFrame, wanted: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """wanted (a, b) with m, the smallest b of a in pairs, which are `most` rows at most.

    Nodes with many neighbours are hubs; there are MOST_HUBS of them at most, and their
    rows meet the pairs where those are. The others' pairs are dealt by node.
    """
    least = scratch.keep(pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    cut = max(HUB, most // MOST_HUBS)
    hubs = F.broadcast(least.where(F.col("n") > cut).select("a", "m"))
    rest = wanted.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("n") <= cut).select("a", "m"), "a")
    return wanted.join(hubs, "a").unionByName(rest)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row for each document: id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased (A-Z), cut into words at white space and into shingles of
    four words, repeats included; fewer words are one shingle. Null, empty and blank
    texts have the fingerprint zero, which links like any other. component_id is the
    smallest id that can be reached over linked fingerprints (null only if all ids
    there are null). Repeated rows and ids give a row each; an empty table gives none.
    """
    if most > 5:
        raise ValueError("three segments with one wildcard find pairs of at most five differing bits")
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, id_col=id_col, text_col=text_col), "prints")
    labels = labelled(prints, scratch, id_col=id_col, most=most)
    return prints.join(labels, "__fp").select(id_col, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__component").alias("component_id"))


def labelled(prints: DataFrame, scratch: Scratch, *, id_col: str, most: int = MOST) -> DataFrame:
    """(__fp, __root, __component) of every distinct fingerprint of (id, __fp): its component's first fingerprint and smallest id."""
    firsts = scratch.keep(prints.groupBy("__fp").agg(F.min(id_col).alias("__first")), "firsts")
    # The longer keys pay for themselves with many fingerprints; the links are the same.
    roots = components(links(firsts.select("__fp"), most=most, anchored=most <= 4 and firsts.count() >= MANY), scratch)
    linked = roots.select(F.col("u").alias("__fp"), "root").union(roots.select(F.col("root").alias("__fp"), "root").distinct())
    named = linked.join(firsts, "__fp")
    smallest = named.groupBy("root").agg(F.min("__first").alias("__component"))
    return scratch.keep(firsts.join(linked.join(smallest, "root").select("__fp", "root", "__component"), "__fp", "left").select("__fp", F.coalesce("root", "__fp").alias("__root"), F.when(F.col("root").isNull(), F.col("__first")).otherwise(F.col("__component")).alias("__component")), "labels")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """The rows of docs that stay: one of each component, that with the smallest id.

    Where a component has that id several times, one of those rows stays; a component
    without any id keeps one row.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    prints = scratch.keep(fingerprints(docs, id_col=id_col, text_col=text_col), "prints")
    labels = labelled(prints, scratch, id_col=id_col, most=most)
    heads = prints.join(labels, "__fp").where(F.col(id_col).eqNullSafe(F.col("__component"))).groupBy(F.col(id_col).alias("__head")).agg(F.count(F.lit(1)).alias("__n"))
    heads = scratch.keep(heads, "heads")
    rows = docs.select(F.col(id_col).alias("__id"), packed(docs))
    once = rows.join(heads.where("__n = 1 AND __head IS NOT NULL"), F.col("__id") == F.col("__head"), "left_semi").select(*unpacked(docs.columns))
    again = heads.where("__n > 1 OR __head IS NULL")
    if again.isEmpty():
        return once
    # Ids that lead more than one row: their rows get marks of their own, and one row of each component stays.
    some = scratch.keep(rows.join(again, F.col("__id").eqNullSafe(F.col("__head")), "left_semi").withColumn("__mark", F.expr("uuid()")), "again")
    marked = fingerprints(some.select("__mark", F.col("__row").getField(text_col).alias("__text")), id_col="__mark", text_col="__text")
    led = marked.join(some.select("__mark", "__id"), "__mark").join(labels, "__fp").where(F.col("__id").eqNullSafe(F.col("__component")))
    picked = led.groupBy("__root").agg(F.min(F.struct("__fp", "__mark")).alias("p")).select(F.col("p.__mark").alias("__picked"))
    return once.unionByName(some.join(picked, F.col("__mark") == F.col("__picked"), "left_semi").select(*unpacked(docs.columns)))
