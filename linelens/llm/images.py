"""Copies of images by local descriptors.

Corners are found at several scales; the patch around each is turned to its main
direction and described by binary tests on pairs of its pixels. Descriptors meet in
Hamming tables: cut into six parts, two that differ in at most five bits agree in
one part for sure, others with a chance that falls with the bits. Two images are
linked if enough of their matches agree on one turn, scale and shift, which holds for
cropped, turned, resized and edited copies.

Images with equal pixels count once. Two images of which any two keypoints match in a
bucket are compared by all their keypoints. In large buckets of different classes of linked
images all first meet one keypoint of the class that leads there, the largest or else the
last in the order of a seeded hash, and each image is compared with one image of a leading
class, so that a large group of copies becomes one class, and images linked to some of it
come into it, by a few comparisons for each. This is repeated, each time in another order,
until two passes in a row take less than a quarter of what is left. Then all keypoints of
different classes in a bucket meet, in buckets of any size: no pair of a bucket is left out
but those of one class. What the tables find is measured against all pairs in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches
from .simhash import components

#: Bits and parts of a descriptor, most differing bits of a match, least matches of a link.
BITS, PARTS, MOST_BITS, LEAST_MATCHES = 256, 6, 24, 5
#: Keypoints of a tile at the first scales (the last number holds for all others), a tile's side, the scales' factor, steps of directions, and the reach of a patch.
STRONGEST, TILE, FACTOR, TURNS, REACH = (12, 9, 7, 5, 4), 42, 1.25, 36, 10
#: Keypoints up to which a bucket is compared pair by pair at once, and those of a block of a bucket.
FEW, BLOCK = 8, 1000
#: Cell of the vote on a shift, in pixels.
SHIFT = 6
HALVES = ("d0", "d1", "d2", "d3")
POINTS = "image_id long, point int, x float, y float, level int, turn int, " + ", ".join(f"{d} long" for d in HALVES)


#: Tables that are made once in each worker.
MADE: dict = {}


def tests() -> np.ndarray:
    """Pixel pairs of the tests, for each direction: (TURNS, BITS, 4) offsets x1, y1, x2, y2."""
    if "tests" in MADE:
        return MADE["tests"]
    draw = np.random.RandomState(20240229)
    pairs = np.clip(draw.normal(0, REACH * 0.7, (BITS, 2, 2)), -REACH * 0.7, REACH * 0.7)
    out = []
    for t in range(TURNS):
        a = 2 * np.pi * t / TURNS
        out.append(np.rint(pairs @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])).astype(np.int64).reshape(BITS, 4))
    MADE["tests"] = np.stack(out)
    return MADE["tests"]


def disc() -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[-7:8, -7:8]
    inside = x * x + y * y <= 49
    return x[inside], y[inside]


def blur(x: np.ndarray) -> np.ndarray:
    """Binomial filter of width five over the last two axes; edges repeat."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (2, 2)
        p = np.pad(x, pad, mode="edge")
        n = x.shape[axis]
        cut = lambda k: p[:, k : k + n] if axis == 1 else p[:, :, k : k + n]  # noqa: B023, E731
        x = (cut(0) + cut(4) + 4 * (cut(1) + cut(3)) + 6 * cut(2)) / 16
    return x


def shrink(x: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear resampling to a smaller size."""
    h, w = int(x.shape[1] / factor), int(x.shape[2] / factor)
    ys, xs = (np.arange(h) + 0.5) * factor - 0.5, (np.arange(w) + 0.5) * factor - 0.5
    y0, x0 = np.clip(np.floor(ys).astype(int), 0, x.shape[1] - 2), np.clip(np.floor(xs).astype(int), 0, x.shape[2] - 2)
    fy, fx = np.clip(ys - y0, 0, 1)[None, :, None].astype(np.float32), np.clip(xs - x0, 0, 1)[None, None, :].astype(np.float32)
    top, low = x[:, y0], x[:, y0 + 1]
    rows = top + (low - top) * fy
    return rows[:, :, x0] + (rows[:, :, x0 + 1] - rows[:, :, x0]) * fx


def describe_batch(pixels: np.ndarray) -> list[np.ndarray]:
    """Keypoints of images of one size, (n, height, width) of uint8.

    Gives arrays image, x, y, level, turn and the four words of the descriptor, in
    order of image, level, tile and strength. Their number grows with the image's area,
    and scales are taken until the image is too small. Images under 26 pixels have none.
    """
    image = blur(pixels.astype(np.float32))
    out: list[list[np.ndarray]] = []
    scale = 1.0
    margin = REACH + 1
    for level in count():
        n, h, w = image.shape
        if min(h, w) < 2 * margin + 4:
            break
        gx, gy = np.zeros_like(image), np.zeros_like(image)
        gx[:, :, 1:-1], gy[:, 1:-1] = image[:, :, 2:] - image[:, :, :-2], image[:, 2:] - image[:, :-2]
        xx, yy, xy = blur(gx * gx), blur(gy * gy), blur(gx * gy)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        peak = strength[:, 1:-1, 1:-1]
        best = np.ones(peak.shape, bool)
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (dy, dx) != (1, 1):
                    best &= peak >= strength[:, dy : dy + h - 2, dx : dx + w - 2]
        value = np.zeros_like(strength)
        value[:, 1:-1, 1:-1] = np.where(best & (peak > 1.0), peak, 0)
        inner = value[:, margin : h - margin, margin : w - margin]
        th, tw = min(TILE, inner.shape[1]), min(TILE, inner.shape[2])
        ny, nx = -(-inner.shape[1] // th), -(-inner.shape[2] // tw)
        inner = np.pad(inner, ((0, 0), (0, ny * th - inner.shape[1]), (0, nx * tw - inner.shape[2])))
        inner = inner.reshape(n, ny, th, nx, tw).transpose(0, 1, 3, 2, 4).reshape(n * ny * nx, th * tw)
        k = min(STRONGEST[min(level, len(STRONGEST) - 1)], inner.shape[1])
        place = np.argsort(-inner, axis=1, kind="stable")[:, :k].reshape(-1)
        tile = np.repeat(np.arange(n * ny * nx), k)
        ok = inner[tile, place] > 0
        tile, place = tile[ok], place[ok]
        who = tile // (ny * nx)
        y, x = tile // nx % ny * th + place // tw + margin, tile % nx * tw + place % tw + margin
        smooth = blur(blur(image))
        ox, oy = disc()
        patch = smooth[who[:, None], y[:, None] + oy[None], x[:, None] + ox[None]]
        angle = np.arctan2((patch * oy).sum(1), (patch * ox).sum(1))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        t = tests()[turn]
        first = smooth[who[:, None], y[:, None] + t[:, :, 1], x[:, None] + t[:, :, 0]]
        second = smooth[who[:, None], y[:, None] + t[:, :, 3], x[:, None] + t[:, :, 2]]
        words = np.packbits(first < second, axis=1).view(">i8").astype(np.int64).reshape(-1, 4)
        out.append([who, ((x + 0.5) * scale).astype(np.float32), ((y + 0.5) * scale).astype(np.float32), np.full(len(who), level), turn, *words.T])
        image = shrink(image, FACTOR)
        scale *= FACTOR
    if not out:
        return [np.zeros(0, np.int64), *(np.zeros(0, np.float32),) * 2, *(np.zeros(0, np.int64),) * 6]
    joined = [np.concatenate(x) for x in zip(*out)]
    order = np.argsort(joined[0], kind="stable")
    return [x[order] for x in joined]


def describe(images: DataFrame, *, id_col: str = "image_id") -> DataFrame:
    """Keypoints and descriptors of grey images (id, width, height, pixels binary).

    Images whose pixels are null or not width * height bytes have no keypoints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in POINTS.split(", ")]
        for batch in batches:
            ids, widths, heights, pixels = (batch.column(i).to_pylist() for i in range(4))
            by_size: dict[tuple[int, int], list[int]] = {}
            for i, (w, h, p) in enumerate(zip(widths, heights, pixels)):
                if p is not None and w and h and w > 0 and len(p) == w * h:
                    by_size.setdefault((h, w), []).append(i)
            for (h, w), own in by_size.items():
                step = max(1, (1 << 19) // (h * w))
                for a in range(0, len(own), step):
                    part = own[a : a + step]
                    who, x, y, level, turn, *words = describe_batch(np.stack([np.frombuffer(pixels[i], np.uint8).reshape(h, w) for i in part]))
                    point = np.arange(len(who)) - np.searchsorted(who, who, "left")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array([ids[i] for i in part], np.int64)[who]), pa.array(point.astype(np.int32)), pa.array(x), pa.array(y), pa.array(level.astype(np.int32)), pa.array(turn.astype(np.int32)), *map(pa.array, words)],
                        names,
                    )

    return map_batches(images.select(F.col(id_col).cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "pixels"), run, POINTS)


def _consensus(matches: DataFrame, least: int) -> DataFrame:
    """(a, b) of matches (a_*, b_*) of which `least` agree on turn, scale and shift."""
    # A corner's direction may be a step off, so that each match votes for three turns.
    turn = F.pmod(F.col("b_turn") - F.col("a_turn") + F.col("__off"), F.lit(TURNS))
    matches = matches.withColumn("__off", F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1)))))
    ratio = F.pow(F.lit(FACTOR), F.col("b_level") - F.col("a_level"))
    angle = turn * (2 * np.pi / TURNS)
    # Where a's corner would lie in b, but for the shift.
    px = (F.cos(angle) * F.col("a_x") - F.sin(angle) * F.col("a_y")) * ratio
    py = (F.sin(angle) * F.col("a_x") + F.cos(angle) * F.col("a_y")) * ratio
    dx, dy = F.col("b_x") - px, F.col("b_y") - py
    # Pairs of images with too few matches go before anything is multiplied.
    one = F.struct("a_point", "b_point", turn.cast("tinyint").alias("turn"), (F.col("b_level") - F.col("a_level")).cast("tinyint").alias("scale"), dx.cast("float").alias("dx"), dy.cast("float").alias("dy"))
    some = matches.select("a", "b", one.alias("m")).groupBy("a", "b").agg(F.collect_set("m").alias("ms")).where(F.size("ms") >= 3 * least).select("a", "b", F.explode("ms").alias("m"))
    # Cells of four overlapping grids, so that no cluster is cut by every grid's lines.
    grids = ((0, 0), (SHIFT / 2, 0), (0, SHIFT / 2), (SHIFT / 2, SHIFT / 2))
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.floor((F.col("m.dx") + ox) / SHIFT).alias("cx"), F.floor((F.col("m.dy") + oy) / SHIFT).alias("cy")) for k, (ox, oy) in enumerate(grids))))
    votes = some.select("a", "b", "m.a_point", "m.b_point", "m.turn", "m.scale", cells.alias("c"))
    tally = votes.groupBy("a", "b", "turn", "scale", "c").agg(F.size(F.collect_set("a_point")).alias("na"), F.size(F.collect_set("b_point")).alias("nb"))
    return tally.where((F.col("na") >= least) & (F.col("nb") >= least)).select("a", "b").distinct()


def _close(most: int) -> Column:
    differ = [F.bit_count(F.col(f"a_{d}").bitwiseXOR(F.col(f"b_{d}"))) for d in HALVES]
    return sum(differ[1:], differ[0]) <= most


def table_keys() -> Column:
    """The keys of a descriptor in the Hamming tables: the table's number over one of its parts of 42 bits."""
    low = lambda c, n: c.bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    parts = []
    for a, b in ((F.col("d0"), F.col("d1")), (F.col("d2"), F.col("d3"))):
        parts += [F.shiftrightunsigned(a, 22), F.shiftleft(low(a, 22), 20).bitwiseOR(F.shiftrightunsigned(b, 44)), low(F.shiftrightunsigned(b, 2), 42)]
    return F.array(*(F.lit(k << 42).cast("long").bitwiseOR(v) for k, v in enumerate(parts)))


def _tokens(points: DataFrame, scratch: Scratch) -> DataFrame:
    """Points with __key, once for each bucket of theirs that has points of two images or more."""
    # Narrow until it is known which buckets matter.
    narrow = points.select("image_id", "point", F.explode(table_keys()).alias("__key"))
    live = narrow.groupBy("__key").agg(F.min("image_id").alias("lo"), F.max("image_id").alias("hi")).where("lo < hi").select("__key")
    shared = scratch.keep(narrow.join(live, "__key").distinct(), "live")
    own = F.array_contains(table_keys(), F.col("__key"))
    tokens = scratch.keep(shared.join(points, ["image_id", "point"]).where(own), "tokens")
    scratch.drop(shared)
    return tokens


def _side(points: DataFrame, name: str) -> DataFrame:
    return points.select(F.col("image_id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("point", "x", "y", "level", "turn", *HALVES)))


def _verified(candidates: DataFrame, points: DataFrame, most: int, least: int) -> DataFrame:
    """The pairs (a, b) of candidates that are linked, by all keypoints of both images."""
    matches = candidates.join(_side(points, "a"), "a").join(_side(points, "b"), "b").where(_close(most))
    return _consensus(matches, least)


def _matching(met: DataFrame, most: int) -> DataFrame:
    """Those of (pa, pb), keypoints of a bucket, that match and are of two images."""
    differ = [F.bit_count(F.col(f"pa.{d}").bitwiseXOR(F.col(f"pb.{d}"))) for d in HALVES]
    return met.where((F.col("pa.image_id") != F.col("pb.image_id")) & (sum(differ[1:], differ[0]) <= most))


def _classed(tokens: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Tokens with the class of their image."""
    if roots is None:
        return tokens.withColumn("__class", F.col("p.image_id"))
    known = tokens.join(roots.select(F.col("u").alias("__u"), F.col("root").alias("__root")), F.col("p.image_id") == F.col("__u"), "left")
    return known.select("__key", "p", F.coalesce("__root", "p.image_id").alias("__class"))


def _mixed(tokens: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Tokens of buckets of two classes and more, and of more than `most` tokens.

    With the bucket's largest class (__most), its tokens (__n) and those of other classes
    (__rest), and the class that leads (__lead) by its weight (__weight): a class of several
    images weighs as much as it has tokens there, others one, and a seeded hash decides.
    """
    image = F.col("p.image_id")
    runs = tokens.groupBy("__key", "__class").agg(F.count(F.lit(1)).alias("c"), F.when(F.min(image) < F.max(image), F.count(F.lit(1))).otherwise(1).alias("w"))
    lead = F.max(F.struct("w", F.xxhash64(F.lit(seed), "__class").alias("h"), "__class")).alias("l")
    buckets = runs.groupBy("__key").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("__n"), F.max(F.struct("c", "__class")).alias("m"), lead).where((F.col("k") > 1) & (F.col("__n") > most))
    return tokens.join(buckets.select("__key", "__n", (F.col("__n") - F.col("m.c")).alias("__rest"), F.col("m.__class").alias("__most"), F.col("l.__class").alias("__lead"), F.col("l.w").alias("__weight")), "__key")


def _stars(tokens: DataFrame, seed: int, most: int) -> DataFrame:
    """(a, b): each image with one image of the classes that lead its buckets, of the heaviest of them where keypoints match that with the most matches."""
    image = F.xxhash64(F.lit(seed), "p.image_id").alias("i")
    heads = tokens.where("__class = __lead").groupBy("__key").agg(F.min(F.struct(image, "p")).alias("h"))
    met = heads.join(tokens.where("__class != __lead").select("__key", "__weight", "__lead", F.col("p").alias("pb")), "__key").select("__weight", "__lead", F.col("h.i").alias("i"), F.col("h.p").alias("pa"), "pb")
    ways = _matching(met, most).groupBy(F.col("pb.image_id").alias("b"), F.col("pa.image_id").alias("a"), "__lead", "i").agg(F.max("__weight").alias("w"), F.count(F.lit(1)).alias("n"))
    order = F.struct("w", "n", F.xxhash64(F.lit(seed), "__lead").alias("c"), "i", "a")
    one = ways.groupBy("b").agg(F.max(order).alias("o"))
    return one.select(F.least("o.a", "b").alias("a"), F.greatest("o.a", "b").alias("b")).distinct()


def _across(tokens: DataFrame, block: int, most: int) -> DataFrame:
    """(a, b): all pairs of images of different classes of which two keypoints in a bucket match.

    Those of the bucket's largest class aren't compared with each other, so the work is
    at most some three times the pairs that there are. Buckets are cut into blocks by a
    hash, so that no pair of blocks is large.
    """
    parts = lambda n: F.ceil(F.col(n) / block)
    place = F.xxhash64("p.image_id", "p.point")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), parts(n) - 1))
    a = tokens.where("__class != __most").select("__key", F.pmod(place, parts("__rest")).alias("__i"), every("__n").alias("__j"), F.col("__class").alias("__ca"), F.col("p").alias("pa"))
    b = tokens.select("__key", every("__rest").alias("__i"), F.pmod(place, parts("__n")).alias("__j"), F.col("__class").alias("__cb"), "__most", F.col("p").alias("pb"))
    met = a.join(b, ["__key", "__i", "__j"]).where("__ca != __cb AND (__cb = __most OR pa.image_id < pb.image_id)")
    return _matching(met, most).select(F.least("pa.image_id", "pb.image_id").alias("a"), F.greatest("pa.image_id", "pb.image_id").alias("b")).distinct()


def image_links(points: DataFrame, scratch: Scratch, *, most: int = MOST_BITS, least: int = LEAST_MATCHES, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """(u, root) of the classes of linked images; images without a link are left out."""
    point = F.struct("image_id", "point", *HALVES).alias("p")
    tokens = _tokens(points, scratch).select("__key", point)
    found, roots, before, idle = None, None, None, 0
    large = tokens
    for seed in count():
        large = scratch.keep(_mixed(_classed(large, roots), few, seed).select("__key", "__class", "p", "__rest", "__lead", "__weight"), "large")
        # Pairs that are left to compare: stars go on until two passes in a row, each with another order, take less than a quarter of them.
        pairs = large.agg(F.sum("__rest")).first()[0]
        idle = idle + 1 if before is not None and pairs is not None and 4 * pairs > 3 * before else 0
        if pairs is None or idle == 2:
            break
        before = pairs
        more = scratch.keep(_verified(scratch.keep(_stars(large, seed, most), "candidates"), points, most, least), "links")
        if not more.isEmpty():
            found = more if found is None else found.union(more)
            roots = components(found, scratch)
        large = large.select("__key", "p")
    # Whatever the stars have left: all pairs of images of different classes that meet in a bucket.
    met = scratch.keep(_across(_mixed(_classed(tokens, roots), 1), block, most), "candidates")
    rest = scratch.keep(_verified(met, points, most, least), "links")
    return components(rest if found is None else found.union(rest), scratch)


def copies(images: DataFrame, *, id_col: str = "image_id", most: int = MOST_BITS, least: int = LEAST_MATCHES) -> DataFrame:
    """One row for each image: id, n_points, class_id (the smallest id reachable over links).

    Images with equal size and pixels are copies. Null pixels, and pixels that don't
    fill the size, have no keypoints and are copies of nothing. Null ids are left
    alone as classes of their own (null). Repeated rows give a row each; several
    contents under one id are one image with the keypoints of all.
    """
    scratch = Scratch(images.sparkSession, "images")
    usable = F.col("pixels").isNotNull() & (F.octet_length("pixels") == F.col("width") * F.col("height")) & F.col(id_col).isNotNull()
    content = F.when(usable, F.sha2(F.concat(F.col("width").cast("string").cast("binary"), F.lit(b"x"), F.col("pixels")), 256))
    own = images.select(F.col(id_col).cast("long").alias("image_id"), content.alias("__same"), "width", "height", "pixels")
    keyed = scratch.keep(own.select("image_id", "__same"), "keys")
    firsts = scratch.keep(keyed.where("__same IS NOT NULL").groupBy("__same").agg(F.min("image_id").alias("__first")), "firsts")
    # Only the first image of each content is described; the others are named, as they are mostly fewer.
    spare = scratch.keep(keyed.where("__same IS NOT NULL").join(firsts, "__same").where("image_id > __first").select("image_id", "__same"), "spare")
    lone = own.where("__same IS NOT NULL").join(spare, ["image_id", "__same"], "left_anti")
    points = scratch.keep(describe(lone).dropDuplicates(["image_id", "point", *HALVES]), "points")
    roots = image_links(points, scratch, most=most, least=least)
    counts = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_points")).withColumnRenamed("image_id", "__first")
    classes = firsts.join(roots.select(F.col("u").alias("__first"), "root"), "__first", "left").join(counts, "__first", "left").select("__same", F.coalesce("root", "__first").alias("__class"), F.coalesce("n_points", F.lit(0)).alias("__n"))
    known = keyed.select("image_id", "__same").join(classes, "__same", "left")
    return known.select(F.col("image_id").alias(id_col), F.coalesce("__n", F.lit(0)).cast("long").alias("n_points"), F.coalesce("__class", "image_id").alias("class_id"))


SIDE = 64


def basis(n: int) -> np.ndarray:
    """Fixed textures, one for each component of a vector."""
    if n in MADE:
        return MADE[n]
    x = np.random.RandomState(7).normal(size=(n, SIDE, SIDE)).astype(np.float32)
    MADE[n] = blur(x).reshape(n, -1)
    return MADE[n]


def warped(image: np.ndarray, angle: float, scale: float) -> np.ndarray:
    """The image turned about its middle and resized, bilinear; grey where it shows nothing."""
    h, w = image.shape
    y, x = np.mgrid[: int(h * scale), : int(w * scale)]
    y, x = y - (y.shape[0] - 1) / 2, x - (x.shape[1] - 1) / 2
    u = (x * np.cos(angle) + y * np.sin(angle)) / scale + (w - 1) / 2
    v = (y * np.cos(angle) - x * np.sin(angle)) / scale + (h - 1) / 2
    x0, y0 = np.clip(np.floor(u).astype(int), 0, w - 2), np.clip(np.floor(v).astype(int), 0, h - 2)
    fu, fv = np.clip(u - x0, 0, 1), np.clip(v - y0, 0, 1)
    out = (image[y0, x0] * (1 - fu) + image[y0, x0 + 1] * fu) * (1 - fv) + (image[y0 + 1, x0] * (1 - fu) + image[y0 + 1, x0 + 1] * fu) * fv
    return np.where((u < 0) | (v < 0) | (u > w - 1) | (v > h - 1), 128, out)


def images_from_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 10) -> DataFrame:
    """Grey images of 64 x 64 pixels drawn from vectors, since the test tables have no images.

    Each component weighs a fixed texture. The last of each `every` ids instead shows
    an edited copy of the image before it: cropped, brightened, with noise, turned by a
    quarter or by 30 degrees, or resized to four fifths, by turns.
    """
    before = vectors.select((F.col(id_col) + 1).alias("__id"), F.col(vector_col).alias("__before"))
    last = F.pmod(F.col(id_col), F.lit(every)) == every - 1
    both = vectors.where(last).join(before, F.col(id_col) == F.col("__id"), "left").select(id_col, F.coalesce("__before", vector_col).alias("v"), F.col("__before").isNotNull().alias("edited"))
    both = both.unionByName(vectors.where(~F.coalesce(last, F.lit(False))).select(id_col, F.col(vector_col).alias("v"), F.lit(False).alias("edited")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids, edited = part.column(0).to_pylist(), part.column(2).to_pylist()
                out, ws, hs = [], [], []
                for i, v, e in zip(ids, part.column(1).to_pylist(), edited):
                    x = np.nan_to_num(np.array([0.0 if c is None else c for c in v or []], np.float32))
                    flat = x @ basis(len(x)) if len(x) else np.zeros(SIDE * SIDE, np.float32)
                    image = (128 + 45 * flat / (flat.std() + 1e-6)).reshape(SIDE, SIDE)
                    kind = (i // every) % 6 if e else -1
                    if kind == 0:
                        image = image[3 + i % 5 : 59 + i % 5, 2 + i % 7 : 58 + i % 7]
                    elif kind == 1:
                        image = (image - 128) * 0.8 + 140
                    elif kind == 2:
                        image = image + np.random.RandomState(i % (1 << 31)).normal(0, 2, image.shape)
                    elif kind == 3:
                        image = np.rot90(image)
                    elif kind == 4:
                        image = warped(image, np.pi / 6, 1.0)
                    elif kind == 5:
                        image = warped(image, 0.0, 0.8)
                    image = np.clip(np.rint(image), 0, 255).astype(np.uint8)
                    out.append(image.tobytes())
                    hs.append(image.shape[0])
                    ws.append(image.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ws, pa.int32()), pa.array(hs, pa.int32()), pa.array(out, pa.binary())], ["image_id", "width", "height", "pixels"])

    return map_batches(both, run, "image_id long, width int, height int, pixels binary")
