"""Benchmark decontamination by suffix arrays over the training texts.

Texts are cut into shards of bounded size. A shard's suffix array sorts the
positions of its words by what follows; every suffix of every test item is found
in it by binary search (once for all that begin with the same window). Places that
follow each other in both texts make up the longest verbatim matches, with their
locations; what they cover decides which documents go.

The array holds the positions that can matter: a window occurs only in a run of
words that all are test words, so words outside such runs are left out. The test
items go to the workers in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sent, blocks, map_batches, raw

WINDOW, PARTS = 13, 20
#: Words: 0-9, a-z after lower-casing A-Z, and all bytes from 0x80 on; the rest parts them.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


@dataclass
class Items:
    """A block of test items, with their words as numbers from 1 on."""

    vocabulary: dict[bytes, int]
    names: list[str]
    #: All items' words in a row; 0 stands after each item.
    words: np.ndarray
    #: First word and number of words of each item, and the name of each.
    starts: np.ndarray
    lengths: np.ndarray
    named: np.ndarray
    #: Distinct windows, padded with 0, their lengths, and (window, name) of each pair.
    windows: np.ndarray
    window_lengths: np.ndarray
    pairs: np.ndarray
    #: (window, first word in `words`) of each suffix, in order; of items with the same words the first name's.
    suffixes: np.ndarray


def index_items(rows: list[tuple[str, bytes | None]], window: int = WINDOW) -> Items:
    vocabulary: dict[bytes, int] = {}
    names = sorted({name for name, _ in rows})
    number = {n: i for i, n in enumerate(names)}
    words, starts, lengths, named = [], [], [], []
    seen: dict[tuple, int] = {}
    pairs, suffixes, whole = set(), [], set()
    for name, text in sorted(rows, key=lambda r: r[0]):
        own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        if not own:
            continue
        starts.append(len(words))
        lengths.append(len(own))
        named.append(number[name])
        words += [*own, 0]
        size = min(window, len(own))
        fresh = tuple(own) not in whole
        whole.add(tuple(own))
        for at in range(len(own) - size + 1):
            key = seen.setdefault(tuple(own[at : at + size]), len(seen))
            pairs.add((key, number[name]))
            if fresh:
                suffixes.append((key, starts[-1] + at))
    windows = np.zeros((len(seen), window), np.int32)
    for key, i in seen.items():
        windows[i, : len(key)] = key
    sizes = np.array([len(k) for k in seen], np.int64)
    return Items(vocabulary, names, np.array(words, np.int32), np.array(starts, np.int64), np.array(lengths, np.int64), np.array(named, np.int64), windows, sizes, np.array(sorted(pairs), np.int64).reshape(-1, 2), np.array(sorted(suffixes), np.int64).reshape(-1, 2))


class SuffixArray:
    """Suffixes of a row of word numbers, where 0 ends a suffix."""

    def __init__(self, words: np.ndarray, least: int, depth: int):
        """Only runs of `least` or more words are held; suffixes are sorted to `depth` words."""
        n = len(words)
        ends = np.flatnonzero(words == 0)
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
        begins = np.concatenate(([0], ends[:-1] + 1))
        held = np.repeat((ends - begins) >= least, ends - begins + 1)
        self.words = words
        self.left = left
        at = np.flatnonzero(held & (words > 0))
        # Prefix doubling over the held positions; a rank of 0 stands past a suffix's end.
        rank = np.zeros(n + 1, np.int64)
        _, inverse = np.unique(words[at], return_inverse=True)
        rank[at] = inverse + 1
        span = 1
        while span < depth and len(at):
            after = np.where(left[at] > span, rank[np.minimum(at + span, n)], 0)
            _, inverse = np.unique(rank[at] * (len(at) + 2) + after, return_inverse=True)
            rank[at] = inverse + 1
            span *= 2
        self.array = at[np.argsort(rank[at], kind="stable")]

    def _compare(self, places: np.ndarray, needles: np.ndarray) -> np.ndarray:
        """-1, 0, 1: the suffixes' first words against needles, which are padded with 0."""
        out = np.zeros(len(places), np.int8)
        live = np.arange(len(places))
        for k in range(needles.shape[1]):
            if not len(live):
                break
            want = needles[live, k]
            have = np.where(self.left[places[live]] > k, self.words[np.minimum(places[live] + k, len(self.words) - 1)], 0)
            done = want == 0
            out[live[~done]] = np.sign(have[~done] - want[~done])
            live = live[~done & (have == want)]
        return out

    def search(self, needles: np.ndarray, side: str) -> np.ndarray:
        """Binary search of all needles at once; the array's first place not below (left) or above (right)."""
        low, high = np.zeros(len(needles), np.int64), np.full(len(needles), len(self.array), np.int64)
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live]) // 2
            sign = self._compare(self.array[mid], needles[live])
            go = sign < 0 if side == "left" else sign <= 0
            low[live[go]] = mid[go] + 1
            high[live[~go]] = mid[~go]
        return low

    def common(self, places: np.ndarray, needles: np.ndarray) -> np.ndarray:
        """Length of what the suffixes share with needles."""
        out = np.zeros(len(places), np.int64)
        live = np.arange(len(places))
        for k in range(needles.shape[1]):
            same = (self.left[places[live]] > k) & (needles[live, k] > 0) & (self.words[np.minimum(places[live] + k, len(self.words) - 1)] == needles[live, k])
            live = live[same]
            if not len(live):
                break
            out[live] += 1
        return out


def _numbers(texts: list[bytes | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words as numbers, 0 for others and after each text; where each text starts, and the end."""
    out, starts = [], [0]
    for text in texts:
        own = words_of(text)
        out.append(np.fromiter(map(vocabulary.get, own, [0] * len(own)), np.int32, len(own)))
        out.append(np.zeros(1, np.int32))
        starts.append(starts[-1] + len(own) + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(starts, np.int64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for each i, counts[i] of them."""
    total = int(counts.sum())
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)


@dataclass
class Matches:
    """Longest verbatim matches in a shard: the text's place and the match's first word in it, the name's, the item's first word, and the words."""

    text: np.ndarray
    word: np.ndarray
    name: np.ndarray
    item_word: np.ndarray
    size: np.ndarray


def shard_hits(texts: list[bytes | None], items: Items, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, Matches]:
    """A mask of hit words in the texts' row of words, the texts' starts, (text, name) pairs, and the matches."""
    words, starts = _numbers(texts, items.vocabulary)
    hit = np.zeros(len(words), bool)
    empty = np.zeros(0, np.int64)
    none = np.zeros((0, 2), np.int64), Matches(empty, empty, empty, empty, empty)
    if not len(items.windows) or not len(words):
        return hit, starts, *none
    array = SuffixArray(words, int(items.window_lengths.min()), window)
    if not len(array.array):
        return hit, starts, *none
    low, high = array.search(items.windows, "left"), array.search(items.windows, "right")
    found = np.flatnonzero(high > low)
    if not len(found):
        return hit, starts, *none
    # Each suffix of an item with each of its places.
    first, last = np.searchsorted(items.suffixes[:, 0], found, "left"), np.searchsorted(items.suffixes[:, 0], found, "right")
    which = np.repeat(found, last - first)
    suffix = items.suffixes[ranges(first, last - first), 1]
    counts = high[which] - low[which]
    place = array.array[ranges(low[which], counts)]
    suffix, size = np.repeat(suffix, counts), np.repeat(items.window_lengths[which], counts)
    # Places that follow each other on a diagonal are one match.
    order = np.lexsort((place, place - suffix))
    suffix, place, size = suffix[order], place[order], size[order]
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 1) | (np.diff(suffix) != 1))))
    ends = np.concatenate((begins[1:], [len(place)])) - 1
    size = size[ends] + place[ends] - place[begins]
    place, suffix = place[begins], suffix[begins]
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, place, 1)
    np.add.at(marks, place + size, -1)
    hit = np.cumsum(marks)[:-1] > 0
    text, row = np.searchsorted(starts, place, "right") - 1, np.searchsorted(items.starts, suffix, "right") - 1
    matches = Matches(text, place - starts[text], items.named[row], suffix - items.starts[row], size)
    # Pairs of a text and a window once each, then of a text and a name.
    counts = high[found] - low[found]
    at = np.searchsorted(starts, array.array[ranges(low[found], counts)], "right") - 1
    both = np.unique(at * (len(items.windows) + 1) + np.repeat(found, counts))
    text, which = both // (len(items.windows) + 1), both % (len(items.windows) + 1)
    first, last = np.searchsorted(items.pairs[:, 0], which, "left"), np.searchsorted(items.pairs[:, 0], which, "right")
    named = items.pairs[ranges(first, last - first), 1]
    return hit, starts, np.unique(np.stack([np.repeat(text, last - first), named], 1), axis=0), matches


def item_blocks(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", block_bytes: int = 8 << 20, window: int = WINDOW) -> list:
    """Broadcasts of the items' indexes, each of at most `block_bytes` of text (a longer item is alone).

    Rows without an id count under the empty string.
    """
    spark = items.sparkSession
    rows, size, out = [], 0, []
    for r in items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col).cast("binary")).toLocalIterator():
        n = len(r[1]) if r[1] is not None else 0
        if rows and size + n > block_bytes:
            out.append(Sent(spark, index_items(rows, window)))
            rows, size = [], 0
        rows.append((r[0], bytes(r[1]) if r[1] is not None else None))
        size += n
    return [*out, Sent(spark, index_items(rows, window))]


@dataclass
class Verdict:
    """Number of words and of hit words, names of the items found, and the longest match as (-words, first word, name, item's first word)."""

    n_words: int
    n_hit: int
    names: set[str]
    longest: tuple[int, int, str, int] | None

    @property
    def contaminated(self) -> bool:
        return is_contaminated(self.n_words, self.n_hit)


def judge(texts: list[bytes | None], indexes: list, window: int = WINDOW) -> list[Verdict]:
    """What is found in each text. Of the longest matches the first in the text counts, then the first name and item word."""
    out: list[Verdict] = []
    for start, stop in blocks(texts):
        part = texts[start:stop]
        names: list[set[str]] = [set() for _ in part]
        longest: list[tuple | None] = [None] * len(part)
        whole = None
        for index in indexes:
            items = index.value
            hit, starts, pairs, m = shard_hits(part, items, window)
            whole = hit if whole is None else whole | hit
            for text, name in pairs.tolist():
                names[text].add(items.names[name])
            order = np.lexsort((m.item_word, m.name, m.word, -m.size, m.text))
            for i in order[np.unique(m.text[order], return_index=True)[1]]:
                best = -int(m.size[i]), int(m.word[i]), items.names[m.name[i]], int(m.item_word[i])
                text = m.text[i]
                longest[text] = best if longest[text] is None else min(best, longest[text])
        sums = np.concatenate(([0], np.cumsum(whole)))
        n_hit = sums[starts[1:] - 1] - sums[starts[:-1]]
        out += map(Verdict, (np.diff(starts) - 1).tolist(), n_hit.tolist(), names, longest)
    return out


def is_contaminated(n_words: int, n_hit: int, parts: int = PARTS) -> bool:
    return n_hit > 0 and parts * n_hit >= n_words


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long, longest_item string, longest_item_word long"


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match.

    A window is `window` consecutive words of an item, or all of a shorter item's.
    A word inside any occurrence of a window is hit. A document is contaminated if a
    twentieth of its words or more, and one at least, are hit. The longest verbatim match
    of an item's suffix is given by its words (0 if there is none), its first word in
    the document, its item, and its first word there (from 0; of equally long ones the first in
    this order). Null, empty and blank texts have no words and are clean; items without
    words have no window; items with the same id are one. Empty tables on either side
    are fine.
    """
    indexes = item_blocks(items, item_col=item_col, text_col=item_text_col, window=window)
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            got = judge(raw(batch.column(1)), indexes, window)
            sums = [hashlib.sha256(",".join(sorted(g.names)).encode()).hexdigest() for g in got]
            best = [g.longest or (0, None, None, None) for g in got]
            rows = [(g.n_words, g.n_hit, len(g.names), h, g.contaminated, -b[0], *b[1:]) for g, h, b in zip(got, sums, best)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, {FOUND}")


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs that aren't contaminated, all columns as they are."""
    indexes, at = item_blocks(items, item_col=item_col, text_col=item_text_col, window=window), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not v.contaminated for v in judge(raw(batch.column(at)), indexes, window)], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def longest_matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The longest verbatim match of every item suffix that has one of `window` words or more.

    Returns item (string), item_word (the suffix's first word, from 0), n_words, the id
    of a document and doc_word; of several places that with the smallest id, then
    word. Shorter items match as a whole only. Null and empty texts and empty tables on
    either side have no matches; items with the same id are one, of which the longest
    match counts.
    """
    indexes = item_blocks(items, item_col=item_col, text_col=item_text_col, window=window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = raw(batch.column(1)), batch.column(0)
            for start, stop in blocks(texts):
                for index in indexes:
                    got = _longest(texts[start:stop], index.value, window)
                    if got is None:
                        continue
                    item, word, size, text, place = got
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([index.value.names[i] for i in item], pa.string()), pa.array(word), pa.array(size), ids.slice(start).take(pa.array(text)), pa.array(place)],
                        ["item", "item_word", "n_words", id_col, "doc_word"],
                    )

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_batches(docs.select(id_col, text_col), run, f"item string, item_word long, n_words long, `{id_col}` {kind}, doc_word long")
    best = F.min(F.struct((-F.col("n_words")).alias("less"), F.col(id_col).alias("id"), F.col("doc_word").alias("word"))).alias("best")
    return found.groupBy("item", "item_word").agg(best).select("item", "item_word", (-F.col("best.less")).alias("n_words"), F.col("best.id").alias(id_col), F.col("best.word").alias("doc_word"))


def _longest(texts: list[bytes | None], items: Items, window: int):
    words, starts = _numbers(texts, items.vocabulary)
    if not len(items.lengths) or not len(words):
        return None
    depth = int(items.lengths.max())
    array = SuffixArray(words, int(np.minimum(items.lengths, window).min()), depth)
    if not len(array.array):
        return None
    count = items.lengths - np.minimum(items.lengths, window) + 1
    owner = np.repeat(np.arange(len(count)), count)
    at = ranges(np.zeros(len(count), np.int64), count)
    out = []
    step = max(1, (1 << 22) // depth)
    for a in range(0, len(owner), step):
        own, pos = owner[a : a + step], at[a : a + step]
        rest = items.lengths[own] - pos
        cols = np.arange(depth)[None, :]
        where = np.minimum(items.starts[own, None] + pos[:, None] + cols, len(items.words) - 1)
        needles = np.where(cols < rest[:, None], items.words[where], 0)
        low = array.search(needles, "left")
        for near in (low - 1, low):
            ok = np.flatnonzero((near >= 0) & (near < len(array.array)))
            if not len(ok):
                continue
            places = array.array[near[ok]]
            size = array.common(places, needles[ok])
            long = size >= np.minimum(items.lengths[own[ok]], window)
            if long.any():
                text = np.searchsorted(starts, places[long], "right") - 1
                out.append((items.named[own[ok]][long], pos[ok][long], size[long], text, places[long] - starts[text]))
    return [np.concatenate(x) for x in zip(*out)] if out else None


def oracle(docs: str = "documents", items: str = "benchmark") -> str:
    """`contamination` in DuckDB's SQL, which compares all windows."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{capitals}', '{small}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM {docs}),
i AS (SELECT row_number() OVER () AS r, coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM {items}),
iw AS (SELECT r, item, n, q, array_to_string(w[q:q + n - 1], ' ') AS s FROM (SELECT r, item, w, n, unnest(range(1, len(w) - n + 2)) AS q FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM i WHERE len(w) > 0))),
dw AS (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT rid, p, n, r, item, q FROM dw JOIN iw USING (n, s)),
h AS (SELECT rid, count(DISTINCT k) AS hit FROM (SELECT rid, unnest(range(p, p + n)) AS k FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid),
u AS (SELECT rid, item, min(p) AS p, min(q) AS q, max(n) + count(*) - 1 AS size FROM (SELECT *, p - row_number() OVER (PARTITION BY rid, r, p - q ORDER BY p) AS island FROM m) GROUP BY rid, r, item, p - q, island),
b AS (SELECT rid, size, p, item, q FROM u QUALIFY row_number() OVER (PARTITION BY rid ORDER BY size DESC, p, item, q) = 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(hit, 0) > 0 AND {PARTS} * coalesce(hit, 0) >= len(w) AS contaminated, coalesce(size, 0)::BIGINT AS longest, (p - 1)::BIGINT AS longest_at, item AS longest_item, (q - 1)::BIGINT AS longest_item_word
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid) LEFT JOIN b USING (rid)"""
