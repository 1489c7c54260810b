"""Toxicity of deobfuscated texts.

Writers hide words by leetspeak (`1d10t`), spacing (`i d i o t`, `i.d.i.o.t`) and
repetition (`idiooot`). A noisy channel undoes this: each suspicious token becomes
a lattice of the characters that may have been meant, and Viterbi's algorithm
picks the reading with the best sum of a character language model's log
probability and the channel's costs. The model has four-character n-grams over
32 symbols, counted over all texts, so its table has 2**20 cells at most.

A logistic regression over beginnings of words and whole words of the restored
texts, fitted on labelled rows, gives the score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Sent, blocks, map_batches, raw

#: Characters and the letters that they may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Natural logarithms, the channel's costs.
LEET_COST, REPEAT_COST, DELETE_COST, BREAK_COST = 1.0, 0.5, 4.0, 1.5
#: Characters without width, which are taken out first.
HIDDEN = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
SYMBOLS, BREAK, DIGIT, OTHER = 32, 0, 27, 28
SHORTEST, LONGEST = 3, 7
#: Characters up to which a token without letters may be a word.
LONGEST_CODE = 15
#: Entries of a worker's memo of tokens, and characters of one that is remembered at most; when full it starts anew.
MEMO, LONG = 300_000, 64
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in LEET) + "«»„“”‘’…–—·¿¡"
THRICE = re.compile(r"(.)\1\1")
WORD, LETTER = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_]")


def symbol_table() -> np.ndarray:
    """Symbols of the code points below 0x300; accents fold to their letter."""
    out = np.zeros(0x301, np.int32)
    for cp in range(0x300):
        c = chr(cp)
        base = unicodedata.normalize("NFKD", c)[0].lower()
        out[cp] = ord(base) - 96 if "a" <= base <= "z" else DIGIT if c.isdigit() else OTHER if c.isalpha() else BREAK
    out[0x300] = OTHER
    return out


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = table[np.minimum(cp, 0x300)]
    out[((cp >= 0x2000) & (cp < 0x2100)) | ((cp >= 0x3000) & (cp < 0x3040))] = BREAK
    return out


def without_long_edges(word: str) -> str:
    """The word without a mark that is repeated three times or more at either end."""
    for strip in (str.lstrip, str.rstrip):
        if word:
            c = word[0] if strip is str.lstrip else word[-1]
            rest = strip(word, c)
            if len(word) - len(rest) >= 3 and not (c.isalnum() or c == "_" or c.isspace()):
                word = rest
    return word


def count_ngrams(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(code, n): four-symbol n-grams of all texts; what lies before a break is a break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = symbol_table(), np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            texts = raw(batch.column(0))
            for start, stop in blocks(texts, 1 << 20):
                s = symbols("\n\n\n" + "\n".join(x.decode("utf-8", "replace") for x in texts[start:stop] if x).lower() + "\n", table)
                a, b, c, d = s[:-3].copy(), s[1:-2].copy(), s[2:-1], s[3:]
                b[c == 0] = 0
                a[b == 0] = 0
                code = ((a * SYMBOLS + b) * SYMBOLS + c) * SYMBOLS + d
                values, n = np.unique(code[(c > 0) | (d > 0)], return_counts=True)
                sums[values] += n
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(sums[found])], ["code", "n"])

    return map_batches(docs.select(text_col), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log probabilities, (32**3, 32): Witten-Bell interpolation down to single symbols."""
    c4 = np.zeros(SYMBOLS**4)
    c4[codes] = counts
    c4 = c4.reshape((SYMBOLS,) * 4)
    p = (c4.sum((0, 1, 2)) + 1) / (c4.sum() + SYMBOLS)
    for axes in ((0, 1), (0,), ()):
        c = c4.sum(axes) if axes else c4
        kinds = (c > 0).sum(-1, keepdims=True)
        total = c.sum(-1, keepdims=True)
        p = np.where(total > 0, (c + kinds * p) / np.maximum(total + kinds, 1), np.broadcast_to(p, c.shape))
    return np.log(p).reshape(-1, SYMBOLS).astype(np.float32)


class Decoder:
    """Restores tokens under a language model."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp
        table = symbol_table()
        self.table = table

    def symbol(self, c: str) -> int:
        cp = ord(c)
        return int(self.table[min(cp, 0x300)]) if cp < 0x300 or c.isalnum() else BREAK

    def lattice(self, token: str, spaced: bool) -> list[list[tuple[str, float]]]:
        """For each place, the readings with their costs. A spaced token has a gap after each character."""
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(token):
            c = token[i]
            j = i + 1
            while j < len(token) and token[j] == c:
                j += 1
            if c.isalpha():
                if j - i >= 3:
                    out.append([(c * (j - i), 0.0), (c, REPEAT_COST), (c * 2, REPEAT_COST)])
                else:
                    out += [[(c, 0.0)]] * (j - i) if not spaced else [[(c, 0.0)], [("", 0.0), (" ", BREAK_COST)]] * (j - i)
                    i = j
                    continue
            else:
                own = (c, 0.0) if c.isalnum() else (" ", 0.0)
                for _ in range(j - i):
                    out.append([own, *((x, LEET_COST) for x in LEET.get(c, "")), *([] if c.isalnum() else [("", DELETE_COST)])])
                    if spaced:
                        out.append([("", 0.0), (" ", BREAK_COST)])
            i = j
        return out

    def restore(self, token: str, spaced: bool = False) -> str:
        """The best reading of a lower-case token; breaks come out as spaces."""
        logp, mask = self.logp, SYMBOLS**2
        # Context of three symbols to (score, back pointer); a pointer is (pointer before, reading).
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for options in self.lattice(token, spaced):
            after: dict[int, tuple[float, tuple | None]] = {}
            for context, (score, back) in states.items():
                for reading, cost in options:
                    now, total = context, score - cost
                    for c in reading:
                        s = self.symbol(c)
                        if s == BREAK:
                            if now % SYMBOLS:
                                total += float(logp[now, BREAK])
                            now = 0
                        else:
                            total += float(logp[now, s])
                            now = now % mask * SYMBOLS + s
                    if now not in after or total > after[now][0]:
                        after[now] = total, (back, reading)
            states = after
        _, back = max(((s + (float(logp[c, BREAK]) if c % SYMBOLS else 0.0), b) for c, (s, b) in states.items()), key=lambda x: x[0])
        out = []
        while back is not None:
            back, reading = back
            out.append(reading)
        return "".join(reversed(out))

    def words(self, token: str) -> list[str]:
        """The words of one token as it stands between white space, in lower case."""
        word = token.strip(EDGES)
        if word.isalpha() and not THRICE.search(word):
            return [word]
        word = without_long_edges(word.rstrip("!").translate(HIDDEN)).strip(EDGES)
        if word.isalpha() and not THRICE.search(word):
            return [word]
        if not LETTER.search(word) and not (3 <= len(word) <= LONGEST_CODE and all(x in LEET for x in word)):
            return []
        spaced = len(word) >= 5 and len(word) % 2 == 1 and not word[1].isalnum() and set(word[1::2]) == {word[1]} and all(x.isalnum() or x in LEET for x in word[::2])
        return WORD.findall(self.restore(word[::2] if spaced else word, spaced))


def spelled(tokens: list[str]) -> Iterator[str]:
    """Runs of three or more tokens of one character each, put together."""
    run: list[str] = []
    for t in [*tokens, "  "]:
        if len(t) == 1 and (t.isalnum() or t in LEET):
            run.append(t)
        else:
            if len(run) >= 3 and any(x.isalpha() for x in run):
                yield "".join(run)
            run = []


def restored_words(text: str, decoder: Decoder, memo: dict[str, tuple], make) -> set:
    """The union of make(words of a token) over a text's tokens."""
    tokens = text.lower().split()
    out: set = set()
    for t in set(tokens):
        got = memo.get(t)
        if got is None:
            if len(memo) >= MEMO:
                memo.clear()
            got = make(decoder.words(t))
            if len(t) <= LONG:
                memo[t] = got
        if got:
            out.update(got)
    if sum(len(t) == 1 for t in tokens) >= 3:
        for run in spelled(tokens):
            out.update(make(WORD.findall(decoder.restore(run, True))))
    return out


def features(word: str) -> list[str]:
    return ["^" + word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + "$"]


@dataclass
class Model:
    """A language model, and weights of features."""

    logp: np.ndarray
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """text bytes to score; with a memo of its own."""
        decoder, weights, memo = Decoder(self.logp), self.weights, {}
        starts = {f[1 : 1 + SHORTEST] for f in weights if f[0] == "^"} | {f[:-1][:SHORTEST] for f in weights if f[0] != "^"}

        def make(words: list[str]) -> tuple:
            return tuple(f for w in words if w[:SHORTEST] in starts for f in features(w) if f in weights)

        def score(text: bytes | None) -> float:
            found = restored_words(text.decode("utf-8", "replace"), decoder, memo, make) if text else ()
            z = self.bias + sum(weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-min(max(z, -500), 500))))

        return score

    def scores(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score) of every row."""
        model = Sent(docs.sparkSession, self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = model.value.scorer()
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(x) for x in raw(batch.column(1))], pa.float64())], [id_col, "score"])

        kind = docs.schema[id_col].dataType.simpleString()
        return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double")

    def keep(self, docs: DataFrame, *, text_col: str = "text", below: float = 0.5) -> DataFrame:
        """The rows of docs with a score under `below`, all columns as they are."""
        model, at = Sent(docs.sparkSession, self), docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = model.value.scorer()
            for batch in batches:
                yield batch.filter(pa.array([score(x) < below for x in raw(batch.column(at))], pa.bool_()))

        return map_batches(docs, run, docs.schema)


def logistic(hits: list[list[int]], y: np.ndarray, k: int, *, penalty: float = 0.02, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights of k features and bias by Newton's method with a ridge; the rarer class weighs more.

    hits has the features of each row. The step's equations are solved by conjugate gradients.
    """
    n = len(hits)
    # A last feature that every row has is the bias.
    row = np.concatenate([np.repeat(np.arange(n), [len(h) for h in hits]), np.arange(n)])
    col = np.concatenate([np.array([f for h in hits for f in h], np.int64), np.full(n, k)])
    times = lambda w: np.bincount(row, w[col], n)
    back = lambda v: np.bincount(col, v[row], k + 1)
    weight = np.sqrt(np.where(y > 0.5, n / (2 * max(y.sum(), 1)), n / (2 * max((1 - y).sum(), 1))))
    hold = np.append(np.full(k, penalty), 1e-6)
    w = np.zeros(k + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        slope = back(weight * (p - y)) + hold * w
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        scale = back(curve) + hold
        step, rest = np.zeros(k + 1), slope.copy()
        z = rest / scale
        way, old = z.copy(), rest @ z
        for _ in range(200):
            bent = back(curve * times(way)) + hold * way
            by = old / max(way @ bent, 1e-300)
            step += by * way
            rest -= by * bent
            if np.abs(rest).max() < 1e-7:
                break
            z = rest / scale
            now = rest @ z
            way, old = z + now / old * way, now
        step *= min(1, 4 / max(np.abs(step).max(), 1e-9))
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def held_out(id_col: str = "doc_id"):
    """True for the rows from which no label is learned; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_train_rows: int = 12_000, least_rows: int = 2, least_odds: float = 2.0,
) -> Model:
    """Learn the language model from all texts, and the weights from labelled rows.

    Labels are read only for ids that are not held out. The classifier is fitted on
    the `max_train_rows` of them that come first in hash order (its documented bound);
    a row with several labels counts as toxic if one says so. Features are all that
    `least_rows` toxic rows of the sample have and whose log odds are `least_odds` or
    more. Without both classes the score is the share of toxic rows. Null labels are no
    labels; null texts have no words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    grams = count_ngrams(docs, text_col=text_col).toArrow()
    logp = language_model(grams.column(0).to_numpy(), grams.column(1).to_numpy())

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    sample = scratch.keep(known.orderBy(F.xxhash64("__id"), "__id").limit(max_train_rows), "sample")
    decoder_table = Sent(spark, logp)

    def to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, memo = Decoder(decoder_table.value), {}
        for batch in batches:
            texts = raw(batch.column(1))
            for i in range(0, len(texts), 200):
                found = [sorted(restored_words(x.decode("utf-8", "replace"), decoder, memo, tuple)) if x else [] for x in texts[i : i + 200]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 200), pa.array(found, pa.list_(pa.string()))], ["y", "words"])

    # The sample has max_train_rows rows at most.
    own = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    chosen = own.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).select("__y", "__text")
    words = scratch.keep(map_batches(chosen, to_words, "y int, words array<string>"), "words")
    sizes = {r["y"]: r["n"] for r in words.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    share = min(max(n_bad / (n_bad + n_good + 1), 1e-6), 1 - 1e-6)
    flat = Model(logp, {}, float(np.log(share / (1 - share))))
    if not n_bad or not n_good:
        return flat

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> pa.RecordBatch:
            keys = list({k for k, _ in counts})
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[k, 1] for k in keys], pa.int64()), pa.array([counts[k, 0] for k in keys], pa.int64())], ["feature", "bad", "good"])

        counts: Counter = Counter()
        for batch in batches:
            for y, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((f, y) for f in {f for w in own for f in features(w)})
                if len(counts) > 200_000:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    ranked = map_batches(words, tally, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumn("odds", odds)
    top = ranked.where((F.col("bad") >= least_rows) & (F.col("odds") >= least_odds))
    # Features of max_train_rows texts at most.
    names = sorted(top.select("feature").toArrow().column(0).to_pylist())
    if not names:
        return flat
    place = {f: i for i, f in enumerate(names)}

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted({place[f] for w in own for f in features(w) if f in place}) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32()))], ["y", "hits"])

    # max_train_rows rows at most; sorted, so that sums come out the same.
    rows = sorted(map_batches(words, to_rows, "y int, hits array<int>").toArrow().to_pylist(), key=lambda r: (r["y"], r["hits"]))
    w, bias = logistic([r["hits"] for r in rows], np.array([float(r["y"]) for r in rows]), len(names))
    return Model(logp, {f: float(v) for f, v in zip(names, w)}, bias)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """One row for each document: id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts are scored by the bias alone. Rows and ids that repeat give a
    row each; an empty table gives none.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **options)
    scored = model.scores(docs, id_col=id_col, text_col=text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
