"""Document quality by an interpolated modified Kneser-Ney model.

The model has n-grams of four characters, just as the texts have them, and is trained
on trusted texts. Counts, continuation counts and discounts are joined by context and
by suffix, sharded by n-gram; the tables grow with the corpus and stay tables.

Documents are scored by joins, too. They are packed into blocks, each of which asks
once for every n-gram that it has; the answers meet the block's texts again. So what is
shuffled follows the different n-grams of blocks, not of documents. A document's
perplexity is compared with a quantile of the trusted documents of its language that
the model was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_batches, raw
from .toxicity import held_out

ORDER = 4
#: Stands before each text; in texts U+0000 counts as U+FFFD.
START = 2
#: Bytes of text in a block, about, and code points that are cut into n-grams at a time.
PACKED_BYTES, CHUNK = 32 << 20, 1 << 20
#: Of the blocks' compression: they are written once and shuffled once.
LEVEL = 12
#: Perplexities are ranked in steps of this many nats.
STEP = 1e-3


@dataclass
class Row:
    """Texts' code points in a row, each text behind order - 1 starts; where its n-grams begin, and the texts' numbers of characters."""

    points: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    order: int

    @classmethod
    def of(cls, texts: list[bytes | None], order: int = ORDER) -> Row:
        points = [np.frombuffer(x.decode("utf-8", "replace").encode("utf-32-le"), "<u4") if x else np.zeros(0, "<u4") for x in texts]
        sizes = np.array([len(x) for x in points], np.int64)
        pad = np.full(order - 1, START, "<u4")
        row = np.concatenate([part for x in points for part in (pad, x)] or [pad])
        row = np.where(row == 0, 0xFFFD, row).astype("<u4")
        # The n-gram of a character begins order - 1 places before it.
        begins = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)) * (order - 1), sizes)
        return cls(row, begins, sizes, order)

    def grams(self) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.points, self.order)[self.begins]

    def alphabet(self) -> np.ndarray:
        seen = np.zeros(0x110000, bool)
        seen[self.points] = True
        return np.flatnonzero(seen)

    def numbers(self, alphabet: np.ndarray) -> np.ndarray | None:
        """Each n-gram as a number in base of the alphabet's size; none if 64 bits don't do."""
        if len(alphabet) ** self.order >= 1 << 62:
            return None
        places = np.zeros(0x110000, np.int64)
        places[alphabet] = np.arange(len(alphabet))
        own = places[self.points]
        n = len(own) - self.order + 1
        out = own[:n].copy()
        for k in range(1, self.order):
            out *= len(alphabet)
            out += own[k : n + k]
        return out[self.begins]


def numbered(grams: np.ndarray) -> np.ndarray:
    """A number for each row of code points; equal rows have equal ones. For any alphabet, with a sort for each column at most."""
    alphabet, places = np.unique(grams, return_inverse=True)
    places = places.reshape(grams.shape).astype(np.int64)
    out = places[:, 0].copy()
    for k in range(1, grams.shape[1]):
        if int(out.max(initial=0)) >= (1 << 62) // max(len(alphabet), 1):
            out = np.unique(out, return_inverse=True)[1].reshape(-1).astype(np.int64)
        out = out * len(alphabet) + places[:, k]
    return out


def different(rows: Iterable[Row], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of rows of texts as rows of code points, and their counts."""
    values, counts, plain = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    order = ORDER
    for row in rows:
        number, order = row.numbers(alphabet), row.order
        if number is None:
            # The alphabet has no room for numbers: the n-grams themselves are held.
            grams = row.grams()
            _, first, n = np.unique(numbered(grams), return_index=True, return_counts=True)
            both = grams[first] if plain is None else np.concatenate((plain, grams[first]))
            n = np.concatenate((counts, n))
            _, first, inverse = np.unique(numbered(both), return_index=True, return_inverse=True)
            plain, counts = np.ascontiguousarray(both[first]), np.bincount(inverse.reshape(-1), n).astype(np.int64)
            continue
        own, n = np.unique(number, return_counts=True)
        both = np.concatenate((values, own))
        values, inverse = np.unique(both, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate((counts, n))).astype(np.int64)
    if plain is not None:
        return plain, counts
    grams = np.empty((len(values), order), "<u4")
    for k in range(order - 1, -1, -1):
        values, place = np.divmod(values, max(len(alphabet), 1))
        grams[:, k] = alphabet[place] if len(alphabet) else 0
    return grams, counts


def rows_of(parts: Iterable[list[bytes | None]]) -> Iterator[Row]:
    for texts in parts:
        for start, stop in chunks(texts):
            yield Row.of(texts[start:stop])


def alphabet_of(parts: Iterable[list[bytes | None]]) -> np.ndarray:
    seen = np.zeros(0x110000, bool)
    for row in rows_of(parts):
        seen[row.points] = True
    return np.flatnonzero(seen)


def looked_up(row: Row, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each n-gram in the row the value of the known one that it is."""
    alphabet = row.alphabet()
    number = row.numbers(alphabet)
    if number is None:
        both = numbered(np.concatenate((known, row.grams())))
        theirs, number = both[: len(known)], both[len(known) :]
    else:
        places = np.full(0x110000, -1, np.int64)
        places[alphabet] = np.arange(len(alphabet))
        own = places[known]
        can = (own >= 0).all(1)
        own, values = own[can], values[can]
        theirs = own[:, 0].copy()
        for k in range(1, row.order):
            theirs = theirs * len(alphabet) + own[:, k]
    order = np.argsort(theirs)
    at = np.searchsorted(theirs[order], number)
    if len(number) and (at.max() >= len(order) or (theirs[order][at] != number).any()):
        raise RuntimeError("an n-gram has no answer")
    return values[order][at]


def strings(grams: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(grams, "<u4").view(f"<U{ORDER}").reshape(-1), pa.string())


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes; a longer text is alone."""
    start = size = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if i > start and size + n > CHUNK:
            yield start, i
            start, size = i, 0
        size += n
    if texts:
        yield start, len(texts)


def count_ngrams(texts: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(g string, n long) of all n-grams of the highest order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [raw(batch.column(0))]
            grams, n = different(rows_of(texts), alphabet_of(texts))
            yield pa.RecordBatch.from_arrays([strings(grams), pa.array(n)], ["g", "n"])

    return map_batches(texts.select(text_col), run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ of an order from its counts of counts."""
    r = counts.agg(*(F.coalesce(F.sum((F.col("n") == k).cast("long")), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n = [r[f"n{k}"] for k in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) if n[k - 1] else k / 2 for k in (1, 2, 3))


@dataclass
class Model:
    """For each order from 1: n-grams' probabilities (g, p) and contexts' weights of the lower order (h, w); and the number of symbols."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    symbols: int


def train(texts: DataFrame, scratch: Scratch, *, text_col: str = "text") -> Model:
    """Train on the texts; a table without any gives the uniform model of one symbol."""
    counts = [scratch.keep(count_ngrams(texts, text_col=text_col), "counts")]
    # Continuation counts: how many symbols stand before the shorter n-gram.
    for order in range(ORDER - 1, 0, -1):
        counts.insert(0, scratch.keep(counts[0].groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count(F.lit(1)).alias("n")), f"counts{order}"))
    # One symbol more than were seen.
    symbols = counts[0].count() + 1
    grams, contexts = [], []
    for order, own in enumerate(counts, 1):
        d1, d2, d3 = discounts(own)

        def off(n: Column, d=(d1, d2, d3)) -> Column:
            return F.when(n == 1, F.lit(d[0])).when(n == 2, F.lit(d[1])).otherwise(F.lit(d[2]))

        keyed = own.select("g", "n", F.expr(f"substring(g, 1, {order - 1})").alias("h"), F.expr("substring(g, 2)").alias("s"))
        # Whole numbers until the last step, so that the order of rows doesn't matter.
        context = keyed.groupBy("h").agg(F.sum("n").alias("t"), *(F.sum((F.col("n") == k if k < 3 else F.col("n") >= 3).cast("long")).alias(f"k{k}") for k in (1, 2, 3)))
        context = scratch.keep(context.select("h", "t", ((F.lit(d1) * F.col("k1") + F.lit(d2) * F.col("k2") + F.lit(d3) * F.col("k3")) / F.col("t")).alias("w")), "contexts")
        joined = keyed.join(context, "h")
        joined = joined.withColumn("q", F.lit(1 / symbols)) if order == 1 else joined.join(grams[-1].select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
        grams.append(scratch.keep(joined.select("g", ((F.col("n") - off(F.col("n"))) / F.col("t") + F.col("w") * F.col("q")).alias("p")), "grams"))
        contexts.append(context.select("h", "w"))
    return Model(grams, contexts, symbols)


def log_probabilities(asked: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """(g, logp) of the distinct n-grams g in asked. Unseen ones take their suffix's, times the weight of a seen context."""
    found, rest = [], asked.select("g", F.col("g").alias("__now"), F.lit(1.0).alias("__weight"))
    for order in range(ORDER, 0, -1):
        seen = scratch.keep(rest.join(model.grams[order - 1].select(F.col("g").alias("__now"), "p"), "__now", "left"), f"seen{order}")
        found.append(seen.where("p IS NOT NULL").select("g", F.log(F.col("__weight") * F.col("p")).alias("logp")))
        unseen = seen.where("p IS NULL").select("g", "__now", "__weight", F.expr(f"substring(__now, 1, {order - 1})").alias("h"))
        weighed = unseen.join(model.contexts[order - 1], "h", "left")
        rest = weighed.select("g", F.expr("substring(__now, 2)").alias("__now"), (F.col("__weight") * F.coalesce("w", F.lit(1.0))).alias("__weight"))
    found.append(rest.select("g", F.log(F.col("__weight") / model.symbols).alias("logp")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def packed_blocks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(__block, __rows): the rows (id, lang, text) as compressed tables of about PACKED_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["__rows"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACKED_BYTES:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return scratch.keep(map_batches(docs, run, "__rows binary").select(F.monotonically_increasing_id().alias("__block"), "__rows"), "blocks")


def unpack(rows: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(rows) as f:
        yield from f


def score(docs: DataFrame, model: Model, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_symbols, log_prob) of every row."""
    blocks_of = packed_blocks(docs.select(id_col, lang_col, text_col), scratch)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts = lambda rows=rows: (raw(b.column(2)) for b in unpack(rows))
                grams, _ = different(rows_of(texts()), alphabet_of(texts()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block)), strings(grams)], ["__block", "g"])

    asked = scratch.keep(map_batches(blocks_of, ask, "__block long, g string"), "asked")
    answers = asked.join(log_probabilities(scratch.keep(asked.select("g").distinct(), "distinct"), model, scratch), "g")
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, lang_col)}
    names = [id_col, lang_col, "n_symbols", "log_prob"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("g").to_numpy().astype(f"<U{ORDER}").view("<u4").reshape(-1, ORDER)
        logp = right.column("logp").to_numpy()
        out = []
        for rows in left.column("__rows").to_pylist():
            for batch in unpack(rows):
                texts = raw(batch.column(2))
                sizes, sums = [], []
                for row in rows_of([texts]):
                    n, own = row.sizes, looked_up(row, known, logp)
                    sums += [float(own[e - k : e].sum()) for e, k in zip(np.cumsum(n).tolist(), n.tolist())]
                    sizes.append(n)
                n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
                out.append(pa.Table.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(sums, pa.float64())], names))
        return pa.concat_tables(out)

    schema = f"`{id_col}` {kinds[id_col]}, `{lang_col}` {kinds[lang_col]}, n_symbols long, log_prob double"
    return blocks_of.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(run, schema)


def known(docs: DataFrame, ids: DataFrame, *, id_col: str, most: int = 1_000_000) -> DataFrame:
    """The rows of docs with an id in ids (column __id); few ids are broadcast, many joined."""
    few = ids.limit(most + 1).count() <= most
    return docs.join(F.broadcast(ids) if few else ids, F.col(id_col) == F.col("__id"), "left_semi")


def quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality",
    quantile: float = 0.98, slack: float = 0.0,
) -> DataFrame:
    """One row for each document: id, lang, n_symbols, log_prob, perplexity, threshold, keep.

    The trusted documents are those whose label is 1. The model is trained on four
    fifths of them; of the others (by a hash of the id) the threshold of a language is
    the `quantile` of the log perplexity (in steps of 1e-3) plus `slack` nats, as a
    perplexity. Languages without such documents, and null, take that of all of them
    together, and without any every document with text is kept.
    Null and empty texts have no perplexity and aren't kept. Repeated rows and ids give
    a row each; an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    ids = scratch.keep(labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct(), "trusted")
    apart = held_out("__id")
    model = train(known(docs.select(id_col, text_col), ids.where(~apart), id_col=id_col), scratch, text_col=text_col)
    scored = scratch.keep(score(docs, model, scratch, id_col=id_col, text_col=text_col, lang_col=lang_col), "scores")
    loss = -F.col("log_prob") / F.col("n_symbols")
    trusted = known(scored.where("n_symbols > 0"), ids.where(apart), id_col=id_col)
    steps = scratch.keep(trusted.groupBy(F.col(lang_col).alias("__lang"), F.ceil(loss / STEP).alias("__step")).agg(F.count(F.lit(1)).alias("__n")), "steps")

    def cut(counts: DataFrame, *by: str) -> DataFrame:
        """The first step at which the quantile is reached."""
        upto = Window.partitionBy(*by).orderBy("__step").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*by)
        run = counts.withColumn("__upto", F.sum("__n").over(upto)).withColumn("__all", F.sum("__n").over(whole))
        return run.where(F.col("__upto") >= F.lit(quantile) * F.col("__all")).groupBy(*by).agg(F.min("__step").alias("__cut"))

    merged = steps.groupBy("__step").agg(F.sum("__n").alias("__n")).withColumn("__one", F.lit(1))
    whole = cut(merged, "__one").first()
    cuts = cut(steps.where("__lang IS NOT NULL"), "__lang")
    threshold = F.exp(F.coalesce(F.col("__cut"), F.lit(whole["__cut"] if whole else None).cast("long")) * STEP + slack)
    perplexity = F.when(F.col("n_symbols") > 0, F.exp(loss))
    out = scored.join(cuts, F.col(lang_col) == F.col("__lang"), "left").withColumns({"perplexity": perplexity, "threshold": threshold})
    keep = F.coalesce(F.col("perplexity") <= F.coalesce("threshold", F.lit(float("inf"))), F.lit(False))
    return out.select(id_col, lang_col, "n_symbols", "log_prob", "perplexity", "threshold", keep.alias("keep"))
