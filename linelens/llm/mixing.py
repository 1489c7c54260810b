"""Mixing sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern, the set of sources that they belong
to. In the flow network a pattern supplies its tokens once for each repetition,
later repetitions at a higher (convex) cost, and each source takes its quota from
the patterns that it is in. The cheapest flow of the greatest amount says how many
tokens each source takes from each pattern; whole documents are then selected in
the order of a seeded hash.

Only sums by pattern reach the driver: their number follows the number of
sources and of their overlaps, not of documents.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, packed, unpacked

WEIGHTS, MOST_REPEATS = (1, 2, 3), 3
#: Ranges of the seeded hash by which sums are taken before single documents are ordered.
RANGES = 4096


def n_tokens(text: Column) -> Column:
    """Number of runs of characters other than white space; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def quotas(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> dict[str | None, float]:
    """Targets of the sources, which are in the order in which the weights repeat.

    They share the sum of all sizes by weight; a source stops at `most` times its size
    and its excess is shared among the others by weight, until none is above.
    """
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    total = sum(n for _, n in sizes)
    # Sources reach their limits in the order of size over weight.
    order = sorted(sizes, key=lambda x: (x[1] / weight[x[0]], weight[x[0]]))
    left, heft = total, sum(weight.values())
    stopped = set()
    for s, n in order:
        if heft and most * n * heft < left * weight[s]:
            stopped.add(s)
            left -= most * n
            heft -= weight[s]
        else:
            break
    rate = left / heft if heft else 0.0
    return {s: float(most * n) if s in stopped else rate * weight[s] for s, n in sizes}


class Network:
    """Minimum-cost flow by successive shortest paths with potentials."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for to, at, r, c in ((b, a, room, cost), (a, b, 0, -cost)):
            self.out[at].append(len(self.to))
            self.to.append(to)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        n = len(self.out)
        height = [0] * n
        while True:
            far: list[float] = [float("inf")] * n
            far[source], via = 0, [-1] * n
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    if self.room[e] and (x := d + self.cost[e] + height[a] - height[self.to[e]]) < far[self.to[e]]:
                        far[self.to[e]], via[self.to[e]] = x, e
                        heapq.heappush(heap, (x, self.to[e]))
            if via[sink] < 0:
                return
            # Nodes beyond the sink rise as it does, which keeps all costs from falling under zero.
            height = [int(h + min(f, far[sink])) for h, f in zip(height, far)]
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def route(supply: list[int], members: list[list[int]], quota: list[int], most: int = MOST_REPEATS) -> dict[tuple[int, int], int]:
    """Tokens from pattern p to source s, as {(p, s): amount}; repetition r costs r squared."""
    n_p, n_s = len(supply), len(quota)
    net = Network(2 + n_p + n_s)
    flows = {}
    for p, n in enumerate(supply):
        for r in range(most):
            net.arc(0, 2 + p, n, (r + 1) ** 2)
        for s in members[p]:
            flows[p, s] = net.arc(2 + p, 2 + n_p + s, most * n, 0)
    for s, n in enumerate(quota):
        net.arc(2 + n_p + s, 1, n, 0)
    net.run(0, 1)
    return {k: net.room[e ^ 1] for k, e in flows.items() if net.room[e ^ 1]}


@dataclass
class Plan:
    """Quotas of the sources, and the tokens taken of each pattern."""

    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    taken: dict[tuple, int]


def connected(members: list[list[int]]) -> list[list[int]]:
    """Numbers of the patterns in groups that share no source with each other; those without a source are in none."""
    root: dict[int, int] = {}

    def find(s: int) -> int:
        while root.setdefault(s, s) != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    for own in members:
        for s in own[1:]:
            root[find(s)] = find(own[0])
    groups: dict[int, list[int]] = {}
    for p, own in enumerate(members):
        if own:
            groups.setdefault(find(own[0]), []).append(p)
    return list(groups.values())


def plan(patterns: list[tuple[tuple, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> Plan:
    """patterns: (sources of a pattern, its tokens). Sources go by code point, null last.

    A source's size counts the patterns that it is in; shared tokens count for each.
    """
    sizes: dict[str | None, int] = {}
    for own, n in patterns:
        for s in own:
            sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(order)}
    targets = quotas([(s, sizes[s]) for s in order], weights, most)
    members = [[number[s] for s in own] for own, _ in patterns]
    taken: dict[tuple, int] = {}
    # Patterns and sources that hang together are routed together.
    for group in connected(members):
        near = sorted({s for p in group for s in members[p]})
        place = {s: i for i, s in enumerate(near)}
        flow = route([patterns[p][1] for p in group], [[place[s] for s in members[p]] for p in group], [round(targets[order[s]]) for s in near], most)
        for (p, _), n in flow.items():
            own = patterns[group[p]][0]
            taken[own] = taken.get(own, 0) + n
    return Plan(sizes, targets, taken)


def _fitted(light: DataFrame, wanted: dict[tuple, int], scratch: Scratch) -> dict[tuple, list[tuple[int, int]]]:
    """The rounds (rest, cut) of each pattern of which a part is wanted: they say which documents make it up.

    In a round the documents that still fit are taken in the order of their draw as long
    as their sum does. The next round has those that fit into the rest, until none does.
    A document is taken if it is no larger than a round's rest and its draw no larger
    than that round's cut; documents of one draw are taken together.

    What is wanted and the rounds are a row for each pattern, and patterns have been at the
    driver; it leads them, so that a round writes one small table and reads the rest in one query.
    """
    rest = {own: n for own, n in wanted.items() if n > 0}
    rounds: dict[tuple, list[tuple[int, int]]] = {own: [] for own in rest}
    while rest:
        state = _small(scratch, [(list(own), n, rounds[own]) for own, n in rest.items()], f"__own array<string>, __rest long, {_ROUNDS}", "state")
        left = light.join(state, "__own").where((F.col("__size") > 0) & (F.col("__size") <= F.col("__rest")) & ~_taken())
        sums = left.groupBy("__own", "__range").agg(F.sum("__size").alias("__sum"), F.max("__rest").alias("__rest"))
        before = Window.partitionBy("__own").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        # The range of draws in which the rest ends; before it all fits.
        ahead = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
        ends = ahead.where(F.col("__before") <= F.col("__rest")).groupBy("__own").agg(F.max(F.struct("__range", "__before")).alias("e")).select("__own", F.col("e.__range").alias("__end"), F.col("e.__before").alias("__before"))
        # Inside that range, which has a document at least, they are summed one by one.
        upto = Window.partitionBy("__own").orderBy("__draw").rangeBetween(Window.unboundedPreceding, 0)
        edge = left.join(ends, "__own").where("__range = __end").withColumn("__upto", F.col("__before") + F.sum("__size").over(upto))
        fits = F.col("__upto") <= F.col("__rest")
        last = edge.groupBy("__own").agg(F.max(F.when(fits, F.col("__draw"))).alias("__last"), F.max(F.when(fits, F.col("__upto"))).alias("__sum"), F.max("__end").alias("__end"), F.max("__before").alias("__before"))
        # If not even the first document of the last range fits, the cut lies before that range.
        cut = last.select("__own", F.coalesce("__last", F.shiftleft(F.col("__end").cast("long"), 40) - 1).alias("__cut"), F.coalesce("__sum", "__before").alias("__sum")).where("__sum > 0")
        after = {}
        for r in cut.collect():
            own = tuple(r["__own"])
            rounds[own].append((rest[own], r["__cut"]))
            after[own] = rest[own] - r["__sum"]
        # Nothing fits into a rest of nothing.
        rest = {own: n for own, n in after.items() if n > 0}
    return rounds


_ROUNDS = "__rounds array<struct<rest:bigint,cut:bigint>>"


def _small(scratch: Scratch, rows: list[tuple], schema: str, name: str) -> DataFrame:
    """A row for each pattern as a table of one file, of which Spark knows the size when it joins.

    A file costs its executor up to three processes for its mode where Hadoop has no native library.
    """
    return scratch.keep(scratch.spark.createDataFrame(rows, schema).coalesce(1), name)


def _taken() -> Column:
    return F.exists("__rounds", lambda r: (F.col("__size") <= r["rest"]) & (F.col("__draw") <= r["cut"]))


def _dealt(
    docs: DataFrame, *, id_col: str, text_col: str, sources_col: Column | None, weights: tuple[int, ...], most: int, seed: int, carry: bool, max_patterns: int,
) -> DataFrame:
    """Rows with __size, __repeats, source_size and target; with `carry` the input's columns as __row, else the id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sources = F.coalesce(sources_col, F.array().cast("array<string>")) if sources_col is not None else F.array("source")
    own = F.sort_array(F.array_distinct(sources), asc=True)
    # 52 bits of a hash over seed and id, and of them the range that the first 12 are.
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    marks = [own.alias("__own"), n_tokens(F.col(text_col)).alias("__size"), draw.alias("__draw"), F.shiftright(draw, 40).cast("int").alias("__range")]
    light = scratch.keep(docs.select(id_col, *marks), "rows")

    rows = light.groupBy("__own").agg(F.sum("__size").alias("n")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = sorted(((tuple(r["__own"]), int(r["n"])) for r in rows), key=lambda x: [(s is None, s or "") for s in x[0]])
    made = plan(patterns, weights, most)

    # One row for each pattern, max_patterns at most: passes over all of it, and the part that is left.
    passes = {own: divmod(made.taken.get(own, 0), n) if n else (0, 0) for own, n in patterns}
    rounds = _fitted(light, {own: part for own, (_, part) in passes.items()}, scratch)
    lines = [(list(own), made.sizes[own[0]] if own else 0, made.targets[own[0]] if own else 0.0, passes[own][0], rounds.get(own)) for own, _ in patterns]
    info = _small(scratch, lines, f"__own array<string>, __source_size long, __target double, __whole int, {_ROUNDS}", "plan")
    repeats = F.when(F.col("__size") == 0, F.lit(0)).otherwise(F.col("__whole") + F.coalesce(_taken(), F.lit(False)).cast("int"))
    full = docs.select(packed(docs), *marks) if carry else light
    return full.join(info, "__own").withColumn("__repeats", repeats)


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sources_col: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 7, max_patterns: int = 200_000,
) -> DataFrame:
    """How often each document is taken so that the sources meet their targets.

    `sources_col` is an array of the sources that a document belongs to; by default its
    one column `source`. Returns id, size, source_size and target (of its first source),
    taken (size times repeats) and repeats.

    Sizes are words between white space; null and empty texts have size 0 and are never
    taken. Null is a source of its own, last in order; documents whose array of sources
    is null or empty belong to none, and aren't taken. A pattern of which q whole passes
    and a part are wanted gives each document q times, and once more to those that come
    first by hash as long as they fit into the part, then to those that fit into its
    rest, until none does. Rows with the same id and size are taken alike. A table with
    no tokens takes nothing. More than `max_patterns` patterns raise an error: their
    sums go to the driver.
    """
    dealt = _dealt(docs, id_col=id_col, text_col=text_col, sources_col=sources_col, weights=weights, most=most, seed=seed, carry=False, max_patterns=max_patterns)
    return dealt.select(
        id_col, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__repeats")).cast("long").alias("taken"), F.col("__repeats").alias("repeats"),
    )


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sources_col: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 7, max_patterns: int = 200_000) -> DataFrame:
    """The mix itself: each row of docs as often as `mix` takes it, all columns as they are."""
    dealt = _dealt(docs, id_col=id_col, text_col=text_col, sources_col=sources_col, weights=weights, most=most, seed=seed, carry=True, max_patterns=max_patterns)
    return dealt.where("__repeats > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__repeats"))).alias("__copy")).select(*unpacked(docs.columns))


def oracle(docs: str = "documents", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 7) -> str:
    """`mix` in DuckDB's SQL, for documents of one source each: a source is a pattern, and the flow fills its quota."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS draw FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cases} END AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY n / w, w, source NULLS LAST) AS k, (SELECT sum(n) FROM s) AS total, (SELECT sum(w) FROM s) AS heft FROM s),
p AS (SELECT *, total - {most} * coalesce(sum(n) OVER b, 0) AS left_, heft - coalesce(sum(w) OVER b, 0) AS heft_ FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, bool_and({most} * n * heft_ < left_ * w) OVER (ORDER BY k) AS stopped FROM p),
r AS (SELECT (total - {most} * coalesce((SELECT sum(n) FROM q WHERE stopped), 0))::DOUBLE / nullif(heft - coalesce((SELECT sum(w) FROM q WHERE stopped), 0), 0)::DOUBLE AS rate FROM q LIMIT 1),
t AS (SELECT source, n, CASE WHEN stopped THEN ({most} * n)::DOUBLE ELSE coalesce((SELECT rate FROM r), 0) * w END AS target FROM q),
f AS (SELECT *, least(round_even(target, 0)::BIGINT, {most} * n) AS flow FROM t),
g AS (SELECT source, n, target, CASE WHEN n > 0 THEN flow // n ELSE 0 END AS whole, (CASE WHEN n > 0 THEN flow % n ELSE 0 END)::BIGINT AS part FROM f),
rounds AS (
  SELECT 0 AS k, source, part AS rest, []::BIGINT[] AS rests, []::BIGINT[] AS cuts FROM g WHERE part > 0
  UNION ALL
  SELECT k + 1, source, (rest - max(upto))::BIGINT, list_append(rests, rest), list_append(cuts, max(draw)) FROM (
    SELECT r.*, d.draw, (sum(d.size) OVER (PARTITION BY r.source ORDER BY d.draw RANGE UNBOUNDED PRECEDING))::BIGINT AS upto
    FROM rounds r JOIN d ON r.source IS NOT DISTINCT FROM d.source
    WHERE d.size > 0 AND d.size <= r.rest AND len(list_filter(range(1, len(r.rests) + 1), lambda i: d.size <= r.rests[i] AND d.draw <= r.cuts[i])) = 0)
  WHERE upto <= rest GROUP BY k, source, rest, rests, cuts),
z AS (SELECT source, arg_max(rests, k) AS rests, arg_max(cuts, k) AS cuts FROM rounds GROUP BY source)
SELECT doc_id, size, g.n AS source_size, target, (size * reps)::BIGINT AS taken, reps::INTEGER AS repeats FROM (
  SELECT d.*, g.n, g.target, CASE WHEN size = 0 THEN 0 ELSE whole + (len(list_filter(range(1, coalesce(len(rests), 0) + 1), lambda i: size <= rests[i] AND draw <= cuts[i])) > 0)::INTEGER END AS reps
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN z ON d.source IS NOT DISTINCT FROM z.source) g"""
