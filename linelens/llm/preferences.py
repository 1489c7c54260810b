"""Preference formatting of paired conversations.

The longest common prefix of turns of a chosen and a rejected conversation is
rendered once, as the prompt; what follows it are the two completions, with the
spans of the assistant's turns, on which alone a loss is taken.

Rejected conversations are real alternatives where there are any (conversations with
the same opening turn); else the last reply is replaced by one drawn from another
conversation, by the order of a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rendering of a turn: a header with its role, its text, and an end mark.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"
#: Rows that are looked at together for the one that follows each.
RUN = 100_000
SEED = 11
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _text(turn: Column) -> Column:
    """The turn's text; what looks like a mark in it is escaped."""
    return F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("<\\|"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(F.coalesce(turn["role"], F.lit("")), F.lit("|>"), F.lit("|\\>")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _text(t), F.lit(END))), "")


def spans(turns: Column, role: str = TRAINED) -> Column:
    """(start, length) in characters of what is trained in a rendering: text and end mark of a role's turns."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        head, body = F.length(_head(t)).cast("long"), (F.length(_text(t)) + len(END)).cast("long")
        span = F.struct((acc["at"] + head).alias("start"), body.alias("length"))
        return F.struct((acc["at"] + head + body).alias("at"), F.when(t["role"].eqNullSafe(F.lit(role)), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, state, step, lambda acc: acc["out"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns with the same role and text."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def format_pairs(pairs: DataFrame, *, chosen_col: str = "chosen", rejected_col: str = "rejected", keep: tuple[str, ...] = ()) -> DataFrame:
    """Prompt and masked completions of pairs of arrays of (turn, role, text).

    Returns the columns of `keep`, status, n_prompt_turns, prompt, chosen,
    chosen_spans, rejected, rejected_spans. status is 'pair'; 'identical' if both are
    equal (both completions empty); 'prefix' if one is the beginning of the other;
    'single' if there is no rejected conversation (no prompt, rejected is null).
    Null roles and texts render as empty ones.
    """
    a, b = F.col(chosen_col), F.col(rejected_col)
    n = F.when(b.isNull(), F.lit(0)).otherwise(common_turns(a, b))
    cut = pairs.select(*keep, a.alias("__a"), b.alias("__b"), n.alias("__n"))
    rest = lambda c: F.slice(c, F.col("__n") + 1, F.greatest(F.size(c) - F.col("__n"), F.lit(0)))
    cut = cut.select(*keep, "__n", F.col("__b").isNull().alias("__single"), F.slice("__a", F.lit(1), F.col("__n")).alias("__p"), rest(F.col("__a")).alias("__ra"), rest(F.col("__b")).alias("__rb"))
    status = F.when(F.col("__single"), "single").when((F.size("__ra") == 0) & (F.size("__rb") == 0), "identical").when((F.size("__ra") == 0) | (F.size("__rb") == 0), "prefix").otherwise("pair")
    return cut.select(
        *keep, status.alias("status"), F.col("__n").alias("n_prompt_turns"), render(F.col("__p")).alias("prompt"),
        render(F.col("__ra")).alias("chosen"), spans(F.col("__ra")).alias("chosen_spans"), render(F.col("__rb")).alias("rejected"), spans(F.col("__rb")).alias("rejected_spans"),
    )


def conversations_of(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, __turns) with the turns in order; ties go by role, then text.

    Turns without a conversation's id belong to none. A conversation is a row, and has
    to fit into a task's memory as such.
    """
    one = F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return turns.where(F.col(conv_col).isNotNull()).groupBy(conv_col).agg(F.sort_array(F.collect_list(one)).alias("__turns"))


def following(rows: DataFrame, order: list[str], scratch: Scratch, *, run: int = RUN) -> DataFrame:
    """rows with __next, a struct of the columns `order` (no nulls) of the row that follows in that order.

    Rows are dealt in ranges of the order of about `run` rows, so neither a task nor a
    key's rows grow with the input; the last row of a range takes the first of the next.
    """
    n_runs = max(1, -(-rows.count() // run))
    ranged = scratch.keep(rows.repartitionByRange(n_runs, *order).withColumn("__run", F.spark_partition_id()), "ranges")
    one = F.struct(*order)
    # A row for each range.
    firsts = ranged.groupBy("__run").agg(F.min(one).alias("__first"))
    after = firsts.select("__run", F.lead("__first").over(Window.orderBy("__run")).alias("__after"))
    within = ranged.withColumn("__lead", F.lead(one).over(Window.partitionBy("__run").orderBy(*order)))
    return within.join(after, "__run").select(*rows.columns, F.coalesce("__lead", "__after").alias("__next"))


def alternatives(talks: DataFrame, scratch: Scratch, *, conv_col: str = "conv_id", run: int = RUN) -> DataFrame:
    """(conversation, __rejected): each one's next alternative (by id) with the same opening turn; null without."""
    opening = F.sha2(F.concat_ws("|", F.coalesce(F.col("__turns")[0]["role"], F.lit("")), F.coalesce(F.col("__turns")[0]["text"], F.lit(""))), 256)
    keys = scratch.keep(talks.select(conv_col, opening.alias("__opening")), "openings")
    near = following(keys, ["__opening", conv_col], scratch, run=run)
    return near.select(conv_col, F.when(F.col("__next.__opening") == F.col("__opening"), F.col("__next").getField(conv_col)).alias("__rejected"))


def last_reply(turns: Column, role: str = TRAINED) -> Column:
    """Place (from 1) of the last turn of a role, 0 if there is none."""
    at = F.array_position(F.reverse(F.transform(turns, lambda t: t["role"].eqNullSafe(F.lit(role)))), True)
    return F.when(at > 0, F.size(turns) - at + 1).otherwise(0).cast("int")


def donors(talks: DataFrame, scratch: Scratch, *, conv_col: str = "conv_id", seed: int = SEED, run: int = RUN) -> DataFrame:
    """(conversation, __donor): of those with a reply, the next in the order of a seeded hash; the last one's is the first."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(conv_col).cast("string")))
    able = scratch.keep(talks.where(last_reply(F.col("__turns")) > 0).select(draw.alias("__draw"), conv_col), "able")
    first = able.agg(F.min(F.struct("__draw", conv_col)).alias("f")).select(F.col("f").getField(conv_col)).first()[0]
    near = following(able, ["__draw", conv_col], scratch, run=run)
    donor = F.coalesce(F.col("__next").getField(conv_col), F.lit(first))
    return near.select(conv_col, F.when(donor != F.col(conv_col), donor).alias("__donor"))


def preferences(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", seed: int = SEED, run: int = RUN,
) -> DataFrame:
    """One row for each conversation, as the chosen one: conv_id, rejected_id, kind, and what `format_pairs` returns.

    `kind` says where the rejected conversation comes from. 'alternative': the next
    conversation (by id) that opens with the same turn. 'drawn', if there is none: the
    chosen conversation up to its last reply, with that reply's text replaced by the last
    reply of conversation rejected_id, the next in the order of a seeded hash; the
    chosen one ends with its own last reply then. Null, if there is neither: a lone
    conversation, or one without a reply ('single').

    An empty table gives no rows; repeated turn rows are turns like any others. `run`
    doesn't change the result.
    """
    scratch = Scratch(turns.sparkSession, "preferences")
    talks = scratch.keep(conversations_of(turns, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col), "talks")
    real = alternatives(talks, scratch, conv_col=conv_col, run=run)
    drawn = donors(talks, scratch, conv_col=conv_col, seed=seed, run=run)
    kind = F.when(F.col("__rejected").isNotNull(), "alternative").when(F.col("__donor").isNotNull(), "drawn")
    pairs = scratch.keep(real.join(drawn, conv_col, "left").select(conv_col, F.coalesce("__rejected", "__donor").alias("rejected_id"), kind.alias("kind")), "pairs")
    chosen = pairs.join(talks.withColumnRenamed("__turns", "chosen"), conv_col)
    others = talks.select(F.col(conv_col).alias("__other"), F.col("__turns").alias("__others"))
    columns = [conv_col, "rejected_id", "kind", "chosen"]
    # Singles take no part in the second join.
    full = chosen.where("kind IS NOT NULL").join(others, F.col("rejected_id") == F.col("__other"))
    own, other = last_reply(F.col("chosen")), last_reply(F.col("__others"))
    reply = F.element_at("chosen", F.greatest(own, F.lit(1)))
    swapped = F.struct(reply["turn"].alias("turn"), reply["role"].alias("role"), F.element_at("__others", F.greatest(other, F.lit(1)))["text"].alias("text"))
    is_drawn = F.col("kind") == "drawn"
    rejected = F.when(is_drawn, F.array_append(F.slice("chosen", F.lit(1), F.greatest(own - 1, F.lit(0))), swapped)).otherwise(F.col("__others"))
    cut = F.when(is_drawn, F.slice("chosen", F.lit(1), own)).otherwise(F.col("chosen"))
    full = full.select(conv_col, "rejected_id", "kind", cut.alias("chosen"), rejected.alias("rejected"))
    alone = chosen.where("kind IS NULL").select(*columns, F.lit(None).cast(TURNS).alias("rejected"))
    return format_pairs(full.unionByName(alone), keep=(conv_col, "rejected_id", "kind"))


def digest(formatted: DataFrame) -> DataFrame:
    """The same rows with spans as text: start:length, comma-joined."""
    for c in ("chosen_spans", "rejected_spans"):
        formatted = formatted.withColumn(c, F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ","))
    return formatted


def oracle(table: str = "conversations", seed: int = SEED) -> str:
    """The digest in DuckDB's SQL."""
    text = "replace(coalesce(t.text, ''), '<|', '<\\|')"
    head = "'<|' || replace(coalesce(t.role, ''), '|>', '|\\>') || '|>' || chr(10)"
    end = "'<|end|>' || chr(10)"

    def pieces(x: str) -> str:
        return f"list_transform({x}, lambda t: {head} || {text} || {end})"

    def rendered(x: str) -> str:
        return f"coalesce(array_to_string({pieces(x)}, ''), '')"

    def marks(x: str) -> str:
        start = f"coalesce(list_sum(list_transform({x}[1:i-1], lambda t: length({head} || {text} || {end}))), 0) + length(list_extract(list_transform({x}[i:i], lambda t: {head}), 1))"
        size = f"length(list_extract(list_transform({x}[i:i], lambda t: {text} || {end}), 1))"
        return f"coalesce(array_to_string(list_transform(list_filter(range(1, len({x}) + 1), lambda i: coalesce({x}[i].role = '{TRAINED}', false)), lambda i: ({start})::BIGINT::VARCHAR || ':' || ({size})::BIGINT::VARCHAR), ','), '')"

    return f"""
WITH talks AS (SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts FROM {table} WHERE conv_id IS NOT NULL GROUP BY conv_id),
keys AS (SELECT conv_id, ts, coalesce(ts[1].role, '') || '|' || coalesce(ts[1].text, '') AS o, len(ts) + 1 - coalesce(list_position(list_transform(list_reverse(ts), lambda t: coalesce(t.role = '{TRAINED}', false)), true), len(ts) + 1) AS r FROM talks),
able AS (SELECT conv_id, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS donor FROM (SELECT conv_id, md5('{seed}|' || conv_id::VARCHAR) AS draw FROM keys WHERE r > 0) WINDOW w AS (ORDER BY draw, conv_id)),
pairs AS (SELECT k.conv_id, ts, r, lead(k.conv_id) OVER (PARTITION BY o ORDER BY k.conv_id) AS next_id, nullif(donor, k.conv_id) AS donor FROM keys k LEFT JOIN able USING (conv_id)),
named AS (SELECT *, coalesce(next_id, donor) AS rejected_id, CASE WHEN next_id IS NOT NULL THEN 'alternative' WHEN donor IS NOT NULL THEN 'drawn' END AS kind FROM pairs),
both_ AS (SELECT p.conv_id, p.rejected_id, p.kind, CASE WHEN kind = 'drawn' THEN p.ts[1:p.r] ELSE p.ts END AS a,
  CASE WHEN kind = 'drawn' THEN list_append(p.ts[1:p.r-1], {{'turn': p.ts[p.r].turn, 'role': p.ts[p.r].role, 'text': k.ts[k.r].text}}) ELSE k.ts END AS b FROM named p LEFT JOIN keys k ON p.rejected_id = k.conv_id),
cut AS (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i].role IS NOT DISTINCT FROM b[i].role AND a[i].text IS NOT DISTINCT FROM b[i].text), false) - 1, least(len(a), len(b))) END AS n FROM both_),
parts AS (SELECT conv_id, rejected_id, kind, n, a[1:n] AS p, a[n+1:] AS ra, b[n+1:] AS rb, b IS NULL AS alone FROM cut)
SELECT conv_id, rejected_id, kind, CASE WHEN alone THEN 'single' WHEN len(ra) = 0 AND len(rb) = 0 THEN 'identical' WHEN len(ra) = 0 OR len(rb) = 0 THEN 'prefix' ELSE 'pair' END AS status,
  n::INTEGER AS n_prompt_turns, {rendered("p")} AS prompt, {rendered("ra")} AS chosen, {marks("ra")} AS chosen_spans,
  CASE WHEN alone THEN NULL ELSE {rendered("rb")} END AS rejected, CASE WHEN alone THEN NULL ELSE {marks("rb")} END AS rejected_spans FROM parts"""
