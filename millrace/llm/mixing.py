"""Mixing sources to target weights, by temperature. DataFrame functions only.

Source shares p of the tokens become weights q = p^a / sum p^a. The exponent a in
[0, 1] is bisected (several levels at a time, one small aggregation each): entropy
falls and repetition falls as a grows, so the largest a that reaches the target
entropy is taken, or the smallest that keeps repetition within its limit if that is
larger. The budget is a number of tokens, or by default the least one with which
every document is used at least once. Repetition is the budget of a source over its
tokens: no document is used more often than that, rounded up. A budget that exceeds the
limit for any weights is an error.

A source's budget is realised by block permutations. Each pass over the source is a
permutation of its documents by a hash of seed, pass and id; whole passes come first,
and the last one ends where the budget is used up. The stream is cut into blocks of
equal size, and each block takes the same share of every source's budget, so that the
weights hold in each block and not only in total; `slot` orders a block.

Positions are running sums in two steps, within ranges of the hash of bounded size
and over the ranges' totals, so that a source of any size is never in one task.

Definitions for odd input: null source is a source of its own; null or empty texts
have no tokens, take no budget and stay in each pass that reaches them; a source
without tokens has weight 0 and each of its documents is used once; repeated rows are
used like different ones at the same place; texts of any length are counted whole; an
empty table gives an empty result; `mixed` keeps all columns whatever their names, and
`mixture` reads none but the three that it is told.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fresh, session_of

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source in a range of the hash, on average, and most ranges of a source.
RANGE_DOCS, MOST_RANGES = 2000, 1 << 16
LEVELS, ROUNDS = 4, 7


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit("\u0000null"))


def _place(seed: int, passing: Column, id_: Column) -> Column:
    """A number in [0, 1) that orders the documents of a pass."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), passing.cast("int"), id_), 11) / F.lit(float(1 << 53))


def source_totals(rows: DataFrame) -> DataFrame:
    """source, docs, total of rows with source and n_tokens."""
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("total"))


def _measures(sources: DataFrame, exponents: list[float], budget: float | None) -> list[tuple[float, float]]:
    """(entropy, most uses of a source's tokens) at each exponent; without a budget, the source used least is used once."""
    total = float(sources.agg(F.sum("total")).first()[0])
    shares = sources.filter("total > 0").select((F.col("total") / total).alias("p"))
    sums = [f for a in exponents for f in (F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p")))]
    got = shares.agg(F.min("p"), F.max("p"), *sums).first()
    low, high = got[0], got[1]
    uses = lambda a, z: (high / low) ** (1 - a) if budget is None else budget / total * low ** (a - 1) / z
    return [(math.log(z) - a * e / z, uses(a, z)) for a, z, e in zip(exponents, got[2::2], got[3::2], strict=True)]


def _bisect(sources: DataFrame, budget: float | None, holds) -> tuple[float, float]:
    """The last exponent seen at which holds(entropy, uses), true up to a border in [0, 1], is true, and the first at which it isn't."""
    low, high = 0.0, 1.0
    (first, last) = (holds(*m) for m in _measures(sources, [0.0, 1.0], budget))
    if not first:
        return 0.0, 0.0
    if last:
        return 1.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * k / (1 << LEVELS) for k in range(1, 1 << LEVELS)]
        true = [holds(*m) for m in _measures(sources, points, budget)]
        at = true.index(False) if False in true else len(points)
        edges = [low, *points, high]
        low, high = edges[at], edges[at + 1]
    return low, high


def solve_exponent(sources: DataFrame, target_entropy: float, max_repeats: float, budget: float | None = None) -> float:
    """target_entropy: a share of the largest possible, the logarithm of the number of sources."""
    n = sources.filter("total > 0").count()
    if not n:
        return 1.0
    if budget is not None and _measures(sources, [1.0], budget)[0][1] > max_repeats * (1 + 1e-9):
        raise ValueError(f"a budget of {budget} tokens uses some document more than {max_repeats} times with any weights")
    if n < 2:
        return 1.0
    wanted = target_entropy * math.log(n)
    for_entropy = _bisect(sources, budget, lambda entropy, _: entropy >= wanted)[0]
    for_repeats = _bisect(sources, budget, lambda _, uses: uses > max_repeats)[1]
    return max(for_entropy, for_repeats)


def plan(rows: DataFrame, scratch: Scratch, *, target_entropy: float, max_repeats: float, budget: float | None) -> DataFrame:
    """source, docs, total, weight, budget (tokens), passes (whole ones), rest (tokens of the last pass); small: a row per source.

    rows: id, source, n_tokens.
    """
    sources = scratch.keep(source_totals(rows), "sources")
    exponent = solve_exponent(sources, target_entropy, max_repeats, budget)
    total = float(sources.agg(F.sum("total")).first()[0] or 1)
    power = F.when(F.col("total") > 0, F.pow(F.col("total") / total, F.lit(exponent))).otherwise(F.lit(0.0))
    z, least = sources.agg(F.sum(power), F.max(F.when(F.col("total") > 0, F.col("total") / power))).first()
    if budget is None:
        budget = (least or 0.0) * (z or 1.0)
    weighted = sources.withColumn("weight", power / F.lit(z or 1.0)).withColumn("budget", F.col("weight") * F.lit(float(budget)))
    # A whole pass that rounding leaves short by a token in a million counts as whole.
    ratio = F.when(F.col("total") > 0, F.col("budget") / F.col("total")).otherwise(F.lit(1.0))
    passes = F.floor(ratio + 1e-9).cast("int")
    rest = F.greatest(F.when(F.col("total") > 0, F.col("budget") - passes * F.col("total")).otherwise(F.lit(0.0)), F.lit(0.0))
    rest = F.when(rest < F.col("total") * 1e-8, F.lit(0.0)).otherwise(rest)
    return scratch.keep(weighted.withColumn("passes", passes).withColumn("rest", rest), "plan")


def schedule(rows: DataFrame, planned: DataFrame, *, seed: int, block_tokens: int) -> DataFrame:
    """id, source, n_tokens, weight, pass, block, slot, place, whole: each use of each document."""
    ranges = F.least(F.ceil(F.col("docs") / RANGE_DOCS), F.lit(MOST_RANGES)).cast("int")
    last = F.when(F.col("rest") > 0, F.col("passes")).otherwise(F.col("passes") - 1)
    uses = rows.join(planned.withColumn("ranges", ranges), "source")
    uses = uses.filter(last >= 0).withColumn("pass", F.explode(F.sequence(F.lit(0), last)))
    uses = uses.withColumn("place", _place(seed, F.col("pass"), F.col("id"))).withColumn("range", F.floor(F.col("place") * F.col("ranges")).cast("int"))
    totals = uses.groupBy("source", "pass", "range").agg(F.sum("n_tokens").alias("held"))
    before = F.sum("held").over(Window.partitionBy("source", "pass").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("source", "pass", "range", F.coalesce(before, F.lit(0)).alias("before"))
    running = F.sum("n_tokens").over(Window.partitionBy("source", "pass", "range").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1))
    placed = uses.withColumn("start", F.coalesce(running, F.lit(0))).join(totals, ["source", "pass", "range"]).withColumn("start", F.col("start") + F.col("before"))
    whole = F.col("pass") < F.col("passes")
    used = placed.filter(whole | (F.col("start") < F.col("rest")))
    blocks = F.greatest(F.ceil(F.col("budget") / F.col("weight") / F.lit(float(block_tokens))), F.lit(1))
    part = (F.col("pass") * F.col("total") + F.col("start")) / F.greatest(F.col("budget"), F.lit(1.0))
    block = F.when(F.col("weight") > 0, F.least(F.floor(part * blocks), blocks - 1)).otherwise(F.lit(0)).cast("long")
    return used.withColumn("block", block).select(
        "id", "source", "n_tokens", "weight", "pass", "block", F.xxhash64(F.lit(seed), "block", "pass", "id").alias("slot"), "place", whole.alias("whole")
    )


def _rows(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), _key(F.col(source_col)).alias("source"), tokens(F.col(text_col)).alias("n_tokens"))


def mixture(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float = 0.98,
    max_repeats: float = 3.0,
    budget: float | None = None,
    block_tokens: int = 1_000_000,
    seed: int = 7,
) -> DataFrame:
    """One row per use of a document: id, source, n_tokens, weight (of the source), pass, block, slot (order in the block)."""
    scratch = Scratch(session_of(df), "mix")
    rows = scratch.keep(_rows(df, id_col, text_col, source_col), "rows")
    planned = plan(rows, scratch, target_entropy=target_entropy, max_repeats=max_repeats, budget=budget)
    out = schedule(rows, planned, seed=seed, block_tokens=block_tokens)
    source = F.when(F.col("source") != "\u0000null", F.col("source"))
    return out.select(F.col("id").alias(id_col), source.alias(source_col), "n_tokens", "weight", "pass", "block", "slot")


def mixed(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float = 0.98,
    max_repeats: float = 3.0,
    budget: float | None = None,
    seed: int = 7,
) -> DataFrame:
    """df with each row as often as the mixture uses it; texts are not shuffled.

    Where the last pass of a source ends is one number per source, against which each
    row's own place is held.
    """
    scratch = Scratch(session_of(df), "mix")
    rows = scratch.keep(_rows(df, id_col, text_col, source_col), "rows")
    planned = plan(rows, scratch, target_entropy=target_entropy, max_repeats=max_repeats, budget=budget)
    uses = schedule(rows, planned, seed=seed, block_tokens=1 << 40)
    ends = uses.filter("not whole").groupBy("source").agg(F.max("place").alias("end"))
    source, passes, end, use = fresh(df, "source", "passes", "end", "use")
    cuts = planned.join(ends, "source", "left").select(F.col("source").alias(source), F.col("passes").alias(passes), F.coalesce("end", F.lit(-1.0)).alias(end))
    cuts = scratch.keep(cuts, "cuts")
    joined = df.join(cuts, _key(df[source_col]) == cuts[source])
    times = F.col(passes) + (_place(seed, F.col(passes), df[id_col]) <= F.col(end)).cast("int")
    return joined.withColumn(use, F.explode(F.array_repeat(F.lit(1), times))).select(*[df[c] for c in df.columns])
