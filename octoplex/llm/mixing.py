"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

Each source's share of all tokens is raised to an exponent and normalised. The exponent is bisected so that the mixture
has a target entropy or repeats no source more often than a limit. The weights are then realised under a token budget:
a source is dealt into blocks, each epoch takes the blocks in another permutation, and the last epoch ends where the
source's budget does. DataFrame operations only; of the sources only sums reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, private, table

#: Bisection steps that one job takes at once, and jobs.
STEPS, JOBS = 6, 7


@dataclass(frozen=True)
class Mix:
    """What to aim at: `entropy` in nats, or else `max_repeats` epochs of the most repeated source.

    budget_tokens of None is the smallest budget at which every source is seen once in full. A budget below that takes
    part of a source's documents, by permutation.
    """

    entropy: float | None = None
    max_repeats: float = 2.0
    budget_tokens: float | None = None
    block_tokens: int = 65_536
    seed: int = 7


def tokens(text: Column) -> Column:
    """Tokens of a text, counted as a quarter of its code points, rounded up, and 1 at least."""
    return F.greatest(F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4), F.lit(1)).cast("bigint")


def source_tokens(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_tokens); a null source is one of its own."""
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(tokens(F.col("text"))).alias("n_tokens"))


def exponent(totals: DataFrame, mix: Mix) -> float:
    """The exponent in [0, 1], rounded to 9 places, at which the target is met, or its nearest bound.

    Entropy falls and repetition, counted against the least repeated source, grows less as the exponent rises to 1.
    Each job evaluates all points of the next STEPS bisections, so few jobs run and only 2 numbers a point come back.
    """
    spread = totals.where("n_tokens > 0").agg(F.sum("n_tokens").alias("n"), F.min("n_tokens").alias("lo"), F.max("n_tokens").alias("hi")).first()
    if not spread["n"] or spread["lo"] == spread["hi"]:
        return 1.0

    def enough(alpha: float, s: float, t: float) -> bool:
        """Is the exponent small enough (entropy) or large enough (repetition)?"""
        if mix.entropy is not None:
            import math

            return math.log(s) - alpha * t / s <= mix.entropy
        return (1 - alpha) * (math_log(spread["hi"]) - math_log(spread["lo"])) <= math_log(mix.max_repeats)

    from math import log as math_log

    lo, hi = 0.0, 1.0
    share = F.col("n_tokens") / F.lit(float(spread["n"]))
    for _ in range(JOBS):
        points = [lo + (hi - lo) * k / 2**STEPS for k in range(2**STEPS + 1)]
        sums = [x for p in points for x in (F.sum(F.pow(share, F.lit(p))), F.sum(F.pow(share, F.lit(p)) * F.log(share)))]
        got = totals.where("n_tokens > 0").agg(*[x.alias(f"x{k}") for k, x in enumerate(sums)]).first() if mix.entropy is not None else [0.0] * len(sums)
        met = [enough(p, got[2 * k], got[2 * k + 1]) for k, p in enumerate(points)]
        first = next((k for k, x in enumerate(met) if x), len(met) - 1)
        if first == 0:
            return round(points[0], 9)
        lo, hi = points[first - 1], points[first]
    return round(hi, 9)


def source_plan(docs: DataFrame, mix: Mix) -> tuple[DataFrame, float]:
    """(source, n_docs, n_tokens, weight, budget, epochs) and the exponent. epochs is the whole epochs, then comes the rest."""
    totals = cut(source_tokens(docs))
    alpha = exponent(totals, mix)
    lifted = totals.withColumn("lifted", F.pow(F.col("n_tokens").cast("double"), F.lit(alpha)))
    sums = lifted.agg(F.sum("lifted").alias("s"), F.max(F.col("n_tokens") / F.col("lifted")).alias("need")).first()
    budget = mix.budget_tokens if mix.budget_tokens is not None else (sums["s"] or 0.0) * (sums["need"] or 0.0)
    weight = F.col("lifted") / F.lit(sums["s"] or 1.0)
    plan = lifted.withColumn("weight", weight).withColumn("budget", F.round(F.col("weight") * F.lit(float(budget)), 0).cast("bigint"))
    return plan.withColumn("epochs", F.floor(F.col("budget") / F.col("n_tokens"))).drop("lifted"), alpha


def _key(*parts) -> Column:
    """A hash that other engines have too: the first 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts).cast("binary")), 1, 15), 16, 10).cast("bigint")


def mixture(docs: DataFrame, mix: Mix = Mix(), keep: list[str] | None = None) -> DataFrame:
    """One row for each time a document is used: docs, or its columns `keep`, with epoch, block and place (0 to 1).

    Reading in the order of place interleaves the sources by weight all the way through. Every whole epoch of a source
    has all its documents; the rest of its budget takes blocks in permuted order, and of the block that goes over it the
    documents, in order of their hash, that begin before the budget ends. Rows with an equal id share one fate, and so do
    rows without an id that have equal texts. Columns named like the added ones are replaced, any others stay as they
    are. Null texts count as one token, a null source is a source.
    """
    columns = [c for c in (keep or docs.columns) if c not in ("epoch", "block", "place")]
    plan, _ = source_plan(docs, mix)
    plan = cut(plan.withColumn("n_blocks", F.ceil(F.col("n_tokens") / mix.block_tokens)))
    _t, _k, _s, _block, _epochs, _b, _n, _epoch, _extra = private(docs, "_t", "_k", "_s", "_block", "_epochs", "_b", "_n", "_epoch", "_extra")
    me = F.coalesce(F.col("d.doc_id").cast("string"), F.concat(F.lit("\x00"), F.md5(F.coalesce(F.col("d.text"), F.lit("")).cast("binary"))))
    named = F.coalesce(F.col("p.source"), F.lit("\x00"))
    which = F.pmod(_key(F.lit(mix.seed), F.lit("block"), named, me), F.col("p.n_blocks"))
    joined = docs.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    placed = joined.select(
        *[F.col(f"d.`{c}`") for c in columns], tokens(F.col("d.text")).alias(_t), me.alias(_k), named.alias(_s), which.alias(_block),
        F.col("p.epochs").alias(_epochs), F.col("p.budget").alias(_b), F.col("p.n_tokens").alias(_n),
    )
    # Block sums, and where in the permutation of the last epoch each block begins.
    sums = cut(
        joined.select(named.alias("s"), which.alias("block"), tokens(F.col("d.text")).alias("t"), "p.epochs", (F.col("p.budget") - F.col("p.epochs") * F.col("p.n_tokens")).alias("rest"))
        .groupBy("s", "block").agg(F.sum("t").alias("in_block"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"))
        .withColumn("turn", _key(F.lit(mix.seed), F.col("epochs"), F.col("s"), F.col("block")))
    )
    # Two levels of prefix sums, so that no task holds a hot source's blocks.
    sums = sums.withColumn("part", F.shiftright("turn", 50))
    parts = sums.groupBy("s", "part").agg(F.sum("in_block").alias("n"))
    parts = parts.withColumn("before_part", F.sum("n").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    inner = Window.partitionBy("s", "part").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, 0)
    begins = sums.withColumn("within", F.sum("in_block").over(inner) - F.col("in_block")).join(parts, ["s", "part"])
    begins = begins.withColumn("begin", F.col("within") + F.col("before_part")).where("begin < rest")
    taken = cut(begins.select("s", "block", (F.col("begin") + F.col("in_block") <= F.col("rest")).alias("whole"), (F.col("rest") - F.col("begin")).alias("room")))
    # Of the one block of each source that goes over its budget: the documents that begin before its end.
    ids = joined.select(named.alias("s"), which.alias("block"), me.alias("k"), tokens(F.col("d.text")).alias("t"))
    ids = ids.withColumn("order", _key(F.lit(mix.seed), F.lit("order"), F.col("k")))
    order = Window.partitionBy("s").orderBy("order", "k", "t").rowsBetween(Window.unboundedPreceding, 0)
    cutoff = ids.join(taken.where("not whole").select("s", "block", "room"), ["s", "block"]).withColumn("begin", F.sum("t").over(order) - F.col("t")).where("begin < room")
    last = cut(cutoff.groupBy("s").agg(F.max(F.struct("order", "k")).alias("upto")))
    chosen = cut(taken.join(last, "s", "left").select(F.col("s").alias(_s), F.col("block").alias(_block), F.struct("whole", "upto").alias(_extra)))
    rows = placed.join(chosen, [_s, _block], "left")
    mine = F.struct(_key(F.lit(mix.seed), F.lit("order"), F.col(_k)).alias("order"), F.col(_k).alias("k"))
    extra = F.coalesce(F.col(f"{_extra}.whole") | (mine <= F.col(f"{_extra}.upto")), F.lit(False)).cast("bigint")
    uses = F.when(F.col(_epochs) + extra > 0, F.sequence(F.lit(0).cast("bigint"), F.col(_epochs) + extra - 1))
    out = rows.withColumn(_epoch, F.explode(uses))
    spot = (_key(F.lit(mix.seed), F.col(_epoch), F.col(_s), F.col(_block)) + _key(F.lit(mix.seed), F.col(_epoch), F.col(_k)) / F.lit(float(2**60))) / F.lit(float(2**60))
    length = F.when(F.col(_epoch) < F.col(_epochs), F.col(_n)).otherwise(F.col(_b) - F.col(_epochs) * F.col(_n))
    place = (F.col(_epoch) * F.col(_n) + F.least(spot, F.lit(1.0)) * length) / F.greatest(F.col(_b), F.lit(1))
    return out.select(*[F.col(f"`{c}`") for c in columns], F.col(_epoch).alias("epoch"), F.col(_block).alias("block"), place.alias("place"))


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture(docs, Mix(), ["doc_id", "source"])
