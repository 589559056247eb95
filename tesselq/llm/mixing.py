"""Mixing sources to target weights by temperature, realised as block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

GRID = 64
ADDED = ("block", "perm_key", "weight", "epochs")


@dataclass(frozen=True)
class Mix:
    """The exponent found, and what it gives."""

    exponent: float
    entropy: float
    log_sum: float
    budget: float


def words(text: Column) -> Column:
    """Blanks-separated words of a text, its measure in tokens; at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def totals(rows: DataFrame) -> DataFrame:
    """Tokens and documents of each source; rows(source, tokens)."""
    return rows.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("n"))


def find_exponent(sources: DataFrame, entropy: float, repeats: float, rounds: int = 5) -> tuple[float, float, float]:
    """The largest exponent in 0..1 whose weights reach the entropy, or the least that keeps to the repeats.

    Weights are share ** exponent, normalised. entropy: wanted share of the largest possible, log(sources). repeats:
    how often the least source may pass for one pass of the largest. Both fall and rise with the exponent alone, so it is
    bisected, by 64 points at a time: each round is one aggregation over all sources. Returns exponent, entropy, log sum.
    """
    n, total, low, high = sources.agg(F.count("*"), F.sum("total"), F.min("total"), F.max("total")).first()
    if not n:
        return 1.0, 0.0, 0.0
    spread = math.log(high / low)
    floor = max(0.0, 1 - math.log(repeats) / spread) if spread > 0 else 0.0
    share = F.log(F.col("total") / F.lit(float(total)))
    lo, hi, found = floor, 1.0, None
    for _ in range(rounds):
        points = F.explode(F.array(*(F.lit(lo + (hi - lo) * i / GRID) for i in range(GRID + 1)))).alias("a")
        power = F.exp(F.col("a") * F.col("s"))
        sums = sources.select(share.alias("s"), points).groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.col("s")).alias("m")).collect()
        at = sorted((r.a, math.log(r.z) - r.a * r.m / r.z, math.log(r.z)) for r in sums)
        enough = [x for x in at if x[1] >= entropy * math.log(n) - 1e-12]
        found = enough[-1] if enough else at[0]
        i = at.index(found)
        lo, hi = found[0], at[min(i + 1, len(at) - 1)][0]
        if not enough or lo >= hi:
            break
    return found


def plan(sources: DataFrame, entropy: float, repeats: float, budget: int | None) -> tuple[DataFrame, Mix]:
    """sources(source, total, n) with weight and epochs, and the mix. No budget: one pass of the largest source."""
    a, h, log_z = find_exponent(sources, entropy, repeats)
    total, high = sources.agg(F.sum("total"), F.max("total")).first()
    if total is None:
        return sources.withColumns({"weight": F.lit(0.0), "epochs": F.lit(0.0)}), Mix(a, h, log_z, 0.0)
    log_share = F.log(F.col("total") / F.lit(float(total)))
    weight = F.exp(a * log_share - log_z)
    tokens = float(budget) if budget is not None else math.exp(math.log(high) + log_z - a * math.log(high / total))
    return sources.withColumns({"weight": weight, "epochs": F.round(weight * tokens / F.col("total"), 9)}), Mix(a, h, log_z, tokens)


def mix(docs: DataFrame, entropy: float = 0.97, repeats: float = 2.0, budget: int | None = None, seed: int = 5, most_sources: int = 100_000) -> DataFrame:
    """docs, each row as often as its source's weight gives it, with the columns block, perm_key, weight and epochs.

    A source of e epochs passes floor(e) times whole, each time in another order (a block's order is that of perm_key),
    and then by the first documents of one more permutation, until the tokens of the fraction are spent: the document
    that reaches them is the last. With no budget, the largest source passes once, so no document is lost.
    Everything is DataFrame functions. A source's cut in its last block is found in two steps, by sums of 4096 ranges of
    perm_key and then within one range, so that a source with a third of the rows is nobody's single task. The sources'
    table is broadcast if it has at most most_sources rows; of a larger one the tenth of that with the most documents
    is, and rows of the other sources alone, each with less than one in most_sources / 10 of all rows, meet theirs by shuffling.

    Null source: a source of its own. Null or empty text: one token. Null doc_id: as any other. Repeated rows: mixed
    alike. Empty table: no rows. Columns with the added names, in any case, are replaced; others stay, whatever their names.
    """
    source = F.struct(F.col("source").isNotNull().alias("known"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    at = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))

    small = written(docs.select(source.alias("source"), words(F.col("text")).alias("tokens"), at.alias("at")), "mix-rows")
    planned, found = plan(totals(small), entropy, repeats, budget)
    planned = written(planned.select("source", "n", "total", "weight", "epochs", F.floor("epochs").alias("whole")), "mix-plan")
    heavy = None
    if planned.count() > most_sources:
        heavy = written(planned.orderBy(F.desc("n"), "source").limit(most_sources // 10).select("source"), "mix-heavy")
    wanted = planned.select("source", "whole", ((F.col("epochs") - F.col("whole")) * F.col("total")).alias("rest")).where("rest >= 1")

    # the permutation of the last block orders by a hash of (seed, block, row hash)
    part = _meet(small, wanted, heavy).withColumn("perm", F.xxhash64(F.lit(seed), "whole", "at"))
    part = part.withColumn("range", F.shiftright("perm", 52).cast("int"))
    sums = part.groupBy("source", "range", "rest").agg(F.sum("tokens").alias("sum"))
    sums = sums.withColumn("before", F.sum("sum").over(Window.partitionBy("source").orderBy("range")) - F.col("sum"))
    edge = sums.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") >= F.col("rest"))).select("source", F.col("range").alias("edge"), "before")
    near = _meet(part, edge, heavy).where("range = edge")
    spent = near.withColumn("spent", F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("perm").rangeBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    cut = spent.where(F.col("spent") < F.col("rest")).groupBy("source").agg(F.max("perm").alias("cut"))
    final = written(planned.select("source", "weight", "epochs", "whole").join(cut, "source", "left"), "mix-final")

    kept = F.struct(*(c for c in docs.columns if c.lower() not in ADDED))
    rows = _meet(docs.select(kept.alias("row"), source.alias("source"), at.alias("at")), final, heavy)
    last = F.when(F.xxhash64(F.lit(seed), "whole", "at") <= F.col("cut"), F.col("whole")).otherwise(F.col("whole") - 1)
    blocks = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), last).cast("long")), lambda b: b <= last)
    rows = rows.withColumn("block", F.explode(blocks))
    return rows.select("row.*", "block", F.xxhash64(F.lit(seed), "block", "at").alias("perm_key"), "weight", "epochs")


def _meet(rows: DataFrame, table: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """rows joined with table, which has one row for each source at most, by source.

    heavy: the sources with the most documents where there are too many to broadcast them all; no other is large.
    """
    if heavy is None:
        return rows.join(F.broadcast(table), "source")
    some = rows.join(F.broadcast(table.join(F.broadcast(heavy), "source", "left_semi")), "source")
    return some.unionByName(rows.join(F.broadcast(heavy), "source", "left_anti").join(table, "source"))
