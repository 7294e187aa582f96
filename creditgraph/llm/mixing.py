"""Mixing sources to target weights: temperature, then budgeted block permutations.

Each source has a share of all tokens. The shares are raised to an exponent and normalised; the exponent is found
by bisection so that the weights have a target entropy and no source repeats more than a limit. A weight times the
token budget is a source's budget: so many whole passes, and a part of one more. Every pass goes through the source's
blocks (BLOCKS by hash) in an order of its own; the partial pass ends at the block boundary nearest the budget, so
a source misses its budget by half a block at most. `at`, from 0 to 1, orders the blocks of all sources: every prefix
of that order holds the sources in about their weights.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and go with their block.
A source with no tokens at all gets no weight: it is passed once if min_passes is 1 or more, else left out.
Repeated rows are documents of their own. No rows give no rows. Columns that clash with new ones stay as they are: the new
ones take underscores before their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, staged

BLOCKS = 1024
MOST_SOURCES = 100_000  # totals of so many sources may come to the driver
BROADCAST_ROWS = 200_000  # rows of the plan that are broadcast: the largest sources'; the other sources are joined by shuffle
NULL_SOURCE = "\x00null"


def words(text: str = "text") -> Column:
    """Tokens of a text where no tokenizer is given: its runs of non-space characters."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def weights(tokens: np.ndarray, exponent: float) -> np.ndarray:
    w = np.where(tokens > 0, np.exp(exponent * np.log(np.maximum(tokens, 1) / max(tokens.sum(), 1))), 0.0)
    return w / w.sum() if w.sum() else w


def bisect(ok, lo: float, hi: float) -> float:
    """The least x in [lo, hi] for which ok holds, if ok stays true above it."""
    if ok(lo):
        return lo
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi


@dataclass
class Mixture:
    exponent: float
    weights: dict[str, float]
    budgets: dict[str, float]


def fit(tokens: dict[str, int], budget: float | None = None, target_entropy: float | None = None, max_repeats: float | None = None, min_passes: float = 0) -> Mixture:
    """The exponent, weights and budgets.

    target_entropy (nats): weights no more even than this; the natural shares, if they are more even already, are sharpened.
    max_repeats: no budget is more than so many passes; ValueError if the budget (or a target entropy under the natural shares') asks for more. budget: tokens in all; None: the least with which each source
    gets min_passes passes (at least 1).
    """
    names, t = list(tokens), np.array(list(tokens.values()), dtype=float)
    live = t > 0

    def total(w: np.ndarray) -> float:
        return float(budget) if budget is not None else float(max(min_passes, 1) * (t[live] / w[live]).max()) if live.any() else 0.0

    def repeats(x: float) -> float:
        w = weights(t, x)
        return float((total(w) * w[live] / t[live]).max()) if live.any() else 0.0

    x = 0.0
    if target_entropy is not None:
        x = bisect(lambda e: entropy(weights(t, e)) <= target_entropy, 0.0, 64.0)
    if max_repeats is not None and x < 1:
        x = max(x, bisect(lambda e: repeats(e) <= max_repeats * (1 + 1e-12), 0.0, 1.0))
    if max_repeats is not None and repeats(x) > max_repeats * (1 + 1e-9):
        raise ValueError(f"no weights meet the limit: a source would be passed {repeats(x):.4g} times, more than {max_repeats:g}")
    w = weights(t, x)
    return Mixture(x, dict(zip(names, w.tolist(), strict=True)), dict(zip(names, (total(w) * w).tolist(), strict=True)))


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", tokens: Column | None = None, budget: float | None = None, target_entropy: float | None = None, entropy_gain: float | None = None, max_repeats: float | None = 4, min_passes: float = 0, seed: int = 1) -> DataFrame:
    """docs, a row for each pass that takes it, with n_tokens, weight, epoch, block, block_rank and at.

    entropy_gain: the target entropy as a share of the way from the natural shares' to the even one.
    """
    spark = docs.sparkSession
    n, weight, epoch, block, rank, at = (free_name(docs, c) for c in ("n_tokens", "weight", "epoch", "block", "block_rank", "at"))
    src, blk = free_name(docs, "_source"), free_name(docs, "_block")
    own = docs.withColumn(n, tokens if tokens is not None else words(text)).withColumn(src, F.coalesce(F.col(source).cast("string"), F.lit(NULL_SOURCE)))
    own = own.withColumn(blk, F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.lit(BLOCKS)).cast("int"))
    with Scratch(spark) as s:
        blocks = s.staged(own.groupBy(F.col(src).alias("source"), F.col(blk).alias("block")).agg(F.sum(n).alias("tokens")), "blocks")
        totals = {r[0]: int(r[1]) for r in blocks.groupBy("source").agg(F.sum("tokens")).limit(MOST_SOURCES + 1).collect()}
        if len(totals) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        if entropy_gain is not None and totals:
            t = np.array(list(totals.values()), dtype=float)
            natural = entropy(weights(t, 1.0))
            target_entropy = natural + entropy_gain * (math.log(max((t > 0).sum(), 1)) - natural)
        m = fit(totals, sum(totals.values()) if budget is None and not min_passes else budget, target_entropy, max_repeats, min_passes)
        rows = [(s_, t, m.weights[s_], m.budgets[s_]) if t else (s_, 1, 0.0, 1.0 if min_passes >= 1 else 0.0) for s_, t in totals.items()]
        plan = staged(permuted(blocks, spark.createDataFrame(rows, "source string, total long, weight double, budget double"), seed), "mixing-plan")
    # the largest sources meet their blocks by broadcast, so that no key is hot; the plan of the rest may be of any length
    large, left = [], BROADCAST_ROWS
    for s_, t, _, b in sorted(rows, key=lambda r: (-r[1], r[0])):
        left -= BLOCKS * (int(b / t + 1e-9) + 1)
        if left < 0:
            break
        large.append(s_)
    def passed(part: DataFrame, plan: DataFrame) -> DataFrame:
        o, p = part.alias("o"), plan.alias("p")
        both = o.join(p, [F.col("p.source") == F.col(f"o.{src}"), F.col("p.block") == F.col(f"o.{blk}")])
        return both.select(*[F.col(f"o.`{c}`") for c in docs.columns], F.col(f"o.{n}"), F.col("p.weight").alias(weight), F.col("p.epoch").alias(epoch), F.col("p.block").alias(block), F.col("p.rank").alias(rank), F.col("p.at").alias(at))

    if len(large) == len(rows):
        return passed(own, F.broadcast(plan))
    is_large = F.col(src).isin(large)
    return passed(own.where(is_large), F.broadcast(plan.where(F.col("source").isin(large)))).union(passed(own.where(~is_large), plan.where(~F.col("source").isin(large)).hint("merge")))


def permuted(blocks: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """source, block, epoch, weight, rank and at: in every pass over a source its blocks in an order of their own, up to the budget."""
    each = Window.partitionBy("source", "epoch").orderBy("order", "block")  # BLOCKS rows at most
    return (
        blocks.join(F.broadcast(sources), "source")
        .withColumn("passes", F.floor(F.col("budget") / F.col("total") + 1e-9).cast("int"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes"))))
        .withColumn("order", F.xxhash64(F.lit(seed + 1), "source", "epoch", "block"))
        .withColumn("rank", F.row_number().over(each) - 1)
        .withColumn("before", F.sum("tokens").over(each.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
        .where((F.col("epoch") < F.col("passes")) | (F.col("before") + F.col("tokens") / 2 < F.col("budget") - F.col("passes") * F.col("total")))
        .select("source", "block", "epoch", "weight", "rank", ((F.col("epoch") * F.col("total") + F.col("before")) / F.col("budget")).alias("at"))
    )
