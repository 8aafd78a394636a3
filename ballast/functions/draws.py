"""Stateless random draws.

A draw is a hash of (seed, purpose, keys).  The same keys give the same draw on every executor,
in every retry and under every partitioning, and any SQL engine with md5 can repeat it.
Give every use its own ``purpose``.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits are 52 bits, the widest integer draw a double holds exactly.
HEX_DIGITS = 13
DRAW_RANGE = 4503599627370496.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniform(purpose: str, *keys, seed: int = 42) -> Column:
    """A double in [0, 1) decided by the keys alone."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(DRAW_RANGE)


def pick(purpose: str, n, *keys, seed: int = 42) -> Column:
    """A whole number in 1..n, each equally likely."""
    n = n if isinstance(n, Column) else F.lit(n)
    return (F.floor(uniform(purpose, *keys, seed=seed) * n.cast("double")) + 1).cast("long")


def normal(purpose: str, *keys, seed: int = 42) -> Column:
    """A standard normal value by the Box-Muller map of two uniform draws."""
    u1 = uniform(purpose + ".r", *keys, seed=seed) + F.lit(0.5 / DRAW_RANGE)
    u2 = uniform(purpose + ".a", *keys, seed=seed)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is mentioned.

    The name is bound inside one expression, so neither a pushed-down filter nor a collapsed
    projection can copy it.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def choose_by_weight(draw: Column, weights: list[float] | Column) -> Column:
    """Zero-based index whose cumulative weight first exceeds ``draw`` times the total."""
    if not isinstance(weights, Column) and len(weights) > 64:
        weights = F.array(*[F.lit(float(w)) for w in weights])  # a short plan for a long list
    if not isinstance(weights, Column):
        total, run, passed = math.fsum(weights), 0.0, F.lit(0)
        for w in weights[:-1]:
            run += w
            passed = passed + F.when(draw * F.lit(total) >= F.lit(run), 1).otherwise(0)
        return passed.cast("int")
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"))

    def index(b: Column) -> Column:
        step = lambda a, x: F.struct((a["s"] + x).alias("s"),
                                     F.when(a["s"] + x <= b["goal"], a["i"] + 1).otherwise(a["i"]).alias("i"))
        return F.least(F.aggregate(b["w"], start, step)["i"], F.size(b["w"]) - 1).cast("int")

    return let(weights, lambda w: let(F.struct(w.alias("w"), (draw * total(w)).alias("goal")), index))
