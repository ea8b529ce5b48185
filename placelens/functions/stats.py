"""Closed forms of what a random ranking of n places with g relevant ones scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_hit(n: Column, g: Column, k: Column) -> Column:
    """1 - prod over i < k of (n - g - i) / (n - i)."""
    steps = F.sequence(F.lit(0), k.cast("int") - 1)
    miss = F.aggregate(steps, F.lit(1.0), lambda m, i: m * (n - g - i) / (n - i))
    return F.when((g <= 0) | (k <= 0) | (n <= 0), 0.0).when((k >= n) | (k > n - g), 1.0).otherwise(1 - miss)


def random_recall(n: Column, g: Column, k: Column) -> Column:
    return F.when(g <= 0, 0.0).otherwise(F.least(k, n) / n)


def random_mrr(n: Column, g: Column) -> Column:
    """Sum over k of P(first hit at k) / k; P follows p(k + 1) = p(k) * (n - k - g + 1) / (n - k)."""
    start = F.struct(F.lit(0.0).alias("s"), (g / n).cast("double").alias("p"))
    step = lambda a, k: F.struct((a["s"] + a["p"] / k).alias("s"), F.when(k < n, a["p"] * (n - k - g + 1) / (n - k)).otherwise(0.0).cast("double").alias("p"))
    last = F.greatest((n - g + 1).cast("int"), F.lit(1))
    return F.when((g <= 0) | (n <= 0), 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["s"]))
