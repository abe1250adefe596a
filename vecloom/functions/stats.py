"""Aggregates and window expressions: distributions, average ranks, correlations, agreement of partitions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(value: Column | str, prefix: str) -> list[Column]:
    """Six aggregates: exact, interpolated quartiles, the extremes and the mean."""
    v = F.col(value) if isinstance(value, str) else value
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.min(v).alias(f"{prefix}_min"), q[0].alias(f"{prefix}_q25"), q[1].alias(f"{prefix}_median"), q[2].alias(f"{prefix}_q75"), F.max(v).alias(f"{prefix}_max"), F.avg(v).alias(f"{prefix}_mean")]


def average_rank(value: str, *keys: str) -> Column:
    """Ranks from 1, equal values sharing the mean of theirs."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def spearman(rows: DataFrame, x: str, y: str, *keys: str, name: str = "rho") -> DataFrame:
    """One row a group: the correlation of average ranks; NULL where a side is constant."""
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", average_rank(x, *keys)).withColumn("_y", average_rank(y, *keys))
    constant = (F.min("_x") == F.max("_x")) | (F.min("_y") == F.max("_y"))
    rho = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))  # corr fails on a constant side
    agg = F.when(~constant, rho).alias(name)
    return ranked.groupBy(*keys).agg(agg) if keys else ranked.agg(agg)


def contingency(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def pair_count(n: Column) -> Column:
    return n * (n - 1) / 2.0


def adjusted_rand(table: DataFrame, *keys: str) -> DataFrame:
    """(keys, ari) from contingency counts: the closed form over pairs."""
    cells = table.groupBy(*keys).agg(F.sum(pair_count(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    left = table.groupBy(*keys, "a").agg(F.sum("n").alias("m")).groupBy(*keys).agg(F.sum(pair_count(F.col("m"))).alias("pa"))
    right = table.groupBy(*keys, "b").agg(F.sum("n").alias("m")).groupBy(*keys).agg(F.sum(pair_count(F.col("m"))).alias("pb"))
    j = cells.join(left, list(keys)).join(right, list(keys)) if keys else cells.crossJoin(left).crossJoin(right)
    expected, top = F.col("pa") * F.col("pb") / pair_count(F.col("n")), (F.col("pa") + F.col("pb")) / 2
    return j.select(*keys, F.when(top == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"))


def purity(table: DataFrame, *keys: str) -> DataFrame:
    """(keys, purity): the share of rows in the largest b of their a."""
    most = table.groupBy(*keys, "a").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return most.groupBy(*keys).agg((F.sum("m") / F.sum("n")).alias("purity"))


def adjusted_mutual_information(counts: np.ndarray) -> float:
    """AMI of a small contingency matrix, normalised by the mean entropy."""
    counts = np.asarray(counts, float)
    n, a, b = counts.sum(), counts.sum(1), counts.sum(0)
    if len(a) == len(b) == 1 or n == 0:
        return 1.0
    lg = math.lgamma
    nz = counts > 0
    mi = float((counts[nz] / n * np.log(counts[nz] * n / np.outer(a, b)[nz])).sum())
    entropy = [-(x[x > 0] / n * np.log(x[x > 0] / n)).sum() for x in (a, b)]
    expected = 0.0
    for x in a:
        for y in b:
            for k in range(int(max(1, x + y - n)), int(min(x, y)) + 1):
                p = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)
                expected += k / n * math.log(n * k / (x * y)) * math.exp(p)
    top = sum(entropy) / 2 - expected
    return float((mi - expected) / (top if abs(top) > 1e-15 else math.copysign(1e-15, top)))


def null_nan(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)
