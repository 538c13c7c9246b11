"""Interval, test and agreement statistics as column expressions over counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """struct(low, high); (0, 0) for no trials."""
    if confidence != 0.95:
        raise ValueError("only the 95 % interval is supported")
    p, m = F.try_divide(k.cast("double"), n), n.cast("double")
    scale = 1 + F.try_divide(F.lit(Z95 * Z95), m)
    mid = F.try_divide(p + F.try_divide(F.lit(Z95 * Z95), 2 * m), scale)
    half = F.try_divide(Z95 * F.sqrt(F.try_divide(p * (1 - p), m) + F.try_divide(F.lit(Z95 * Z95), 4 * m * m)), scale)
    some = n > 0
    return F.struct(
        F.when(some, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0).alias("low"),
        F.when(some, F.least(F.lit(1.0), mid + half)).otherwise(0.0).alias("high"))


def rate(k: Column, n: Column) -> Column:
    """struct(count, total, rate, ci95)."""
    share = F.coalesce(F.try_divide(k.cast("double"), n), F.lit(0.0))
    return F.struct(k.cast("long").alias("count"), n.cast("long").alias("total"), share.alias("rate"), wilson(k, n).alias("ci95"))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b and c discordant pairs, summed in log space so that any count fits."""
    n, t = (b + c).cast("long"), F.least(b, c).cast("long")
    # log C(n, i) grows by log((n - i + 1) / i); terms are scaled by 2^-n
    step = lambda acc, i: F.struct(
        (acc["term"] + F.when(i == 0, F.lit(0.0)).otherwise(F.log((n - i + 1).cast("double")) - F.log(i.cast("double")))).alias("term"),
        (acc["sum"] + F.exp(acc["term"] + F.when(i == 0, F.lit(0.0)).otherwise(F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))))).alias("sum"))
    start = F.struct((-n.cast("double") * math.log(2.0)).alias("term"), F.lit(0.0).alias("sum"))
    folded = F.aggregate(F.sequence(F.lit(0).cast("long"), t), start, step, lambda acc: acc["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * folded))


def mcnemar_exact(b: int, c: int) -> float:
    """The same p to the last bit, from integers on the driver."""
    n = b + c
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0
