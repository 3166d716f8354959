"""Paired statistics: bootstrap intervals by seeded hashes, exact McNemar, percentiles."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspark.operators.exchange import grouped_rank, settled, skew_join


def bootstrap_sums(pairs: DataFrame, samples: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """resample, total, n (of each group in ``by``): Poisson bootstrap of the differences (column delta) of all rows.

    Each row enters a resample as often as a Poisson draw of mean one, drawn from a hash of
    row and resample; so resamples need no row numbers and their sums combine map-side.
    """
    sampled = pairs.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = (F.pmod(F.xxhash64("id", "resample", F.lit(seed)), F.lit(2**31)) + 0.5) / 2**31
    times, below, p = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, 13):  # inverse of the Poisson distribution: beyond twelve, one draw in a thousand million
        below += p
        times = times + F.when(u > below, 1).otherwise(0)
        p /= k
    drawn = sampled.withColumn("times", times)
    return drawn.groupBy(*by, "resample").agg(F.sum(F.col("delta") * F.col("times")).alias("total"), F.sum("times").alias("n"))


def bootstrap_interval(pairs: DataFrame, samples: int = 10_000, seed: int = 20260803, confidence: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """mean, low, high, p (two-sided) of the paired differences ``delta`` (rows id, delta), of each group in ``by`` or in one row.

    Percentiles are of ``samples`` means a group, whatever the number of rows.
    """
    means = bootstrap_sums(pairs, samples, seed, by).where("n > 0").select(*by, (F.col("total") / F.col("n")).alias("m"))
    tail = (1 - confidence) / 2
    share = F.least(F.avg((F.col("m") <= 0).cast("int")), F.avg((F.col("m") >= 0).cast("int")))
    stats = means.groupBy(*by).agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"), F.least(F.lit(1.0), 2 * share).alias("p"))
    mean = pairs.groupBy(*by).agg(F.avg("delta").alias("mean"))
    return mean.join(stats, [*by]) if by else mean.crossJoin(F.broadcast(stats))  # one row each


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, tuple[float, str]]) -> DataFrame:
    """Quantiles of ``value`` in each group, of (share, "nearest" or "linear") by name, however many values a group has.

    "nearest" is the smallest value with that share of the rows at or below it, "linear"
    lies between the two values around the place share * (n - 1).
    """
    held = df.select(*by, F.col(value).cast("double").alias("_value")).where(F.col("_value").isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    ranked = grouped_rank(settled(held), by, [F.col("_value"), F.col("_row")], "_rank")
    sizes = settled(ranked.groupBy(*by).agg(F.max("_rank").alias("_n")))
    at = lambda share, kind: F.greatest(F.lit(1), F.ceil(share * F.col("_n"))) if kind == "nearest" else share * (F.col("_n") - 1) + 1
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(*x)).cast("long"), F.ceil(at(*x)).cast("long")) for x in shares.values()])))
    # A few ranks of each group.
    picked = skew_join(ranked.drop("_row"), sizes.select(*by, "_n", F.explode(wanted).alias("_rank")), [*by, "_rank"], "inner")
    value_at = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col("_value")))

    def quantile(share: float, kind: str) -> Column:
        place = at(share, kind)
        low, high = value_at(F.floor(place).cast("long")), value_at(F.ceil(place).cast("long"))
        return low + (high - low) * F.max(place - F.floor(place))

    return picked.groupBy(*by).agg(*[quantile(*x).alias(name) for name, x in shares.items()])


@F.pandas_udf(DoubleType())
def mcnemar_p(only_left: pd.Series, only_right: pd.Series) -> pd.Series:
    """The exact two-sided p-value of discordant counts: a binomial tail.

    Its terms are summed from the largest down, each from the one before, until they no
    longer tell: a few times the root of the counts, not all of them.
    """

    def p(a: int, b: int) -> float:
        n, k = int(a + b), int(min(a, b))
        if not n:
            return 1.0
        term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
        total = 0.0
        while k >= 0 and term > total * 1e-17:
            total += term
            term, k = term * k / (n - k + 1), k - 1
        return min(1.0, 2 * total)

    return pd.Series([p(a, b) for a, b in zip(only_left, only_right, strict=True)])
