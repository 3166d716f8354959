"""Bootstrap of exactly n of n rows: multinomial counts by conditional splits.

Equal differences are one value with a count.  A group's values are dealt into buckets; how
many of a resample's n rows each bucket gets is drawn level by level, a node's count split
among its children by their shares, and at last among a bucket's values.  So every resample
has exactly n rows, without n rows for each resample, and a draw depends on its node and the seed alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.exchange import settled, skew_join
from quillspark.operators.statistics import exact_quantiles

BUCKET_VALUES = 4096  # values of a bucket, on average at most
FANOUT_BITS = 6
CELLS = 1_000_000  # counts drawn at once


def _draws(counts: np.ndarray, weights: np.ndarray, seed: int, node: int) -> Iterator[np.ndarray]:
    """For each of ``counts``, some at a time, how many of them fall on each of ``weights``."""
    random, shares = np.random.default_rng([seed, node & (2**64 - 1)]), weights / weights.sum()
    step = max(1, CELLS // len(weights))
    for at in range(0, len(counts), step):
        yield random.multinomial(counts[at : at + step], shares)


def _splitting(seed: int):
    """Rows (node, held, children: struct<child, n>) to rows (child, held): the counts of each child."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, held, children in zip(*(batch.column(c) for c in ("node", "held", "children")), strict=True):
                parts = sorted(((c["child"], c["n"]) for c in children.as_py()))
                drawn = np.concatenate(list(_draws(held.values.to_numpy(zero_copy_only=False), np.array([n for _, n in parts], float), seed, node.as_py())))
                counts = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * len(drawn), pa.int32()), pa.array(np.ascontiguousarray(drawn.T).ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in parts], pa.int64()), counts], ["child", "held"])

    return split


def _summing(seed: int):
    """Rows (node, g, held, children: struct<delta, n>) to rows (g, totals): the sum of each resample's values."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, g, held, children in zip(*(batch.column(c) for c in ("node", "g", "held", "children")), strict=True):
                parts = sorted((c["delta"], c["n"]) for c in children.as_py())
                values, weights = np.array([d for d, _ in parts]), np.array([n for _, n in parts], float)
                sums = np.concatenate([x @ values for x in _draws(held.values.to_numpy(zero_copy_only=False), weights, seed, node.as_py())])
                yield pa.RecordBatch.from_arrays([pa.array([g.as_py()], pa.int64()), pa.ListArray.from_arrays([0, len(sums)], pa.array(sums))], ["g", "totals"])

    return total


def resampled_sums(pairs: DataFrame, samples: int = 10_000, seed: int = 20260803, by: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``by``, resample (from 0), total and n of ``samples`` resamples of the differences ``delta`` of each group; null differences are left out."""
    group = F.xxhash64(F.lit(seed), *by)
    values = pairs.where(F.col("delta").isNotNull()).groupBy(*by, F.col("delta").cast("double").alias("delta")).agg(F.count(F.lit(1)).alias("n"))
    values = settled(values.withColumn("_group", group).withColumn("_hash", F.xxhash64("_group", "delta")))
    names = settled(values.groupBy("_group", *by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")))
    most = names.agg(F.max("distinct")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1, most / BUCKET_VALUES)) / FANOUT_BITS))

    def node(level: int) -> Column:
        """The bucket of a value at a level: its group and the first bits of its hash."""
        return F.xxhash64(F.lit(level), "_group", F.shiftrightunsigned("_hash", 64 - FANOUT_BITS * level) if level else F.lit(0).cast("long"))

    nodes = values.drop(*by).withColumns({f"node{k}": node(k) for k in range(levels + 1)})
    held = names.select("_group", F.array_repeat("n", samples).alias("held"))
    held = skew_join(nodes.select("_group", "node0").distinct(), held, ["_group"], "inner").select(F.col("node0").alias("node"), "held")
    for k in range(levels):
        children = nodes.groupBy(F.col(f"node{k}").alias("node"), F.col(f"node{k + 1}").alias("child")).agg(F.sum("n").alias("n"))
        lists = children.groupBy("node").agg(F.collect_list(F.struct("child", "n")).alias("children"))  # 64 at most
        held = skew_join(held, lists, ["node"], "inner").select("node", "held", "children").mapInArrow(_splitting(seed), "child long, held array<long>")
        held = settled(held.withColumnRenamed("child", "node"))
    lists = nodes.groupBy(F.col("_group").alias("g"), F.col(f"node{levels}").alias("node")).agg(F.collect_list(F.struct("delta", "n")).alias("children"))
    sums = skew_join(lists, held, ["node"], "inner").select("node", "g", "held", "children").mapInArrow(_summing(seed), "g long, totals array<double>")
    each = sums.select("g", F.posexplode("totals").alias("resample", "total")).groupBy("g", "resample").agg(F.sum("total").alias("total"))
    return skew_join(each.withColumnRenamed("g", "_group"), names.drop("distinct"), ["_group"], "inner").select(*by, "resample", "total", "n")


def bootstrap_rules(pairs: DataFrame, samples: int = 10_000, seed: int = 20260803, by: tuple[str, ...] = (), confidence: float = 0.95) -> DataFrame:
    """A row for each group (or one): n, mean, median, rescue, harm, tie, and what three rules make of the same resamples.

    ``pairs`` has delta.  low and high lie between the sorted means at linear places, with a
    two-sided p and whether the interval leaves out 0; low_index is the mean number
    int(tail * samples) from 0 and high_before the one before int((1 - tail) * samples);
    high_index is that one itself.  Rescue, harm and tie count differences above, below and at 0.
    """
    means = resampled_sums(pairs, samples, seed, by).groupBy(*by).agg(F.sort_array(F.collect_list(F.col("total") / F.col("n"))).alias("m"))  # ``samples`` of each group
    tail = (1 - confidence) / 2

    def linear(share: float) -> Column:
        place = share * (samples - 1)
        low = F.get("m", F.lit(math.floor(place)))
        return low + (F.get("m", F.lit(math.ceil(place))) - low) * (place - math.floor(place))

    below, above = (F.size(F.filter("m", f)) / samples for f in (lambda x: x <= 0, lambda x: x >= 0))
    told = means.select(
        *by, linear(tail).alias("low"), linear(1 - tail).alias("high"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p"), F.get("m", F.lit(int(tail * samples))).alias("low_index"),
        F.get("m", F.lit(int((1 - tail) * samples) - 1)).alias("high_before"), F.get("m", F.lit(min(samples - 1, int((1 - tail) * samples)))).alias("high_index"),
    ).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))
    counts = difference_counts(pairs, by)
    return reduce(lambda a, b: a.join(b, [*by]) if by else a.crossJoin(F.broadcast(b)), [told], counts)  # one row each


def difference_counts(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, median, rescue, harm, tie of the differences ``delta`` of each group, or in one row."""
    known = pairs.where(F.col("delta").isNotNull())
    one = known if by else known.withColumn("_all", F.lit(1))
    keys = list(by) or ["_all"]
    counts = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"), *[F.count_if(c).alias(n) for n, c in (("rescue", F.col("delta") > 0), ("harm", F.col("delta") < 0), ("tie", F.col("delta") == 0))])
    median = exact_quantiles(one, keys, "delta", {"median": (0.5, "linear")})
    return skew_join(counts, median, keys, "inner").drop("_all")
