"""Metrics: confusion and agreement, percentiles of three conventions, advantages and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, empty: float | None = None) -> Column:
    """A share; of nothing it is null, or ``empty``."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def decisions(df: DataFrame, said: Column, true: Column, by: list[str] | None = None) -> DataFrame:
    """Counts of a binary decision and its precision, recall and F1 (0 where undefined)."""
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn")
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def class_scores(df: DataFrame, true: str, said: str, labels: list[str]) -> DataFrame:
    """label, targets, predicted, hits, precision, recall, f1 for each declared label, zero rows kept."""
    listed = F.array(*map(F.lit, labels))
    either = df.select(F.explode(F.array_distinct(F.array(true, said))).alias("label"), true, said).where(F.array_contains(listed, F.col("label")))
    counts = either.groupBy("label").agg(
        F.count_if(F.col(true) == F.col("label")).alias("targets"), F.count_if(F.col(said) == F.col("label")).alias("predicted"),
        F.count_if((F.col(true) == F.col("label")) & (F.col(said) == F.col("label"))).alias("hits"),
    )
    every = df.sparkSession.createDataFrame([(x,) for x in labels], "label string").join(counts, "label", "left").fillna(0)
    p, r = ratio(F.col("hits"), F.col("predicted"), 0.0), ratio(F.col("hits"), F.col("targets"), 0.0)
    return every.withColumn("precision", p).withColumn("recall", r).withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def macro_f1(scores: DataFrame, only_targets: bool) -> DataFrame:
    """The mean F1 of all labels, or of those that occur as targets."""
    return scores.where("targets > 0" if only_targets else "true").agg(F.avg("f1").alias("macro_f1"))


def entropy(counts: DataFrame, n: str = "n") -> DataFrame:
    """Shannon entropy in bits of a table of counts, how many there are and the largest share; one row."""
    sums = counts.agg(F.sum(n).alias("total"), F.sum(F.col(n) * F.log2(n)).alias("nlogn"), F.max(n).alias("most"), F.count(F.lit(1)).alias("distinct"))
    # H = log2(total) - sum(n log2 n) / total: sums alone, no window over all rows.
    return sums.select(F.col("distinct"), (F.log2("total") - F.col("nlogn") / F.col("total")).alias("entropy"), (F.col("most") / F.col("total")).alias("largest"))


def group_advantage(value: str, group: str, epsilon: float = 1e-6, least: float = 1e-12) -> Column:
    """(value - mean) / (population deviation + epsilon) within the group; 0 in a group of one or without spread."""
    w = Window.partitionBy(group)
    spread = F.stddev_pop(value).over(w)
    return F.when((F.count(F.lit(1)).over(w) < 2) | (spread <= least), 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / (spread + epsilon))


def transitions(df: DataFrame, left: str, right: str, labels: list[str]) -> DataFrame:
    """How often each declared label of ``left`` becomes each of ``right``; a column for each, zeros filled."""
    return df.groupBy(left).pivot(right, labels).count().fillna(0)


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def prediction_table(df: DataFrame, transition: str, said: Column, labels: list[str]) -> DataFrame:
    """transition, targets, and how often each label was predicted, "invalid" for what is none of them."""
    named = df.select(F.col(transition).alias("transition"), F.when(said.isin(*labels), said).otherwise("invalid").alias("_said"))
    return named.groupBy("transition").agg(F.count(F.lit(1)).alias("targets"), *[F.count_if(F.col("_said") == x).alias(x) for x in [*labels, "invalid"]])


def failure_examples(df: DataFrame, transition: str, order: str, failed: Column, limits: dict[str, int | None]) -> DataFrame:
    """The rows that failed, for the transitions in ``limits``: the first so many of each, or all of them (None).

    Spark keeps so many rows of a transition in each task before the exchange.
    """
    wrong = df.where(F.col(transition).isin(*limits)).where(failed)
    bounded = {k: n for k, n in limits.items() if n is not None}
    most = F.coalesce(*[F.when(F.col(transition) == k, F.lit(n)) for k, n in bounded.items()]) if bounded else F.lit(0)
    ranked = wrong.where(F.col(transition).isin(*bounded)).withColumn("_nth", F.row_number().over(Window.partitionBy(transition).orderBy(order))).where(F.col("_nth") <= max([0, *bounded.values()]))
    return ranked.where(F.col("_nth") <= most).drop("_nth").unionByName(wrong.where(~F.col(transition).isin(*bounded)))
