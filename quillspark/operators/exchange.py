"""What operators share: lineage cuts, skew-safe joins, ranks in large groups, connected components."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors see; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or a longer one where a column of ``frames`` has it (Spark tells no case apart)."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Null-safe equi-join on columns of equal names whose hot keys adaptive execution may split.

    Both sides are hashed on a derived key, so each gets an exchange of the join's own;
    an aggregate's partitioning is never reused, which would forbid the split.  Other
    columns of ``right`` must have names of their own (see ``unused``).
    """
    key, other = unused("_skew_key", left, right), unused("_skew_other", left, right)
    names = {c: unused(f"_right_{c}", left, right) for c in on}
    a = left.withColumn(key, F.xxhash64(*on))
    b = right.select(F.xxhash64(*on).alias(other), *[F.col(c).alias(names.get(c, c)) for c in right.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(names[c])) for c in on], F.col(key) == F.col(other))
    return a.join(b, same, how).drop(key, other, *names.values())  # (a semi or anti join keeps the left columns alone)


def grouped_rank(df: DataFrame, by: list[str], order: list[Column], into: str = "rank") -> DataFrame:
    """``df`` with the rank from 1 of each row among those equal in ``by``, however large such a group is.

    Rows are range-partitioned by group and order, and counted within each partition; a
    row's rank is its place there after all the group's rows in partitions before.  Rows
    that tie in ``order`` get ranks in any order: end it with a key.
    """
    part, nth, before, n = (unused(x, df) for x in ("_ranked_part", "_ranked_nth", "_ranked_before", "_ranked_n"))
    ranged = settled(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*by, part).agg(F.count(F.lit(1)).alias(n)).withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    placed = ranged.withColumn(nth, F.row_number().over(Window.partitionBy(*by, part).orderBy(*order)))
    return skew_join(placed, settled(starts), [*by, part], "inner").withColumn(into, F.col(before) + F.col(nth)).drop(part, nth, before)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (id, component): the smallest id reachable, for every id that has an edge.

    ``edges`` has long columns a and b; direction, repeats and loops do not matter.
    Alternating large-star and small-star rounds, each two aggregations and two
    skew-safe joins; a round's edges never outnumber twice the input's.  Hubs cost
    only map-side combined minima and split joins.
    """
    e = settled(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        nodes = e.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
            e.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
        )
        deep = nodes.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c = 1 and p = 1)")
        if deep.isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = skew_join(both, least, ["u"], "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, least, ["u"], "inner").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        )
        e = settled(small.select("x.*").where("u <> v").distinct())
    raise RuntimeError("components did not settle")
