"""Queries of statistics (STA)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import resampling as R
from quillspark.operators import statistics as S
from quillspark.plans.declare import Table, query


def _pairs(table: Table) -> DataFrame:
    e = table("events").select("event_id", "event_type", "value")
    right = e.select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("after"))
    return e.where("event_id % 2 = 0").join(right, "event_id").select(F.col("event_id").alias("id"), "event_type", "value", "after", (F.col("after") - F.col("value")).alias("delta"))


@query()
def sta01_sta02_sta03_paired_bootstrap(table: Table) -> DataFrame:
    return S.bootstrap_interval(_pairs(table).select("id", "delta"), samples=1000)


@query()
def sta06_bootstrap_of_each(table: Table) -> DataFrame:
    return S.bootstrap_interval(_pairs(table).select("id", "event_type", "delta"), samples=1000, by=("event_type",))


@query(
    """SELECT a.event_type, count(*) FILTER (WHERE a.value > 50 AND b.value <= 50) AS only_left, count(*) FILTER (WHERE a.value <= 50 AND b.value > 50) AS only_right FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0 GROUP BY 1"""
)
def sta04_discordant_counts(table: Table) -> DataFrame:
    left, right = F.col("value") > 50, F.col("after") > 50
    return _pairs(table).groupBy("event_type").agg(F.count_if(left & ~right).alias("only_left"), F.count_if(~left & right).alias("only_right"))


@query(
    """WITH c AS (SELECT a.event_type, count(*) FILTER (WHERE a.value > 50 AND b.value <= 50) AS x, count(*) FILTER (WHERE a.value <= 50 AND b.value > 50) AS y FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0 GROUP BY 1),
       t AS (SELECT event_type, x, y, x + y AS n, unnest(range(0, least(x, y) + 1)) AS k FROM c),
       s AS (SELECT event_type, x, y, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) AS p FROM t GROUP BY ALL)
       SELECT event_type, x AS only_left, y AS only_right, round(least(1.0, p), 6) AS p FROM s"""
)
def sta04_mcnemar(table: Table) -> DataFrame:
    return sta04_discordant_counts(table).withColumn("p", F.round(S.mcnemar_p("only_left", "only_right"), 6))


@query()
def sta01_sta02_sta03_bootstrap_rules(table: Table) -> DataFrame:
    """Resamples of exactly n rows, and the interval that each of three rules makes of them."""
    return R.bootstrap_rules(_pairs(table).select("delta"), samples=2000)


@query(
    """WITH d AS (SELECT a.event_type, b.value - a.value AS delta FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0)
       SELECT event_type, count(*) AS n, round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.5), 6) AS median, count(*) FILTER (delta > 0) AS rescue, count(*) FILTER (delta < 0) AS harm, count(*) FILTER (delta = 0) AS tie FROM d GROUP BY event_type"""
)
def sta03_difference_counts(table: Table) -> DataFrame:
    found = R.difference_counts(_pairs(table), ("event_type",))
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "median")})


@query("SELECT event_type, (SELECT count(*) FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0 AND a.event_type = e.event_type) AS n, resample FROM (SELECT DISTINCT event_type FROM events WHERE event_id % 2 = 0 AND event_id + 1 IN (SELECT event_id FROM events)) e, range(0, 50) r(resample)")
def sta01_resample_sizes(table: Table) -> DataFrame:
    """Every resample has as many rows as its group: differences of one sum to their number."""
    ones = R.resampled_sums(_pairs(table).withColumn("delta", F.lit(1.0)), 50, by=("event_type",))
    return ones.select("event_type", F.col("total").cast("long").alias("n"), F.col("resample").cast("long").alias("resample"))
