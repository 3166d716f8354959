"""Queries of what texts say in numbers, and whether two of them agree (NUM03 to NUM06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import equivalence as Q
from quillspark.plans.declare import Table, query


def _said(table: Table) -> DataFrame:
    """A time, a range and a sum of money for each event, written in several ways."""
    i = F.col("event_id")
    hour, minute = (i % 12 + 1), i % 60
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    time = F.when(i % 4 == 0, F.concat(F.lit("at "), hour.cast("string"), F.lit(":"), pad(minute), F.lit(" p.m."))).when(i % 4 == 1, F.concat(hour.cast("string"), F.lit(" AM"))).when(i % 4 == 2, F.concat(F.lit("about "), pad(i % 24), F.lit(":"), pad(minute))).otherwise("no time")
    low = i % 90 + 10
    span = F.when(i % 3 == 0, F.concat(low.cast("string"), F.lit(" - "), (low + 5).cast("string"), F.lit(" km"))).when(i % 3 == 1, F.concat(F.lit("from "), low.cast("string"), F.lit(" to "), (low + 7).cast("string"))).otherwise(F.concat(F.lit("only "), low.cast("string")))
    money = F.when(i % 3 == 0, F.concat(F.lit("$"), F.format_number(i + 1000, 0))).when(i % 3 == 1, F.concat((i + 1).cast("string"), F.lit(" euros"))).otherwise(F.concat(F.lit("£"), (i + 2).cast("string"), F.lit(" million")))
    return table("events").select("event_id", time.alias("time"), span.alias("span"), money.alias("money"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN ((event_id % 12 + 1) % 12 + 12) * 60 + event_id % 60 WHEN 1 THEN (event_id % 12 + 1) % 12 * 60 WHEN 2 THEN event_id % 24 * 60 + event_id % 60 END::INTEGER AS clock,
              CASE WHEN event_id % 3 < 2 THEN event_id % 90 + 10 END::DOUBLE AS low, CASE event_id % 3 WHEN 0 THEN event_id % 90 + 15 WHEN 1 THEN event_id % 90 + 17 END::DOUBLE AS high,
              CASE event_id % 3 WHEN 0 THEN event_id + 1000 WHEN 1 THEN event_id + 1 ELSE (event_id + 2) * 1000000 END::DOUBLE AS amount, event_id % 3 AS currency FROM events"""
)
def num04_num05_num06_numbers_said(table: Table) -> DataFrame:
    """Minutes of the day, ends of a range and sums of money of texts; currencies are numbered by which texts share one."""
    read = _said(table).select("event_id", Q.read(F.col("time")).alias("t"), Q.read(F.col("span")).alias("s"), Q.read(F.col("money")).alias("m"))
    names = {c: F.lit(k) for k, texts in enumerate((("$1",), ("1 euro",), ("£1",))) for c in [Q.reading(texts[0])["currency"]]}
    currency = F.coalesce(*[F.when(F.col("m.currency") == c, n) for c, n in names.items()])
    return read.select("event_id", F.col("t.clock").alias("clock"), F.col("s.low").alias("low"), F.col("s.high").alias("high"), F.col("m.amount").alias("amount"), currency.cast("long").alias("currency"))


@query(
    """WITH p AS (SELECT event_id, event_id % 6 AS k FROM events)
       SELECT event_id, k IN (0, 4) AS numeric, k IN (1, 2) AS unit FROM p"""
)
def num03_quantity_agreement(table: Table) -> DataFrame:
    """Texts that say one quantity in two ways, or nearly: times, ranges, money, units within a hundredth, bare numbers exactly."""
    i = F.col("event_id")
    n = i % 50 + 10
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    left = F.when(i % 6 == 0, text("3:15 pm")).when(i % 6 == 1, text(n, " km")).when(i % 6 == 2, text("$", n * 100)).when(i % 6 == 3, text(n, " km")).when(i % 6 == 4, text(n)).otherwise(text(n, " to ", n + 4))
    right = F.when(i % 6 == 0, text("at 15:15")).when(i % 6 == 1, text(n * 1000, " meters")).when(i % 6 == 2, text(n * 100, " dollars")).when(i % 6 == 3, text(n * 2, " km")).when(i % 6 == 4, text("it is ", n)).otherwise(text(n, " to ", n + 9))
    question = F.when(i % 6 == 0, "what time is it").otherwise("how many are there")
    both = table("events").select("event_id", question.alias("q"), Q.read(left).alias("a"), Q.read(right).alias("b"))
    verdict = Q.agreement(F.col("a"), F.col("b"), F.col("q"))
    return both.select("event_id", verdict.alias("v")).select("event_id", F.coalesce("v.numeric", F.lit(False)).alias("numeric"), F.coalesce("v.unit", F.lit(False)).alias("unit"))
