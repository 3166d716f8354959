"""Queries of window operators and reward analytics (WIN, RWD, ARR)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillspark.operators import metrics as K
from quillspark.plans.declare import Table, query

SQL_USER = "PARTITION BY user_id ORDER BY ts, event_id"


def by_user() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("""SELECT event_id, round(CASE WHEN count(*) OVER w < 2 OR stddev_pop(value) OVER w <= 1e-12 THEN 0.0 ELSE (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6) END, 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)""")
def win01_group_advantage(table: Table) -> DataFrame:
    return table("events").select("event_id", F.round(K.group_advantage("value", "user_id"), 6).alias("advantage"))


@query(
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'R' THEN greatest(l_quantity - 25, 0) WHEN count(*) OVER w < 2 OR stddev_pop(l_quantity) OVER w <= 1e-12 THEN 0.0
              ELSE (l_quantity - avg(l_quantity) OVER w) / (stddev_pop(l_quantity) OVER w + 1e-6) END, 6) AS local FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_returnflag)"""
)
def win02_win03_local_advantage(table: Table) -> DataFrame:
    lines = table("lineitem").withColumn("g", F.concat_ws(":", "l_orderkey", "l_returnflag"))
    text = F.greatest(F.col("l_quantity") - 25, F.lit(0.0))
    return lines.select("l_orderkey", "l_linenumber", F.round(F.when(F.col("l_returnflag") == "R", text).otherwise(K.group_advantage("l_quantity", "g")), 6).alias("local"))


@query(f"SELECT event_id, event_type = 'view' AND lead(event_type) OVER ({SQL_USER}) = 'click' AS view_to_click, count(*) OVER (PARTITION BY user_id, lower(event_type), json_extract_string(props, '$.k')) > 1 AS repeated FROM events")
def win05_win18_adjacency(table: Table) -> DataFrame:
    again = F.count("*").over(Window.partitionBy("user_id", F.lower("event_type"), F.get_json_object("props", "$.k"))) > 1
    return table("events").select("event_id", ((F.col("event_type") == "view") & (F.lead("event_type").over(by_user()) == "click")).alias("view_to_click"), again.alias("repeated"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) FILTER (WHERE value > 80) AS first_hit FROM events GROUP BY user_id")
def win06_first_hit(table: Table) -> DataFrame:
    hit = F.when(F.col("value") > 80, F.struct("ts", "event_id"))
    return table("events").groupBy("user_id").agg(F.min(hit)["event_id"].alias("first_hit"))


@query("SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS chars_so_far, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM conversations")
def win07_win09_running_context(table: Table) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.collect_list("role").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return table("conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("chars_so_far"), F.array_join(before, ",").alias("before"))


@query(f"SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER ({SQL_USER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_purchase FROM events")
def win08_look_ahead(table: Table) -> DataFrame:
    ahead = by_user().rowsBetween(1, Window.unboundedFollowing)
    return table("events").select("event_id", F.first(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(ahead).alias("next_purchase"))


@query(f"SELECT event_id, value < 30 AND coalesce(lag(value) OVER ({SQL_USER}) < 30, false) AS stop FROM events")
def win10_two_bad_in_a_row(table: Table) -> DataFrame:
    return table("events").select("event_id", ((F.col("value") < 30) & F.coalesce(F.lag("value").over(by_user()) < 30, F.lit(False))).alias("stop"))


@query(
    """SELECT event_id, round(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 * value / 100 ELSE -0.1 END, 9) AS v0,
              round(least(greatest(0.7 * value / 100 + 0.3 * (event_id % 10) / 10.0 - 0.2, -1), 1), 9) AS v2, round(0.8 * value / 100 + 0.2 * (event_id % 7) / 7.0, 9) AS combined FROM events"""
)
def rwd01_rwd02_rwd07_mat06_reward_variants(table: Table) -> DataFrame:
    share = F.col("value") / 100
    v0 = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.5 * share).otherwise(-0.1)
    v2 = K.clipped(0.7 * share + 0.3 * (F.col("event_id") % 10) / 10 - 0.2, -1.0, 1.0)
    return table("events").select("event_id", F.round(v0, 9).alias("v0"), F.round(v2, 9).alias("v2"), F.round(0.8 * share + 0.2 * (F.col("event_id") % 7) / 7, 9).alias("combined"))


@query(
    f"""SELECT event_id, round(least(greatest(value - coalesce(lag(value) OVER ({SQL_USER}), 0), 0), 100) / 100, 9) AS gain, round(CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE greatest(least(value / 100 - 0.4, 1), -1) END, 9) AS masked FROM events"""
)
def rwd03_rwd04_rwd06_marginal_gain(table: Table) -> DataFrame:
    gain = K.clipped(F.col("value") - F.coalesce(F.lag("value").over(by_user()), F.lit(0.0)), 0.0, 100.0) / 100
    masked = F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(K.clipped(F.col("value") / 100 - 0.4, -1.0, 1.0))
    return table("events").select("event_id", F.round(gain, 9).alias("gain"), F.round(masked, 9).alias("masked"))


@query("SELECT p_partkey, list_transform(range(0, 12), lambda i: CASE WHEN (i >= p_size % 5 AND i < p_size % 5 + 3) OR i >= 10 THEN 1 ELSE 0 END::INT) AS mask FROM part")
def arr01_arr02_span_mask(table: Table) -> DataFrame:
    start = (F.col("p_size") % 5).cast("int")
    spans = F.array(F.struct(start.alias("a"), (start + 3).alias("b")), F.struct(F.lit(10).alias("a"), F.lit(12).alias("b")))
    return table("part").select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.exists(spans, lambda s: (i >= s["a"]) & (i < s["b"])).cast("int")).alias("mask"))


@query(
    """WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS ratio FROM embeddings)
       SELECT vec_id, round(-list_sum(list_transform(ratio, lambda r: least(r * 0.5, least(greatest(r, 0.8), 1.2) * 0.5))) / len(ratio), 6) AS loss,
              round(list_sum(list_transform(ratio, lambda r: (abs(r - 1) > 0.2)::INT)) / len(ratio)::DOUBLE, 6) AS clipped, round(list_max(list_transform(ratio, lambda r: abs(r - 1))), 6) AS worst FROM r"""
)
def arr03_arr04_policy_replay(table: Table) -> DataFrame:
    v = table("embeddings").select("vec_id", F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("ratio"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    loss = -total(F.transform("ratio", lambda r: F.least(r * 0.5, K.clipped(r, 0.8, 1.2) * 0.5))) / F.size("ratio")
    clipped = total(F.transform("ratio", lambda r: (F.abs(r - 1) > 0.2).cast("double"))) / F.size("ratio")
    return v.select("vec_id", F.round(loss, 6).alias("loss"), F.round(clipped, 6).alias("clipped"), F.round(F.array_max(F.transform("ratio", lambda r: F.abs(r - 1))), 6).alias("worst"))
