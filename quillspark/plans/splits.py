"""Queries of splits, quotas and selections (SPL, SEL, parts of WIN and AGG)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.hashing import digest, uniform
from quillspark.operators import splits as S
from quillspark.plans.declare import Table, query


@query(
    """SELECT doc_id, CASE WHEN r <= 5 THEN 'dev' WHEN r <= 15 THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1:' || doc_id), doc_id) AS r FROM documents)"""
)
def win04_win13_spl01_spl04_banded_split(table: Table) -> DataFrame:
    return S.banded(table("documents").select("doc_id", "lang"), ["lang"], "s1", "doc_id", [("dev", 5), ("test", 10)], "train").drop("lang")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('s2:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 2")
def win11_win12_sel14_cmp36_sample_of_each(table: Table) -> DataFrame:
    return S.banded(table("documents").select("doc_id", "source"), ["source"], "s2", "doc_id", [("sample", 2)]).select("doc_id")


@query(
    """SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('s3:' || doc_id), doc_id) AS r FROM documents) ORDER BY r, source, doc_id LIMIT 50"""
)
def win14_win15_round_robin(table: Table) -> DataFrame:
    return S.round_robin(table("documents").select("doc_id", "source"), "source", "s3", "doc_id", 50).select("doc_id")


@query(
    """SELECT c_custkey FROM (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS a, count(*) OVER (PARTITION BY c_mktsegment) AS b FROM customer) ORDER BY a, b, sha256('s4:' || c_custkey), c_custkey LIMIT 30"""
)
def win16_sel06_diversity_order(table: Table) -> DataFrame:
    c = table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    counted, keys = S.rarity_order(c, ["c_nationkey", "c_mktsegment"], "s4", "c_custkey")
    return counted.orderBy(*keys).limit(30).select("c_custkey")


@query(
    """WITH w AS (SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT name, n, 100.0 * n / sum(n) OVER () AS x FROM w),
       f AS (SELECT name, floor(x)::BIGINT AS base, row_number() OVER (ORDER BY floor(x) - x, name) AS r FROM t)
       SELECT name, base + CASE WHEN r <= 100 - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS quota FROM f"""
)
def spl02_spl03_largest_remainders(table: Table) -> DataFrame:
    counts = table("customer").groupBy("c_mktsegment").count()
    quotas = S.largest_remainders({r["c_mktsegment"]: r["count"] for r in counts.collect()}, 100)  # a row for each segment
    return counts.sparkSession.createDataFrame(sorted(quotas.items()), "name string, quota long")


@query(
    """SELECT source, count(DISTINCT split) > 1 AS leaks, count(*) AS rows FROM (SELECT source, CASE WHEN r <= 5 THEN 'dev' ELSE 'train' END AS split FROM
         (SELECT source, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1:' || doc_id), doc_id) AS r FROM documents)) GROUP BY source"""
)
def agg32_agg33_split_leaks(table: Table) -> DataFrame:
    split = S.banded(table("documents").select("doc_id", "lang", "source"), ["lang"], "s1", "doc_id", [("dev", 5)], "train")
    return split.groupBy("source").agg((F.count_distinct("split") > 1).alias("leaks"), F.count("*").alias("rows"))


@query(
    """SELECT a.split AS left_split, b.split AS right_split, count(DISTINCT a.source) AS shared FROM
         (SELECT DISTINCT source, CASE WHEN doc_id % 3 = 0 THEN 'audit' WHEN doc_id % 3 = 1 THEN 'dev' ELSE 'train' END AS split FROM documents) a JOIN
         (SELECT DISTINCT source, CASE WHEN doc_id % 3 = 0 THEN 'audit' WHEN doc_id % 3 = 1 THEN 'dev' ELSE 'train' END AS split FROM documents) b ON a.source = b.source AND a.split < b.split GROUP BY 1, 2"""
)
def join28_split_overlap(table: Table) -> DataFrame:
    split = F.when(F.col("doc_id") % 3 == 0, "audit").when(F.col("doc_id") % 3 == 1, "dev").otherwise("train")
    held = table("documents").select("source", split.alias("split")).distinct()
    other = held.select("source", F.col("split").alias("right_split"))
    met = held.withColumnRenamed("split", "left_split").join(other, "source").where("left_split < right_split")
    return met.groupBy("left_split", "right_split").agg(F.count_distinct("source").alias("shared"))


@query("SELECT c_mktsegment AS route, count(DISTINCT (c_nationkey, c_custkey % 7)) AS groups FROM customer GROUP BY 1")
def agg34_route_availability(table: Table) -> DataFrame:
    return table("customer").groupBy(F.col("c_mktsegment").alias("route")).agg(F.count_distinct("c_nationkey", F.col("c_custkey") % 7).alias("groups"))


@query()
def sel01_sel04_sel13_spl08_unique_selection(table: Table) -> DataFrame:
    """Parts in price order of which no two share a name, or a brand together with a size."""
    p = table("part").select("p_partkey", "p_name", F.concat_ws(":", "p_brand", F.col("p_size").cast("string")).alias("form"), "p_retailprice")
    return S.unique_on(p, ["p_name", "form"], [F.col("p_retailprice"), F.col("p_partkey")]).select("p_partkey")


@query()
def sel02_sel03_route_plan(table: Table) -> DataFrame:
    counts = {r["lang"]: r["count"] for r in table("documents").groupBy("lang").count().collect()}  # a row for each language
    total = sum(counts.values()) // 2 // 10 * 10
    ranges = {k: (0, n // 2 // 10 * 10, n) for k, n in sorted(counts.items())}
    plan = S.best_plan(counts, ranges, total) or {}
    return table("documents").sparkSession.createDataFrame(sorted(plan.items()), "route string, rows long")


@query()
def sel05_sel09_cmp17_cmp18_joint_capacity(table: Table) -> DataFrame:
    """Documents may serve short, plain or English needs; how many of each pattern serve which, at the best equal share."""
    able = F.array_compact(F.array(F.when(F.col("n_chars") < 1500, "short"), F.when(F.col("lang") == "en", "english"), F.when(F.col("doc_id") % 4 == 0, "plain")))
    counts = table("documents").groupBy(able.alias("able")).count().collect()  # a row for each pattern, eight at most
    patterns = {tuple(r["able"]): r["count"] for r in counts if r["able"]}
    types = ["english", "plain", "short"]
    flow = S.pattern_flow(patterns, dict.fromkeys(types, S.equal_capacity(patterns, types)))
    rows = sorted(("+".join(p), t, n) for (p, t), n in flow.items())
    return table("documents").sparkSession.createDataFrame(rows, "pattern string, type string, rows long")


@query()
def sel07_join31_shard_cover(table: Table) -> DataFrame:
    """Suppliers as shards that cover parts' sizes, the fewest first chosen greedily among all."""
    parts = table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("member"))
    held = table("lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("shard")).join(parts, "l_partkey")
    sizes = held.groupBy("shard").agg(F.count(F.lit(1)).alias("bytes"))
    chosen = S.shard_cover(held, sizes, 5)
    return held.sparkSession.createDataFrame(list(enumerate(chosen, 1)), "nth long, shard string")


@query()
def spl05_spl06_spl07_group_splits(table: Table) -> DataFrame:
    """Sources as whole groups to splits by share, the largest first."""
    sizes = table("documents").groupBy(F.col("source").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    return S.group_split(sizes, {"train": 0.8, "test": 0.1, "dev": 0.1}, "g1").select(F.col("group").alias("source"), "n", "split")


@query(
    """WITH f AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders WHERE o_totalprice < 50000),
       r AS (SELECT o_orderkey AS reserve, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders WHERE o_totalprice >= 400000)
       SELECT o_orderkey, reserve FROM f LEFT JOIN r USING (o_orderpriority, n)"""
)
def sel08_snk20_reserve_replacement(table: Table) -> DataFrame:
    """Orders below a price are replaced by dear ones of the same priority, one by one in order."""
    o = table("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return S.replaced(o.where("o_totalprice < 50000"), o.where("o_totalprice >= 400000"), "o_orderpriority", "o_orderkey")


@query("SELECT doc_id FROM documents WHERE ('0x' || left(sha256('e0:' || doc_id), 16))::UBIGINT::DOUBLE / 18446744073709551616 < CASE lang WHEN 'en' THEN 0.25 ELSE 0.75 END")
def sel12_balanced_sample(table: Table) -> DataFrame:
    """A balanced epoch by hash: the feature is sampling, at a rate for each stratum."""
    rate = F.when(F.col("lang") == "en", 0.25).otherwise(0.75)
    return table("documents").where(uniform(digest("e0", F.col("doc_id"))) < rate).select("doc_id")


@query(
    """WITH g AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('e1:' || doc_id), doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IN ('en', 'de', 'fr'))
       SELECT doc_id, lang, ((CASE lang WHEN 'en' THEN 300 WHEN 'de' THEN 300 ELSE 150 END) // n + (r < (CASE lang WHEN 'en' THEN 300 WHEN 'de' THEN 300 ELSE 150 END) % n)::BIGINT)::BIGINT AS times FROM g
       WHERE (CASE lang WHEN 'en' THEN 300 WHEN 'de' THEN 300 ELSE 150 END) // n + (r < (CASE lang WHEN 'en' THEN 300 WHEN 'de' THEN 300 ELSE 150 END) % n)::BIGINT > 0"""
)
def sel11_quota_epoch(table: Table) -> DataFrame:
    """An epoch of fixed quotas: each stratum's rows in a seeded order, round after round until its quota is full."""
    d = table("documents").select("doc_id", "lang")
    return S.quota_epoch(d, "lang", {"en": 300, "de": 300, "fr": 150}, "e1", "doc_id").select("doc_id", "lang", "times")


@query(
    """WITH s AS (SELECT doc_id, lang, ('0x' || left(sha256('m0:' || doc_id), 16))::UBIGINT::DOUBLE / 18446744073709551616 AS u FROM documents), n AS (SELECT count(*) AS n FROM documents),
       b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('m1:' || doc_id), doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS c FROM documents),
       k AS (SELECT count(DISTINCT lang) AS k FROM documents)
       SELECT doc_id, (u < 0.5) AS by_nature, ((n // 2 // k) // c + (r < (n // 2 // k) % c)::BIGINT)::BIGINT AS by_balance FROM s JOIN b USING (doc_id), n, k"""
)
def sel10_mixed_epoch(table: Table) -> DataFrame:
    """Half an epoch as the rows come, half with an equal quota for each language, repeats where a language is short."""
    return S.mixed_epoch(table("documents").select("doc_id", "lang"), "lang", 0.5, ("m0", "m1"), "doc_id").select("doc_id", "by_nature", "by_balance")


@query("SELECT event_id, event_id % 4 = 0 AS slot, round(greatest(0.0, 1.0 - event_id / 500.0), 6) AS decay FROM events")
def sel18_exploration_schedule(table: Table) -> DataFrame:
    decay = F.greatest(F.lit(0.0), 1 - F.col("event_id") / 500)
    return table("events").select("event_id", (F.col("event_id") % 4 == 0).alias("slot"), F.round(decay, 6).alias("decay"))
