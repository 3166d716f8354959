"""Queries of episodes, paired runs and answers (FLT, JOIN, SET, NST, RWD, ARR)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import episodes as E
from quillspark.operators import grouping as G
from quillspark.operators import routes as RO
from quillspark.plans.declare import Table, query


@query(
    """SELECT conv_id, count(*) AS steps, CASE conv_id % 3 WHEN 0 THEN count(*) = 1 WHEN 1 THEN count(*) = 2 ELSE count(*) = 3 END AS made FROM conversations GROUP BY conv_id"""
)
def nst03_nst04_nst05_nst06_flt24_routes(table: Table) -> DataFrame:
    """Conversations as trajectories of three routes: made where they have as many turns as the route has steps, and then of its grammar."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    route = F.element_at(F.array(*map(F.lit, ("direct_answer", "text_search_answer", "image_text_search_answer"))), (F.col("conv_id") % 3 + 1).cast("int"))
    c = table("conversations").groupBy("conv_id").agg(turns.alias("t")).withColumn("route", route)
    made = c.withColumn("steps", E.constructed(F.col("route"), F.col("t")))
    return made.select("conv_id", F.size("t").cast("long").alias("steps"), F.coalesce(E.follows_route(F.col("route"), F.col("steps")), F.lit(False)).alias("made"))


@query(
    """SELECT a.event_id // 2 AS pair, a.event_type AS left_type, b.event_type AS right_type, a.value AS left_value, b.value AS right_value FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0"""
)
def join15_join16_join29_asserted_pairs(table: Table) -> DataFrame:
    """Even and odd events as two runs of one set of pairs: no pair may be missing, repeat or differ in its identity."""
    e = table("events").select(F.floor(F.col("event_id") / 2).alias("pair"), (F.floor(F.col("event_id") / 2) % 7).alias("prompt"), F.col("event_type").alias("type"), "value", "event_id")
    left, right = (e.where(F.col("event_id") % 2 == k).drop("event_id") for k in (0, 1))
    return E.paired(left, right, "pair", ["prompt"], left.count()).drop("prompt")


@query(
    """SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS aliases FROM (SELECT p_partkey, CASE WHEN lower(p_name) = lower(p_brand) THEN [p_name, p_type] ELSE [p_name, p_brand, p_type] END AS list_distinct_ordered FROM part)"""
)
def set04_set05_answer_aliases(table: Table) -> DataFrame:
    """Aliases from a JSON list, an object and plain fields, the first of each lower-case form."""
    row = F.create_map(
        F.lit("answer_aliases"), F.to_json(F.array(F.col("p_name"), F.upper("p_name"))), F.lit("answers"), F.to_json(F.struct(F.array("p_brand").alias("aliases"))),
        F.lit("answer"), F.concat(F.lit("  "), F.lower("p_name")), F.lit("entity_aliases"), F.col("p_type"), F.lit("other"), F.lit("unread"),
    )
    return table("part").select("p_partkey", F.array_join(E.answer_aliases(row), "|").alias("aliases"))


@query(
    """WITH c AS (SELECT c_custkey AS id, c_nationkey AS k FROM customer) SELECT min(id) AS component, coalesce(min(id) FILTER (WHERE id % 3 <> 0), min(id)) AS representative FROM c GROUP BY k"""
)
def set10_representatives(table: Table) -> DataFrame:
    """Customers of a nation as one component; who was rejected before represents it only where all were."""
    c = table("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"))
    return E.representatives(G.components(G.key_edges(c, "id", ["k"])), c.where("id % 3 = 0")).select("component", "representative")


@query(
    """WITH g AS (SELECT user_id, list(event_type) AS t FROM events GROUP BY user_id) SELECT user_id, len(t) <> len(list_distinct(t)) AS repeats FROM g"""
)
def flt44_repeated_searches(table: Table) -> DataFrame:
    calls = F.collect_list(F.struct(F.lit("text_search").alias("tool"), F.concat(F.lit("The "), F.col("event_type"), F.lit("!")).alias("query")))
    return table("events").groupBy("user_id").agg(calls.alias("calls")).select("user_id", E.repeats_search(F.col("calls")).alias("repeats"))


@query(
    """WITH x AS (SELECT event_id, least(greatest(value / 100, 0), 1) AS f1, (value > 80)::INT AS em, (event_id % 11) / 10.0 AS gold, (event_id % 7) / 6.0 AS said FROM events),
       q AS (SELECT *, greatest(em, 0.8 * f1) AS quality FROM x), b AS (SELECT *, quality * gold * said AS grounded, 0.15 * (1 - quality) * quality * gold * said AS bonus FROM q)
       SELECT event_id, round(4.0 * em + f1, 9) AS dominance, round(grounded, 9) AS grounded, round(bonus, 9) AS bonus, round(least(greatest(quality + bonus, 0), 1), 9) AS terminal FROM b"""
)
def rwd02_terminal_reward(table: Table) -> DataFrame:
    i, f1 = F.col("event_id"), F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))
    em = (F.col("value") > 80).cast("double")
    x = table("events").select("event_id", em.alias("em"), f1.alias("f1"), (F.least(i % 11, F.lit(10)) / 10).alias("gold"), (i % 7 / 6).alias("said"), F.greatest(em, 0.8 * f1).alias("quality"))
    r = x.select("event_id", E.terminal_reward(*map(F.col, ("em", "f1", "gold", "said", "quality"))).alias("r"))
    return r.select("event_id", *[F.round(f"r.{c}", 9).alias(c) for c in ("dominance", "grounded", "bonus", "terminal")])


@query(
    """SELECT vec_id, round(list_max(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN i % 2 = 1 THEN abs(embedding[i]::DOUBLE - embedding[i]::DOUBLE * 0.5) ELSE 0 END)), 6) AS worst FROM embeddings"""
)
def arr06_alignment_error(table: Table) -> DataFrame:
    """Each vector against its half, at its odd places."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    half = F.transform("embedding", lambda v: v.cast("double") * 0.5)
    return table("embeddings").select("vec_id", F.round(E.alignment_error(x, half, F.transform("embedding", lambda v, i: (i + 1) % 2)), 6).alias("worst"))


@query("SELECT conv_id, last(text ORDER BY turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id")
def src07_last_user_message(table: Table) -> DataFrame:
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    held = table("conversations").groupBy("conv_id").agg(turns.alias("m"))
    return held.select("conv_id", E.last_user_message(F.col("m")).alias("question")).where("question is not null")


def _asked(table: Table) -> DataFrame:
    """Benchmark items as questions whose answer is the source of the document of their number."""
    d = table("documents").select(F.col("doc_id").alias("id"), "source")
    b = table("benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("When was "), "text").alias("question"))
    return b.join(d, "id").select("id", "question", F.array("source", "question").alias("aliases"))


def _corpus(table: Table) -> DataFrame:
    return table("documents").select("doc_id", F.col("doc_id").alias("source_id"), "text")


@query()
def flt22_text_route(table: Table) -> DataFrame:
    titles = table("conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("title"))
    return RO.text_route(_asked(table), titles, _corpus(table)).select("id", "query", "reason", "hit_leave_one_out")


@query()
def flt23_image_text_route(table: Table) -> DataFrame:
    shown = table("conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("rank"), F.col("text").alias("title"), (F.col("conv_id") * 10 + F.col("turn")).alias("doc_id"))
    return RO.image_text_route(_asked(table), shown, _corpus(table), relations=None).select("id", "entity", "relation", "query", "reason")
