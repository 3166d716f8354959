"""Queries that fold and unfold nested rows (NST)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.declare import Table, query


def trajectories(table: Table) -> DataFrame:
    """conv_id, steps (array of turn, role, text in order)."""
    return table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("steps"))


@query(
    """SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT - 1 AS step, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history FROM conversations"""
)
def nst01_nst08_unfold(table: Table) -> DataFrame:
    steps = trajectories(table).select("conv_id", "steps", F.posexplode("steps").alias("step", "s"))
    history = F.size(F.filter(F.slice("steps", F.lit(1), F.col("step")), lambda x: x["role"] == "assistant")).cast("long")
    return steps.select("conv_id", "s.turn", "step", history.alias("history"))


@query("SELECT role, conv_id // 100 AS block, count(*) AS n, min(conv_id) AS first, string_agg(conv_id || ':' || turn, ',' ORDER BY conv_id, turn) AS ids FROM conversations GROUP BY 1, 2")
def nst02_fold_by_split(table: Table) -> DataFrame:
    """Rows folded by role in blocks of a hundred conversations, so that no list grows with the table."""
    c = table("conversations").groupBy("role", F.floor(F.col("conv_id") / 100).alias("block"))
    c = c.agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.array_sort(F.collect_list(F.struct("conv_id", "turn"))).alias("x"))
    return c.select("role", "block", "n", "first", F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["conv_id"], r["turn"])), ",").alias("ids"))


@query(
    """SELECT doc_id, 'direct:' || doc_id AS trajectory_id, 3::INT AS steps, ['question', 'search', 'answer'][doc_id % 3 + 1] AS kind, text AS content FROM documents"""
)
def nested_steps_of_documents(table: Table) -> DataFrame:
    step = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("text").alias("content"))
    made = table("documents").select("doc_id", F.concat(F.lit("direct:"), "doc_id").alias("trajectory_id"), F.array(step("question"), step("search"), step("answer")).alias("s"))
    chosen = F.element_at("s", (F.col("doc_id") % 3 + 1).cast("int"))
    return made.select("doc_id", "trajectory_id", F.size("s").alias("steps"), chosen["kind"].alias("kind"), chosen["content"].alias("content"))


@query(
    """SELECT doc_id, i::INT AS pos, sha256(part) AS digest, contains(lower(part), 'the') AS reachable FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"""
)
def nst07_evidence_rows(table: Table) -> DataFrame:
    """Every paragraph of every document as evidence: its place, digest, and whether it bears the word."""
    parts = table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "part"))
    return parts.select("doc_id", "pos", F.sha2("part", 256).alias("digest"), F.contains(F.lower("part"), F.lit("the")).alias("reachable"))


@query("""SELECT conv_id, 'v2' AS version, string_agg(upper(role), ',' ORDER BY turn) AS roles, 'pool:' || conv_id AS id FROM conversations GROUP BY conv_id""")
def nst09_nst10_cmp44_migrated(table: Table) -> DataFrame:
    t = trajectories(table).select(F.struct("conv_id", F.lit("v1").alias("version"), "steps").alias("t"))
    upgraded = t.withColumn("t", F.col("t").withField("version", F.lit("v2")).withField("steps", F.transform("t.steps", lambda s: s.withField("role", F.upper(s["role"])))))
    return upgraded.select("t.conv_id", "t.version", F.array_join(F.transform("t.steps", lambda s: s["role"]), ",").alias("roles"), F.concat(F.lit("pool:"), "t.conv_id").alias("id"))


@query("SELECT c.conv_id, c.turn, c.role, m.weight::INT AS weight FROM conversations c JOIN (VALUES ('user', 1), ('assistant', 2), ('system', 3)) m(role, weight) ON c.role = m.role")
def nst11_nst12_mapped_rows(table: Table) -> DataFrame:
    weights = F.create_map(F.lit("user"), F.lit(1), F.lit("assistant"), F.lit(2), F.lit("system"), F.lit(3))
    unfolded = trajectories(table).select("conv_id", F.explode("steps").alias("s"))
    return unfolded.select("conv_id", "s.turn", "s.role", F.try_element_at(weights, F.col("s.role")).alias("weight"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, NOT contains(props, 'ground_truth') AS clean FROM events")
def nst14_cmp40_json_walk(table: Table) -> DataFrame:
    v = F.parse_json("props")
    return table("events").select("event_id", F.variant_get(v, "$.k", "int").alias("k"), (~F.contains("props", F.lit("ground_truth"))).alias("clean"))
