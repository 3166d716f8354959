"""Queries of invariants (FLT25, FLT26): files of trajectories and examples with known damage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import invariants as V
from quillspark.plans.declare import Table, query
from quillspark.plans.ingest import fresh_folder
from quillspark.plans.ranges import write_lines

ROUTES = ("direct_answer", "text_search_answer", "image_text_search_answer")
ACTIONS = {"answer": "answer", "text_search": "text_search", "image_search": "search"}


def _target(action: str, content: Column, number: Column) -> Column:
    """An action of the grammar; where number is 8 mod 10 it gives no reason."""
    body = F.lit("<search><img></search>") if action == "image_search" else F.concat(F.lit(f"<{action}>"), content, F.lit(f"</{action}>"))
    return F.when(number % 10 == 8, body).otherwise(F.concat(F.lit("<reason>since</reason>"), body))


def _trajectories(table: Table) -> DataFrame:
    """Conversations as trajectories of three routes, answered by their whole last turn; number mod 10 says what is wrong with each."""
    c = table("conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"), F.min_by("text", "turn").alias("question")).where(r"answer rlike '\\S' and question rlike '\\S'")
    n = F.col("conv_id")
    bad = lambda k: n % 10 == k
    said, told = F.col("answer"), V.expected_answer(F.col("answer"))
    question = F.struct(F.when(bad(4), "robot").otherwise("user").alias("role"), F.col("question").alias("content"), bad(5).alias("trainable"))

    def steps(route: str) -> Column:
        made = []
        for k, transition in enumerate(V.STEPS[route]):
            action = V.LEADS_TO[transition]
            last = k == len(V.STEPS[route]) - 1
            content = F.when(bad(6), "another answer").otherwise(told) if action == "answer" else F.lit("a query of words")
            state = F.array(question, *[F.struct(F.lit("assistant").alias("role"), _target(V.LEADS_TO[t], F.lit("a query of words"), F.lit(0)).alias("content"), F.lit(False).alias("trainable")) for t in V.STEPS[route][:k]])
            state = F.when(~(bad(9) & F.lit(last)), state).otherwise(F.array().cast(f"array<{V.MESSAGE}>"))
            named = F.when(bad(7) & F.lit(k == 0), "text_information_to_answer" if transition != "text_information_to_answer" else "").otherwise(transition)
            made.append(F.struct(named.alias("transition"), state.alias("state"), _target(action, content, n).alias("target")))
        return F.when(bad(3), F.slice(F.array(*made), 1, len(made) - 1)).otherwise(F.array(*made))

    route = F.element_at(F.array(*map(F.lit, ROUTES)), (n % 3 + 1).cast("int"))
    every = F.coalesce(*[F.when(route == r, steps(r)) for r in ROUTES])
    return c.select(
        F.floor(n / 100).alias("part"), n.alias("number"), n.cast("string").alias("trajectory_id"), F.lit("s").alias("source_data_id"), route.alias("route"), "question", said.alias("canonical_answer"),
        F.array(F.when(bad(2), F.concat(said, F.lit("!"))).otherwise(said), F.lit("other")).alias("accepted_answers"),
        F.when(bad(1), "v9").otherwise("protocol-sft-v0.5").alias("schema_version"), every.alias("steps"),
    )


def _violations(rows: DataFrame, name: str, kind: str) -> DataFrame:
    """Files of ``rows``, a hundred conversations each, in the order of number, and their violations under file and line."""
    path = fresh_folder(rows, name)
    row = F.to_json(F.struct(*[c for c in rows.columns if c not in ("number", "part")]))
    write_lines(rows.select("part", "number", row.alias("value")), path, "part", "number")
    return V.line_violations(rows.sparkSession, path, kind).withColumn("file", F.regexp_extract("file", r"part=(-?\d+)", 1).cast("long"))


@query(
    """WITH c AS (SELECT conv_id, conv_id // 100 AS file, row_number() OVER (PARTITION BY conv_id // 100 ORDER BY conv_id) AS line, conv_id % 3 AS route, conv_id % 10 AS bad FROM
         (SELECT conv_id FROM conversations GROUP BY conv_id HAVING regexp_matches(arg_max(text, turn), '\\S') AND regexp_matches(arg_min(text, turn), '\\S'))),
       s AS (SELECT *, unnest(range(0, route + 1 - (bad = 3)::INT)) AS step FROM c)
       SELECT file, line, NULL::INT AS step, 'unsupported version' AS rule FROM c WHERE bad = 1
       UNION ALL SELECT file, line, NULL, 'answer not accepted' FROM c WHERE bad = 2
       UNION ALL SELECT file, line, NULL, 'wrong number of steps' FROM c WHERE bad = 3
       UNION ALL SELECT file, line, step, 'unsupported role' FROM s WHERE bad = 4
       UNION ALL SELECT file, line, step, 'trainable history' FROM s WHERE bad = 5
       UNION ALL SELECT file, line, step, 'answer differs' FROM s WHERE bad = 6 AND step = route
       UNION ALL SELECT file, line, NULL, 'steps off the route' FROM c WHERE bad IN (7, 8)
       UNION ALL SELECT file, line, step, 'invalid target: missing_reason' FROM s WHERE bad = 8
       UNION ALL SELECT file, line, step, 'empty state' FROM s WHERE bad = 9 AND step = route"""
)
def flt25_trajectory_invariants(table: Table) -> DataFrame:
    """A file of trajectories, audited: every broken rule under its line and step."""
    t = _trajectories(table)
    return _violations(t, "trajectories", "trajectory").select("file", "line", "step", "rule")


@query(
    """WITH c AS (SELECT conv_id, conv_id % 3 AS route, conv_id % 10 AS bad FROM
         (SELECT conv_id FROM conversations GROUP BY conv_id HAVING regexp_matches(arg_max(text, turn), '\\S') AND regexp_matches(arg_min(text, turn), '\\S'))),
       s AS (SELECT *, unnest(range(0, route + 1 - (bad = 3)::INT)) AS step FROM c),
       e AS (SELECT *, conv_id // 100 AS file, row_number() OVER (PARTITION BY conv_id // 100 ORDER BY conv_id * 10 + step) AS line FROM s)
       SELECT file, line, 'unsupported version' AS rule FROM e WHERE bad = 1
       UNION ALL SELECT file, line, 'answer not accepted' FROM e WHERE bad = 2
       UNION ALL SELECT file, line, 'unsupported role' FROM e WHERE bad = 4
       UNION ALL SELECT file, line, 'trainable history' FROM e WHERE bad = 5
       UNION ALL SELECT file, line, 'answer differs' FROM e WHERE bad = 6 AND step = route
       UNION ALL SELECT file, line, 'action off the transition' FROM e WHERE bad = 7 AND step = 0 AND route > 0
       UNION ALL SELECT file, line, 'invalid target: missing_reason' FROM e WHERE bad = 8
       UNION ALL SELECT file, line, 'wrong number of turns' FROM e WHERE bad = 9 AND step = route AND step > 0
       UNION ALL SELECT file, line, 'wrong turn' FROM e WHERE bad = 9 AND step = route AND step > 0
       UNION ALL SELECT file, line, 'invalid split' FROM e WHERE conv_id % 7 = 3"""
)
def flt26_example_invariants(table: Table) -> DataFrame:
    """The same trajectories unfolded into examples, audited."""
    t = _trajectories(table)
    n = F.col("number")
    unfolded = t.select("*", F.posexplode("steps").alias("step", "s")).select(
        "part", (n * 10 + F.col("step")).alias("number"), F.concat_ws(":", "trajectory_id", "step").alias("example_id"), "trajectory_id", "source_data_id", F.when(n % 7 == 3, "held").otherwise("train").alias("split"),
        "route", "s.transition", "s.state", "s.target", "canonical_answer", "accepted_answers", "schema_version", F.col("step").alias("target_turn_index"), F.col("step").alias("history_turn_count"),
        F.coalesce(*[F.when(F.contains(F.col("s.target"), F.lit(f"<{tag}>")), F.lit(a)) for a, tag in ACTIONS.items()]).alias("target_action_type"),
    )
    return _violations(unfolded, "examples", "example").select("file", "line", "rule")
