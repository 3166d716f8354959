"""Invariants of trajectories and of the examples unfolded from them: every broken rule of a row, in the order in which they are asked.

A trajectory's steps are run through the grammar of its route as a small automaton; what a
rule says of one step names that step.  Over files, a violation names file and line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.actions import parsed_action
from quillspark.sources.ranges import numbered_lines

# Versions, roles, splits, routes with their steps, and the action that each transition leads to.
LATER_VERSIONS = ("protocol-sft-v0.2", "protocol-sft-v0.3", "protocol-sft-v0.4", "protocol-sft-v0.5", "protocol-format-sft-v1")
VERSIONS = ("protocol-sft-v0", "protocol-sft-v0.1", *LATER_VERSIONS)
ROLES = ("system", "user", "assistant", "tool")
SPLITS = ("train", "dev", "test")
LEADS_TO = {
    "initial_to_direct_answer": "answer", "initial_to_image_search": "image_search", "image_information_to_answer": "answer",
    "initial_to_text_search": "text_search", "image_information_to_text_search": "text_search", "text_information_to_answer": "answer",
}
STEPS = {
    "direct_answer": ("initial_to_direct_answer",),
    "image_search": ("initial_to_image_search", "image_information_to_answer"),
    "text_search": ("initial_to_text_search", "text_information_to_answer"),
    "image_search_answer": ("initial_to_image_search", "image_information_to_answer"),
    "text_search_answer": ("initial_to_text_search", "text_information_to_answer"),
    "image_text_search_answer": ("initial_to_image_search", "image_information_to_text_search", "text_information_to_answer"),
}

MESSAGE = "struct<role: string, content: string, trainable: boolean>"
STEP = f"struct<transition: string, state: array<{MESSAGE}>, target: string>"
TRAJECTORY = f"trajectory_id string, source_data_id string, route string, question string, canonical_answer string, accepted_answers array<string>, schema_version string, steps array<{STEP}>"
EXAMPLE = (
    f"example_id string, trajectory_id string, source_data_id string, split string, route string, transition string, state array<{MESSAGE}>, target string, canonical_answer string, "
    "accepted_answers array<string>, schema_version string, target_turn_index int, history_turn_count int, target_action_type string"
)


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^\s*$")


def expected_answer(canonical: Column) -> Column:
    """How a target writes an answer: blanks collapsed, signs of markup escaped."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(canonical, F.lit("")), r"\s+", " "), "^ | $", "")
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), flat)


def _faults(rules: list[tuple[str | Column, Column]], step: Column) -> Column:
    """The names of the broken rules with their step; an unknown condition is a broken one."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.struct(step.cast("int").alias("step"), (F.lit(name) if isinstance(name, str) else name).alias("rule"))) for name, broken in rules]))


def _message_rules(state: Column) -> list[tuple[str, Column]]:
    state = F.coalesce(state, F.array().cast(f"array<{MESSAGE}>"))
    return [
        ("unsupported role", F.exists(state, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)))),
        ("empty message", F.exists(state, lambda m: _blank(m["content"]))),
        ("trainable history", F.exists(state, lambda m: F.coalesce(m["trainable"], F.lit(False)))),
    ]


def _is_accepted(canonical: Column, accepted: Column) -> Column:
    return F.coalesce(F.exists(accepted, lambda a: a == canonical), F.lit(False))


def trajectory_faults(df: DataFrame) -> DataFrame:
    """``df`` (the columns of TRAJECTORY) with faults: array of struct<step, rule>, the rules in the order in which they are asked; step is null for the trajectory's own.

    A null version is the first one; other nulls are empty.
    """
    steps = F.coalesce(F.col("steps"), F.array().cast(f"array<{STEP}>"))
    parsed = df.withColumn("_steps", F.transform(steps, lambda s: F.struct(s["transition"].alias("transition"), s["state"].alias("state"), parsed_action(s["target"]).alias("parsed"))))
    sizes = F.create_map(*[x for r, s in STEPS.items() for x in (F.lit(r), F.lit(len(s)))])
    paths = F.create_map(*[x for r, s in STEPS.items() for x in (F.lit(r), F.array(*map(F.lit, s)))])
    leads = F.create_map(*[x for t, a in LEADS_TO.items() for x in (F.lit(t), F.lit(a))])
    known, none = F.col("route").isin(*STEPS), F.lit(None)
    own = _faults(
        [
            ("unsupported version", ~F.coalesce("schema_version", F.lit(VERSIONS[0])).isin(*VERSIONS)),
            ("unknown route", ~known),
            ("empty identifier", (F.coalesce("trajectory_id", F.lit("")) == "") | (F.coalesce("source_data_id", F.lit("")) == "")),
            ("empty question or answer", _blank(F.col("question")) | _blank(F.col("canonical_answer"))),
            ("no accepted answers", F.coalesce(F.size("accepted_answers"), F.lit(0)) <= 0),
            ("answer not accepted", (F.coalesce(F.size("accepted_answers"), F.lit(0)) > 0) & ~_is_accepted(F.col("canonical_answer"), F.col("accepted_answers"))),
            ("wrong number of steps", F.coalesce(known & (F.size("_steps") != F.try_element_at(sizes, F.col("route"))), F.lit(False))),
        ],
        none,
    )
    each = F.flatten(
        F.transform(
            "_steps",
            lambda s, i: _faults(
                [
                    ("unknown transition", ~s["transition"].isin(*LEADS_TO)),
                    ("empty state", F.coalesce(F.size(s["state"]), F.lit(0)) <= 0),
                    *_message_rules(s["state"]),
                    (F.concat(F.lit("invalid target: "), s["parsed"]["error"]), ~s["parsed"]["valid"]),
                ],
                i,
            ),
        )
    )
    # The automaton of a route: at step i only its i-th transition goes on, with the action it leads to.
    path = F.try_element_at(paths, F.col("route"))
    went = F.aggregate(
        "_steps",
        F.struct(F.lit(0).alias("at"), F.lit(True).alias("sound")),
        lambda acc, s: F.struct(
            (acc["at"] + 1).alias("at"),
            (acc["sound"] & F.coalesce((F.get(path, acc["at"]) == s["transition"]) & (F.try_element_at(leads, s["transition"]) == s["parsed"]["action"]), F.lit(False))).alias("sound"),
        ),
    )
    route = _faults([("steps off the route", F.coalesce(known & (F.size("_steps") == F.size(path)) & ~went["sound"], F.lit(False)))], none)
    told = expected_answer(F.col("canonical_answer"))
    answers = F.flatten(F.transform("_steps", lambda s, i: _faults([("answer differs", F.coalesce((s["parsed"]["action"] == "answer") & (s["parsed"]["content"] != told), F.lit(False)))], i)))
    return parsed.withColumn("faults", F.concat(own, each, route, answers)).drop("_steps")


def example_faults(df: DataFrame) -> DataFrame:
    """``df`` (the columns of EXAMPLE) with faults: array of struct<step, rule> as in ``trajectory_faults``, step null.

    Turn numbers and the action's name are asked of LATER_VERSIONS alone.
    """
    leads = F.create_map(*[x for t, a in LEADS_TO.items() for x in (F.lit(t), F.lit(a))])
    state = F.coalesce(F.col("state"), F.array().cast(f"array<{MESSAGE}>"))
    said = F.filter(state, lambda m: m["role"] == "assistant")
    parsed = df.withColumns({"_parsed": parsed_action(F.col("target")), "_turns": F.size(said), "_past": F.transform(said, lambda m: parsed_action(m["content"])["valid"])})
    leads_to = F.try_element_at(leads, F.col("transition"))
    valid, later = F.col("_parsed.valid"), F.coalesce(F.col("schema_version").isin(*LATER_VERSIONS), F.lit(False))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    sure = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        ("unsupported version", ~F.coalesce("schema_version", F.lit(VERSIONS[0])).isin(*VERSIONS)),
        ("invalid split", ~F.col("split").isin(*SPLITS)),
        ("unknown route", ~F.col("route").isin(*STEPS)),
        ("unknown transition", ~F.col("transition").isin(*LEADS_TO)),
        ("empty identifier", empty("example_id") | empty("trajectory_id") | empty("source_data_id")),
        ("answer not accepted", empty("canonical_answer") | ~_is_accepted(F.col("canonical_answer"), F.col("accepted_answers"))),
        *_message_rules(F.col("state")),
        (F.concat(F.lit("invalid target: "), F.col("_parsed.error")), ~valid),
        ("action off the transition", sure(valid & (leads_to != F.col("_parsed.action")))),
        ("negative turn", sure(later & (F.col("target_turn_index") < 0))),
        ("wrong number of turns", later & (~F.col("history_turn_count").eqNullSafe(F.col("_turns")))),
        ("wrong turn", later & (~F.col("target_turn_index").eqNullSafe(F.col("_turns")))),
        ("wrong action type", sure(later & valid & ~F.col("target_action_type").eqNullSafe(F.col("_parsed.action")))),
        ("answer differs", sure(valid & (leads_to == "answer") & (F.col("_parsed.action") == "answer") & (F.col("_parsed.content") != expected_answer(F.col("canonical_answer"))))),
        ("invalid action in history", F.exists("_past", lambda v: ~v)),
    ]
    return parsed.withColumn("faults", _faults(rules, F.lit(None))).drop("_parsed", "_turns", "_past")


def line_violations(spark: SparkSession, path: str, kind: str = "trajectory") -> DataFrame:
    """file, line, step, rule of every broken rule in files of JSON lines of trajectories, or of examples; lines that are no object break "not an object"."""
    schema, check = {"trajectory": (TRAJECTORY, trajectory_faults), "example": (EXAMPLE, example_faults)}[kind]
    lines = numbered_lines(spark, path).where(~F.col("value").rlike(r"^\s*$"))
    rows = lines.withColumns({"row": F.from_json("value", schema), "kind": F.schema_of_variant(F.try_parse_json("value"))})
    sound = F.coalesce(F.startswith("kind", F.lit("OBJECT")), F.lit(False))
    found = check(rows.where(sound).select("file", "line", "row.*")).select("file", "line", F.explode("faults").alias("f")).select("file", "line", "f.step", "f.rule")
    return found.unionByName(rows.where(~sound).select("file", "line", F.lit(None).cast("int").alias("step"), F.lit("not an object").alias("rule")))
