"""Families of metrics over episodes and rollouts, and the gates that read them.

A family is a table of names and what each counts, in SQL that is applied in one
aggregation; ratios are null, or 0 where a family says so, for an empty denominator.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.exchange import skew_join


def _n(condition: str = "true") -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _ratio(top: str, bottom: str = "true") -> str:
    return f"{_n(top)} / nullif({_n(bottom)}, 0)"


def _zero(expression: str) -> str:
    return f"coalesce({expression}, 0.0)"


#: Episodes: searches (successful ones), hit (evidence was found), finished (with an answer), em, em_strict, and flags of failures.
UTILISATION = {
    "episodes": _n(), "searched": _n("searches > 0"), "hits": _n("searches > 0 AND hit"), "hit_correct": _n("searches > 0 AND hit AND finished AND em"),
    "hit_wrong": _n("searches > 0 AND hit AND finished AND NOT em"), "hit_no_answer": _n("searches > 0 AND hit AND NOT finished"), "no_evidence_correct": _n("searches > 0 AND NOT hit AND finished AND em"),
    "hit_rate": _ratio("searches > 0 AND hit", "searches > 0"), "hit_correct_rate": _ratio("searches > 0 AND hit AND finished AND em", "searches > 0"),
    "hit_wrong_rate": _ratio("searches > 0 AND hit AND finished AND NOT em", "searches > 0"), "hit_no_answer_rate": _ratio("searches > 0 AND hit AND NOT finished", "searches > 0"),
    "no_evidence_correct_rate": _ratio("searches > 0 AND NOT hit AND finished AND em", "searches > 0"), "utilisation_rate": _ratio("searches > 0 AND hit AND finished AND em", "searches > 0 AND hit AND finished"),
    "utilisation_rate_strict": _ratio("searches > 0 AND hit AND finished AND em_strict", "searches > 0 AND hit AND finished"), "completion_rate": _ratio("searches > 0 AND hit AND finished", "searches > 0 AND hit"),
    "entity_copies": _n("copies_entity"), "entity_copy_rate": _ratio("copies_entity"), "termination_failures": _n("not_terminated"), "repeated_searches": _n("repeats"),
    "hit_then_none": _n("hit AND NOT finished"), "hit_then_repeat": _n("hit AND repeats"), "hit_then_over_budget": _n("hit AND over_budget"), "hit_finish_failure_rate": _ratio("searches > 0 AND hit AND NOT finished", "searches > 0 AND hit"),
    "valid_no_answer": _n("valid AND NOT finished"), "hit_and_correct": _n("hit AND em"), "hit_and_wrong": _n("hit AND NOT em"), "miss_and_correct": _n("NOT hit AND em"), "miss_and_wrong": _n("NOT hit AND NOT em"),
}

#: Rollouts: reward, em and f1 of the answer, category, searches, turns, first_action, flags, and counts of their actions.
REWARDS = {
    "rollouts": _n(), "reward_mean": _zero("avg(reward)"), "reward_std": _zero("stddev_pop(reward)"), "reward_min": _zero("min(reward)"), "reward_max": _zero("max(reward)"),
    "valid_rate": _zero(_ratio("valid")), "malformed_rate": _zero(_ratio("NOT valid")), "finish_rate": _zero(_ratio("ended IN ('answer', 'cache_miss_then_answer')")), "answer_em": _zero("avg(em)"), "answer_f1": _zero("avg(f1)"),
    "search_free_em": _zero("avg(em) FILTER (WHERE category = 'search_free')"), "search_free_f1": _zero("avg(f1) FILTER (WHERE category = 'search_free')"),
    "search_required_em": _zero("avg(em) FILTER (WHERE category = 'search_required')"), "search_required_f1": _zero("avg(f1) FILTER (WHERE category = 'search_required')"),
    "search_free_search_rate": _zero(_ratio("category = 'search_free' AND searches > 0", "category = 'search_free'")), "search_required_search_rate": _zero(_ratio("category = 'search_required' AND searches > 0", "category = 'search_required'")),
    "search_free_direct_rate": _zero(_ratio("category = 'search_free' AND searches = 0", "category = 'search_free'")), "unnecessary_search_rate": _zero(_ratio("category = 'search_free' AND searches > 0")),
    "missing_search_rate": _zero(_ratio("category = 'search_required' AND searches = 0")), "first_answer": _n("first_action = 'answer'"), "first_image": _n("first_action = 'image_search'"), "first_text": _n("first_action = 'text_search'"), "first_none": _n("first_action = 'none'"),
    "image_rate": _zero(_ratio("used_image")), "text_rate": _zero(_ratio("used_text")), "image_to_text_rate": _zero(_ratio("image_then_text")), "search_call_ratio": "sum(searches) / greatest(sum(turns), 1)",
    "answer_only_rate": _zero(_ratio("searches = 0")), "average_searches": _zero("avg(searches)"), "average_turns": _zero("avg(turns)"), "duplicate_query_rate": _zero(_ratio("repeats")), "forged": _n("error = 'forged_information'"),
    "one_action_rate": _zero("sum(valid_actions) / nullif(sum(turns), 0)"), "nonempty_query_rate": "coalesce(sum(queries), 0) / greatest(coalesce(sum(text_actions), 0), 1)", "nonempty_answer_rate": _zero(_ratio("answered")),
    "turns_exhausted_rate": _zero(_ratio("ended = 'max_turns'")), "cache_miss_rate": _zero(_ratio("missed_cache")),
}

#: What groups of rollouts add: shares of groups without variance, all wrong, all right.
GROUPS = {"groups": _n(), "flat_groups": _n("flat"), "flat_ratio": _zero(_ratio("flat")), "all_wrong_ratio": _zero(_ratio("all_wrong")), "all_correct_ratio": _zero(_ratio("all_correct"))}

# Thresholds of the format gates: metric, sign, bound.
FORMAT_GATE = {
    "protocol_valid_rate": (">=", 0.99), "exactly_one_action_rate": (">=", 0.99), "malformed_rate": ("<=", 0.01), "extra_text_rate": ("<=", 0.01), "forged_information_count": ("==", 0), "nonempty_reason_rate": (">=", 0.99),
    "nonempty_action_payload_rate": (">=", 0.99), "tag_closure_rate": (">=", 0.99), "target_truncation_count": ("==", 0), "answer_targets": (">", 0), "image_search_targets": (">", 0), "text_search_targets": (">", 0),
}
LEGACY_GATE = {
    "protocol_valid_rate": (">=", 0.97), "exactly_one_action_rate": (">=", 0.98), "malformed_rate": ("<=", 0.03), "forged_information_count": ("==", 0), "text_query_nonempty_rate": (">=", 0.95), "answer_finish_rate": (">=", 0.90), "target_truncation_count": ("==", 0),
}


def family(df: DataFrame, metrics: Mapping[str, str], by: list[str] | None = None) -> DataFrame:
    """A row of metrics for each group, or one."""
    return df.groupBy(*(by or [])).agg(*[F.expr(sql).alias(name) for name, sql in metrics.items()])


def by_dimensions(df: DataFrame, metrics: Mapping[str, str], dimensions: Mapping[str, Column], by: list[str] | None = None) -> DataFrame:
    """dimension, key and metrics: of all rows ("overall"), and of those of each value of each dimension; one aggregation."""
    keys = [F.struct(F.lit("overall").alias("dimension"), F.lit("overall").alias("key"))]
    keys += [F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("key")) for n, c in dimensions.items()]
    each = df.withColumn("_d", F.explode(F.array(*keys))).withColumns({"dimension": F.col("_d.dimension"), "key": F.col("_d.key")}).drop("_d")
    return family(each, metrics, [*(by or []), "dimension", "key"])


def reward_summary(df: DataFrame, group: str, by: list[str] | None = None) -> DataFrame:
    """The REWARDS of rollouts and the GROUPS of their groups (column ``group``), of each value of ``by`` or in one row."""
    by = by or []
    grouped = df.groupBy(*by, group).agg((F.stddev_pop("reward") <= 1e-12).alias("flat"), F.bool_and(F.col("em") == 0).alias("all_wrong"), F.bool_and(F.col("em") == 1).alias("all_correct"))
    rewards, groups = family(df, REWARDS, by), family(grouped, GROUPS, by)
    return skew_join(rewards, groups, by, "inner") if by else rewards.crossJoin(F.broadcast(groups))  # one row each


def gate(metrics: DataFrame, rules: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``metrics`` with a column passes_<metric> for each rule, failed (names of broken ones), and passed; a metric that is missing or null breaks its rule."""
    signs = {">=": lambda c, b: c >= b, "<=": lambda c, b: c <= b, "==": lambda c, b: c == b, ">": lambda c, b: c > b}
    held = {name: F.coalesce(signs[sign](F.col(name), bound), F.lit(False)) if name in metrics.columns else F.lit(False) for name, (sign, bound) in rules.items()}
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in held.items()]))
    return metrics.withColumns({f"passes_{n}": c for n, c in held.items()}).withColumns({"failed": failed, "passed": F.size(failed) == 0})


def replay_gates(rollouts: DataFrame, actions: DataFrame, groups: DataFrame, historical: bool = True) -> DataFrame:
    """gate, name, result (pass, fail, by construction, not verifiable) of a replay's hard gates.

    ``rollouts``: group, reward, old_reward, em, finished, gold_support, missed_evidence and values
    (array of all its numbers); ``actions``: tool, executed, utility, coverage, improvement, local;
    ``groups``: flat.  Gates that hold by the formula of a reward, whatever the rows, say so.
    """
    r = rollouts.agg(
        F.avg(F.when(F.col("em") == 1, F.col("reward"))).alias("right"), F.avg(F.when((F.col("em") == 0) & F.col("finished"), F.col("reward"))).alias("wrong"),
        F.coalesce(F.bool_or((F.col("gold_support") > 0) & (F.col("missed_evidence") > 0)), F.lit(False)).alias("penalty"),
        F.coalesce(F.bool_and(F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))), F.lit(True)).alias("finite"),
    )
    text = F.col("executed") & (F.col("tool") == "text_search")
    a = actions.agg(
        F.count_if(text).alias("texts"), F.coalesce(F.bool_and(~(text & (F.col("coverage") == 0)) | (F.col("utility") == 0)), F.lit(True)).alias("masked"),
        F.count_if(text & (F.col("improvement") < 0) & (F.col("utility") < 0)).alias("negative"), F.coalesce(F.bool_or(F.abs("local") > 0), F.lit(False)).alias("signal"),
    )
    g = groups.agg(F.coalesce(F.avg(F.col("flat").cast("int")), F.lit(0.0)).alias("flat_now"))
    old = rollouts.groupBy("group").agg(F.min(F.round("old_reward", 12)).alias("a"), F.max(F.round("old_reward", 12)).alias("b")).agg(F.coalesce(F.avg((F.col("a") == F.col("b")).cast("int")), F.lit(0.0)).alias("flat_then"))
    one = r.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(g)).crossJoin(F.broadcast(old))  # one row each
    told = lambda c: F.when(F.coalesce(c, F.lit(False)), "pass").otherwise("fail")
    built, late = F.lit("by construction"), F.lit("not verifiable")
    gates = [
        ("correct_not_below_wrong", told(F.col("right") >= F.col("wrong"))), ("no_direct_bonus_for_evidence", built), ("missed_evidence_is_penalised", told(F.col("penalty"))), ("wrong_span_below_wrong", built),
        ("queries_are_real", told(F.col("texts") > 0) if historical else F.lit("pass")), ("absent_corpus_is_masked", told(F.col("masked"))), ("queries_can_be_negative", F.when(F.col("negative") > 0, "pass").otherwise(built)), ("later_success_relabels_nothing", built),
        ("repeated_image_gains_nothing", built), ("search_count_is_no_input", built), ("task_type_is_no_input", built), ("all_values_finite", told(F.col("finite"))),
        ("flat_groups_not_above_before", told(F.col("flat_now") <= F.col("flat_then")) if historical else late), ("some_local_signal", told(F.col("signal")) if historical else late),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("gate"), F.lit(n).alias("name"), c.alias("result")) for k, (n, c) in enumerate(gates, 1)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def marginal_contributions(rows: DataFrame, source: str, types: list[str], target: int) -> DataFrame:
    """source, nth, own, cumulative, capacity, reached: sources in the order of what they have, with the equal share of all types that they reach together.

    ``rows`` has a column for each type, whether a row can serve it.  A row of several types
    counts for each; capacity is the least of the types' sums, and of all rows over the types.
    """
    from pyspark.sql import Window

    own = rows.groupBy(source).agg(F.count_if(sum((F.coalesce(F.col(t), F.lit(False)).cast("int") for t in types), F.lit(0)) > 0).alias("own"), *[F.count_if(t).alias(f"_{t}") for t in types])
    order = Window.orderBy(F.desc("own"), source).rowsBetween(Window.unboundedPreceding, 0)  # a row for each source
    up_to = own.withColumns({"nth": F.row_number().over(Window.orderBy(F.desc("own"), source)), "cumulative": F.sum("own").over(order), **{f"_{t}": F.sum(f"_{t}").over(order) for t in types}})
    capacity = F.least(*[F.col(f"_{t}") for t in types], F.floor(F.col("cumulative") / len(types)))
    return up_to.select(source, F.col("nth").cast("long").alias("nth"), "own", "cumulative", capacity.alias("capacity"), (capacity >= target).alias("reached"))
