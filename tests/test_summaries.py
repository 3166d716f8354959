"""Metric families against plain counting; gates with metrics that are missing or at their bounds."""

import random
from statistics import mean, pstdev

import pytest
from pyspark.sql import functions as F

from quillspark.operators import summaries as S

FLAGS = ["hit", "finished", "em", "em_strict", "copies_entity", "not_terminated", "repeats", "over_budget", "valid"]


def test_utilisation_of_episodes(spark):
    random.seed(1)
    rows = [{"searches": random.randrange(3), **{f: random.random() < 0.5 for f in FLAGS}} for _ in range(200)]
    got = S.family(spark.createDataFrame(rows), S.UTILISATION).first().asDict()
    searched = [r for r in rows if r["searches"]]
    hit = [r for r in searched if r["hit"]]
    answered = [r for r in hit if r["finished"]]
    assert (got["episodes"], got["searched"], got["hits"]) == (200, len(searched), len(hit))
    assert got["hit_rate"] == len(hit) / len(searched) and got["utilisation_rate"] == sum(r["em"] for r in answered) / len(answered) and got["utilisation_rate_strict"] == sum(r["em_strict"] for r in answered) / len(answered)
    assert got["no_evidence_correct"] == sum(not r["hit"] and r["finished"] and r["em"] for r in searched) and got["hit_no_answer_rate"] == sum(not r["finished"] for r in hit) / len(searched)
    assert got["hit_finish_failure_rate"] == sum(not r["finished"] for r in hit) / len(hit) and got["completion_rate"] == len(answered) / len(hit) and got["valid_no_answer"] == sum(r["valid"] and not r["finished"] for r in rows)
    assert got["hit_and_correct"] + got["hit_and_wrong"] + got["miss_and_correct"] + got["miss_and_wrong"] == 200 and got["hit_then_none"] == sum(r["hit"] and not r["finished"] for r in rows)
    none = S.family(spark.createDataFrame(rows).limit(0), S.UTILISATION).first()
    assert none["episodes"] == 0 and none["hit_rate"] is None
    split = S.by_dimensions(spark.createDataFrame(rows), S.UTILISATION, {"calls": F.col("searches")}).collect()
    assert {(r["dimension"], r["key"]): r["episodes"] for r in split} == {("overall", "overall"): 200, **{("calls", str(k)): sum(r["searches"] == k for r in rows) for k in range(3)}}


def test_rewards_of_rollouts(spark):
    random.seed(2)
    rows = [
        {"g": k // 4, "reward": float(random.randrange(2)) if k // 4 % 3 else 1.0, "em": random.randrange(2) if k // 4 % 2 else 0, "f1": random.random(), "category": random.choice(["search_free", "search_required", "x"]), "searches": random.randrange(3), "turns": random.randrange(4),
         "first_action": random.choice(["answer", "none", "text_search"]), "valid": random.random() < 0.5, "ended": random.choice(["answer", "max_turns"]), "used_image": True, "used_text": False, "image_then_text": False, "repeats": False, "error": random.choice([None, "forged_information"]),
         "valid_actions": 1, "text_actions": 0, "queries": 0, "answered": True, "missed_cache": False} for k in range(120)
    ]
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'string'}" for k, v in rows[1].items())
    got = S.reward_summary(spark.createDataFrame([tuple(r.values()) for r in rows], schema), "g").first()
    free = [r for r in rows if r["category"] == "search_free"]
    groups = [[r for r in rows if r["g"] == g] for g in range(30)]
    assert got["reward_std"] == pytest.approx(pstdev(r["reward"] for r in rows)) and got["search_free_f1"] == pytest.approx(mean(r["f1"] for r in free)) and got["search_free_direct_rate"] == pytest.approx(sum(r["searches"] == 0 for r in free) / len(free))
    assert got["unnecessary_search_rate"] == pytest.approx(sum(r["searches"] > 0 for r in free) / 120) and got["search_call_ratio"] == pytest.approx(sum(r["searches"] for r in rows) / sum(r["turns"] for r in rows)) and got["nonempty_query_rate"] == 0
    assert got["flat_groups"] == sum(len({r["reward"] for r in g}) == 1 for g in groups) and got["all_wrong_ratio"] == pytest.approx(sum(all(r["em"] == 0 for r in g) for g in groups) / 30) and got["forged"] == sum(r["error"] is not None for r in rows)


def test_gates(spark):
    good = {n: (b + 1 if sign == ">" else b) for n, (sign, b) in S.FORMAT_GATE.items()}
    df = spark.createDataFrame([(float(v),) for v in [0]], "x double")
    passes = S.gate(df.withColumns({n: F.lit(float(v)) for n, v in good.items()}), S.FORMAT_GATE).first()
    assert passes["passed"] and passes["failed"] == []
    for name, (sign, bound) in S.FORMAT_GATE.items():
        worse = {**good, name: bound - 0.001 if sign == ">=" else bound + 0.001 if sign == "<=" else bound + 1 if sign == "==" else 0}
        assert S.gate(df.withColumns({n: F.lit(float(v)) for n, v in worse.items()}), S.FORMAT_GATE).first()["failed"] == [name]
    assert S.gate(df.withColumns({n: F.lit(None).cast("double") for n in good if n != "extra_text_rate"}), S.FORMAT_GATE).first()["failed"] == list(S.FORMAT_GATE)
