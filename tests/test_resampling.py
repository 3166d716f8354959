"""Resamples against sequential resampling in distribution; token spans and their faults."""

import random
from statistics import mean, pstdev, variance

import pytest
from pyspark.sql import functions as F

from quillspark.operators import credit, resampling


def data(n, kinds):
    random.seed(n)
    return [random.choice([-1.0, 0.0, 0.0, 1.0]) if kinds == "few" else random.gauss(0.3, 2) for _ in range(n)]


@pytest.mark.parametrize(("kinds", "bucket"), [("few", 4096), ("many", 4096), ("many", 2)])
def test_resamples_are_distributed_like_sequential_ones(spark, monkeypatch, kinds, bucket):
    monkeypatch.setattr(resampling, "BUCKET_VALUES", bucket)
    values, samples = data(300, kinds), 4000
    df = spark.createDataFrame([(v, "a") for v in values] + [(5.0, "b"), (None, "b"), (5.0, "b"), (7.0, "c")], "delta double, g string")
    rows = resampling.resampled_sums(df.repartition(5), samples, 1, ("g",)).collect()
    totals = [r["total"] for r in rows if r["g"] == "a"]
    assert len(totals) == samples and {(r["total"], r["n"]) for r in rows if r["g"] != "a"} == {(10.0, 2), (7.0, 1)}
    n, spread = len(values), pstdev(values)
    assert abs(mean(totals) - sum(values)) < 5 * spread * (n / samples) ** 0.5
    assert abs(variance(totals) / (n * spread**2) - 1) < 0.15
    again = resampling.resampled_sums(df.coalesce(1), samples, 1, ("g",)).collect()
    assert {(r["g"], r["resample"]): round(r["total"], 6) for r in rows} == {(r["g"], r["resample"]): round(r["total"], 6) for r in again}
    random.seed(0)
    plain = sorted(mean(random.choices(values, k=n)) for _ in range(samples))
    told = resampling.bootstrap_rules(df.where("g = 'a'").select("delta"), samples, 1).first()
    width = plain[int(0.975 * samples)] - plain[int(0.025 * samples)]
    for name, at in (("low", 0.025), ("low_index", 0.025), ("high", 0.975), ("high_before", 0.975), ("high_index", 0.975)):
        assert abs(told[name] - plain[int(at * samples)]) < 0.08 * width
    assert told["low"] <= told["high"] and told["high_before"] <= told["high_index"] and (told["rescue"], told["harm"], told["tie"]) == tuple(sum(f(v) for v in values) for f in (lambda v: v > 0, lambda v: v < 0, lambda v: v == 0))
    assert resampling.resampled_sums(df.limit(0), 10).count() == 0


def test_index_rules(spark):
    """With one value every rule gives it; with two of equal weight the means are known."""
    one = resampling.bootstrap_rules(spark.createDataFrame([(2.0,)] * 5, "delta double"), 100).first()
    assert one["low"] == one["high"] == one["low_index"] == one["high_before"] == one["high_index"] == one["median"] == 2.0 and one["p"] == 0.0 and one["significant"]
    two = resampling.bootstrap_rules(spark.createDataFrame([(0.0,), (1.0,)], "delta double"), 400).first()
    assert (two["low_index"], two["high_before"], two["high_index"]) == (0.0, 1.0, 1.0) and two["p"] <= 1.0 and not two["significant"]


def test_token_spans(spark):
    tokens = [(0, 4), (4, 6), (6, 9), (9, 9), (9, 12)]
    spans = {(4, 9): (1, 2, None), (4, 12): (1, 4, "tokens apart"), (0, 4): (0, 0, "begins before the first predicted token"), (5, 9): (2, 2, "token crosses the border"), (12, 15): (None, None, "no token"), (9, 12): (4, 4, None)}
    df = spark.createDataFrame([(tokens, a, b) for a, b in spans], "t array<struct<start: int, end: int>>, a int, b int")
    for r in df.select("a", "b", credit.token_span(F.col("t"), F.col("a"), F.col("b")).alias("s")).collect():
        first, last, fault = spans[r["a"], r["b"]]
        assert tuple(r["s"]) == ((first, last, None) if fault is None else (None, None, fault))


def test_token_advantages(spark):
    tokens = [(k, k + 1) for k in range(8)]
    act = lambda tool, a, b, u, done=True: (0, tool, done, a, b, u)
    rows = [
        ("g", "1", 1.0, tokens, [0, 1, 1, 1, 1, 1, 0], [1, 0, 0, 0, 0, 0, 1], [act("text_search", 2, 4, 0.5), act("image_search", 4, 5, 1.0), act("text_search", 5, 6, -2.0), act("text_search", 1, 8, 9.0, False)]),
        ("g", "2", 3.0, tokens, [1] * 7, [0] * 7, []), ("h", "3", 5.0, tokens, [1] * 7, [1] * 7, []), ("h", "4", 5.0, tokens, [1] * 7, [0] * 6, []), ("h", "5", 5.0, tokens, [1] * 7, [0] * 7, [act("text_search", 0, 3, 1.0)]),
        ("i", "6", 5.0, tokens, [1] * 7, [0] * 7, None),
    ]
    action = "array<struct<turn: int, tool: string, executed: boolean, start: bigint, end: bigint, utility: double>>"
    df = spark.createDataFrame(rows, f"group string, rollout string, terminal_reward double, tokens array<struct<start: bigint, end: bigint>>, policy_mask array<int>, information_mask array<int>, actions {action}")
    got = {r["rollout"]: r for r in credit.token_advantages(df).collect()}
    t = -1 / (1 + 1e-6)
    assert got["1"]["advantages"] == pytest.approx([0, 0.7 * t + 0.15, 0.7 * t + 0.15, t, 0.7 * t, t, 0]) and got["2"]["advantages"] == pytest.approx([-t] * 7)
    assert [got[k]["fault"] for k in "345"] == ["information in the policy's mask", "masks differ in length", "begins before the first predicted token"] and got["6"]["advantages"] == [0.0] * 7
