"""Operators whose groups may be large, against plain sequential versions on small data."""

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillspark.operators import exchange, grouping, retrieval
from quillspark.operators import splits as S
from quillspark.operators import statistics as T


def test_grouped_rank(spark):
    random.seed(1)
    rows = [(random.choice("aab"), random.randrange(50), i) for i in range(400)] + [(None, 1, 999)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {r["id"]: r["rank"] for r in exchange.grouped_rank(df, ["g"], [F.col("v"), F.col("id")]).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        for k, (_, i) in enumerate(sorted((v, i) for x, v, i in rows if x == g), 1):
            expected[i] = k
    assert got == expected


def test_exact_quantiles(spark):
    random.seed(2)
    rows = [(k % 3, random.random() * 100) for k in range(301)] + [(7, 5.0), (8, None)]
    found = T.exact_quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", {"near": (0.95, "nearest"), "mid": (0.5, "linear"), "low": (0.1, "linear")})
    for r in found.collect():
        values = sorted(v for g, v in rows if g == r["g"])
        at = lambda q: values[0] if len(values) == 1 else values[int(q * (len(values) - 1))] + (q * (len(values) - 1) % 1) * (values[min(len(values) - 1, int(q * (len(values) - 1)) + 1)] - values[int(q * (len(values) - 1))])  # noqa: B023, E731
        assert r["near"] == values[math.ceil(0.95 * len(values)) - 1] and abs(r["mid"] - statistics.median(values)) < 1e-9 and abs(r["low"] - at(0.1)) < 1e-9


def test_skew_join_stands_clashing_names(spark):
    left = spark.createDataFrame([(1, "a", 5, 6), (None, "b", 7, 8), (3, "c", 9, 9)], "id int, x string, _skew_key int, _right_id int")
    right = spark.createDataFrame([(1, "u"), (None, "v")], "id int, y string")
    assert sorted(map(tuple, exchange.skew_join(left, right, ["id"], "left").collect()), key=str) == sorted([(1, "a", 5, 6, "u"), (None, "b", 7, 8, "v"), (3, "c", 9, 9, None)], key=str)
    assert exchange.skew_join(left, right, ["id"], "left_anti").collect()[0]["x"] == "c"


@pytest.mark.parametrize("target", [40, 60, 90, 130, 200])
def test_plans_are_the_best_of_all(target):
    available = {"a": 55, "b": 80, "c": 35}
    ranges = {"a": (0, 25, 60), "b": (10, 40, 90), "c": (0, 15, 40)}
    spans = [range(lo, min(hi, available[n]) + 1, 10) for n, (lo, _, hi) in ranges.items()]
    off = lambda plan: sum(abs(x - ranges[n][1]) for n, x in zip(ranges, plan, strict=True))
    every = [p for p in itertools.product(*spans) if sum(p) == target]
    got = S.best_plan(available, ranges, target)
    if not every:
        assert got is None
    else:
        assert sum(got.values()) == target and off(got.values()) == min(map(off, every)) and tuple(got.values()) in every


def test_shard_cover_is_the_greedy_one(spark):
    random.seed(3)
    shards = [(f"s{k:02d}", {random.randrange(30) for _ in range(random.randint(1, 9))}, random.randint(1, 5)) for k in range(40)]
    held = spark.createDataFrame([(s, m) for s, members, _ in shards for m in members], "shard string, member int")
    sizes = spark.createDataFrame([(s, n) for s, _, n in shards], "shard string, bytes int")
    assert S.shard_cover(held, sizes, 6) == S.greedy_cover(shards, 6)


def test_group_split_keeps_groups_whole_and_shares(spark):
    random.seed(4)
    groups = spark.createDataFrame([(f"g{k}", random.randint(1, 30)) for k in range(3000)] + [("big", 5000)], "group string, n long")
    got = S.group_split(groups, {"train": 0.8, "test": 0.1, "dev": 0.1}, "x", large=100).collect()
    total, sums = sum(r["n"] for r in got), {}
    for r in got:
        sums[r["split"]] = sums.get(r["split"], 0) + r["n"]
    assert len(got) == 3001 and len({r["group"] for r in got}) == 3001
    assert all(abs(sums[k] / total - v) < 0.02 for k, v in {"train": 0.8, "test": 0.1, "dev": 0.1}.items())


def test_quota_epoch_fills_quotas(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(50)], "id long, s string")
    got = S.quota_epoch(df, "s", {"a": 30, "b": 20, "c": 4}, "e", "id").collect()
    assert {s: sum(r["times"] for r in got if r["s"] == s) for s in "ab"} == {"a": 30, "b": 20} and {r["times"] for r in got if r["s"] == "a"} == {4, 5}


def test_mcnemar_against_all_terms(spark):
    cases = [(0, 0), (1, 0), (3, 9), (10, 10), (40, 61), (700, 800), (5, 2000)]
    df = spark.createDataFrame(cases, "x long, y long")
    for r in df.select("x", "y", T.mcnemar_p("x", "y").alias("p")).collect():
        n = r["x"] + r["y"]
        exact = min(1.0, 2 * sum(math.comb(n, k) for k in range(min(r["x"], r["y"]) + 1)) / 2**n) if n else 1.0
        assert abs(r["p"] - exact) < 1e-9


def test_bootstrap_agrees_with_the_normal_interval(spark):
    random.seed(5)
    rows = [(i, "u" if i % 2 else "v", random.gauss(0.3 if i % 2 else 0.0, 1)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string, delta double")
    for r in T.bootstrap_interval(df, samples=400, by=("g",)).collect():
        x = [d for _, g, d in rows if g == r["g"]]
        mean, half = statistics.mean(x), 1.96 * statistics.stdev(x) / len(x) ** 0.5
        assert abs(r["mean"] - mean) < 1e-9 and abs(r["low"] - (mean - half)) < half / 4 and abs(r["high"] - (mean + half)) < half / 4
        assert (r["p"] < 0.01) == (r["g"] == "u")
    whole = T.bootstrap_interval(df, samples=100).collect()
    assert len(whole) == 1 and whole[0]["low"] < whole[0]["mean"] < whole[0]["high"]


@pytest.mark.parametrize("crowd", [3, 2048])
def test_similar_pairs_are_those_of_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(grouping, "CROWD", crowd)
    random.seed(6)
    base = [[f"w{random.randrange(400)}" for _ in range(20)] for _ in range(15)]
    rows = [(k * 10 + j, (b if j < 2 else [w if random.random() > 0.08 else f"x{random.randrange(9)}" for w in b]) + ["common"]) for k, b in enumerate(base) for j in range(6)] + [(1000, []), (1001, ["common"])]
    pairs, member = grouping.similar_pairs(spark.createDataFrame(rows, "id long, s array<string>"), "id", "s", 0.8)
    sets = {i: frozenset(s) for i, s in rows if s}
    same = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    assert {r["id"]: r["same"] for r in member.collect()} == same
    ones = sorted(set(same.values()))
    expected = {(a, b) for a in ones for b in ones if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == expected and expected


def test_similar_across_is_that_of_all_pairs(spark):
    random.seed(7)
    left = [(k, [f"w{random.randrange(60)}" for _ in range(14)]) for k in range(20)]
    right = [(100 + 10 * k + j, [w if random.random() > 0.04 * j else f"y{random.randrange(9)}" for w in s]) for k, s in left for j in range(5)] + [(999, [])]
    got = {(r["a"], r["b"]) for r in grouping.similar_across(spark.createDataFrame(left, "id long, s array<string>"), spark.createDataFrame(right, "id long, s array<string>"), 0.8, 3).collect()}
    expected = set()
    for a, s in left:
        near = [(-len(set(s) & set(t)) / len(set(s) | set(t)), b) for b, t in right if t and set(s) != set(t)]
        expected |= {(a, b) for x, b in sorted(x for x in near if x[0] <= -0.8)[:3]}
    assert got == expected and expected


def test_first_of_each_and_components(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, None, 1), (4, None, 9)], "id int, k string, v int")
    assert {r["id"] for r in grouping.first_of_each(df, ["k"], ["v"]).collect()} == {2, 3}
    assert {r["id"] for r in grouping.first_of_each(df, ["k"], ["v"], last=True).collect()} == {1, 4}
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 7), (9, 8)], "a long, b long")
    assert {r["id"]: r["component"] for r in grouping.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 8, 9: 8}


@pytest.mark.parametrize("common", [0.1, 0.5, 1.0])
def test_pruned_bm25_is_the_whole_one(spark, common):
    """Queries of rare words are pruned, those of common words alone are scored in full; the best are the same."""
    random.seed(8)
    words = [f"r{k}" for k in range(60)]
    docs = [(k, " ".join(random.choices(["the", "of", "and"], k=random.randint(1, 12)) + random.sample(words, random.randint(0, 4)))) for k in range(150)]
    asked = [(k, " ".join(random.choices(["the", "of"], k=2) + random.sample(words, n))) for k, n in enumerate([0, 0, 1, 1, 2, 3, 5, 8])] + [(90, "unknown"), (91, ""), (92, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "id long, text string")
    tokens = lambda t: F.filter(F.split(t, " "), lambda w: w != "")
    best = sorted((r["id"], r["rank"], r["doc_id"], r["score"]) for r in retrieval.top_k(retrieval.bm25(q, d, tokens, "id", "doc_id"), "id", 3, "doc_id").collect())
    got = sorted((r["id"], r["rank"], r["doc_id"], r["score"]) for r in retrieval.bm25_top(q, d, tokens, "id", "doc_id", 3, common=common).collect())
    assert got == best and len(got) > 20
