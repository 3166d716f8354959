"""Exact quotas, components and tiers against the sequential rules they state."""

import copy
import hashlib
import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from quillspark.functions.hashing import digest
from quillspark.operators import selection as S
from quillspark.plans import registry
from tests.oracle import SF_DIR

SPLITS = ("train", "dev", "test")


def hashed(seed, x):
    return hashlib.sha256(f"{seed}:{x}".encode()).hexdigest()


def test_quotas_are_those_of_full_search():
    random.seed(1)
    for _ in range(1500):
        targets = {k: random.randrange(40) for k in ("dev", "test", "train")}
        total = sum(targets.values())
        ones = total - 2 * random.randrange(total // 2 + 1)
        found = []
        for dev, test in product(range(targets["dev"] % 2, min(ones, targets["dev"]) + 1, 2), range(targets["test"] % 2, min(ones, targets["test"]) + 1, 2)):
            train = ones - dev - test
            if 0 <= train <= targets["train"] and (targets["train"] - train) % 2 == 0:
                n = {"dev": dev, "test": test, "train": train}
                found.append((sum(abs(n[k] - ones * targets[k] / (total or 1)) for k in ("dev", "test", "train")), dev, test))
        if found:
            assert tuple(S.one_step_quotas(targets, ones).values())[:2] == min(found)[1:]
        else:
            with pytest.raises(ValueError):
                S.one_step_quotas(targets, ones)


def test_exact_weights_are_found_when_there_are_any():
    random.seed(2)
    for _ in range(1500):
        counts = {random.randrange(1, 9): random.randrange(1, 6) for _ in range(3)}
        target = random.randrange(sum(w * n for w, n in counts.items()) + 3)
        possible = any(sum(w * k for w, k in zip(counts, ks, strict=True)) == target for ks in product(*[range(n + 1) for n in counts.values()]))
        got = S.exact_counts(counts, target)
        assert (got is not None) == possible
        assert got is None or sum(w * n for w, n in got.items()) == target and all(0 <= n <= counts[w] for w, n in got.items())
    assert S.exact_counts({1: 10**6, 2: 10**6, 3: 10**6}, 600_000) == {3: 100_000, 2: 100_000, 1: 100_000}


def test_classes_are_placed_like_single_components():
    random.seed(3)
    for _ in range(1500):
        routes = "ab"[: random.randrange(1, 3)]
        room = {r: {s: random.randrange(30) for s in SPLITS} for r in routes}
        kind, n = {r: random.randrange(1, 4) for r in routes}, random.randrange(12)
        one, other, order = copy.deepcopy(room), copy.deepcopy(room), []
        for _ in range(n):
            fit = [s for s in SPLITS if all(one[r][s] >= c for r, c in kind.items())]
            if not fit:
                order = None
                break
            s = max(fit, key=lambda s: (sum(one[r][s] for r in kind), -SPLITS.index(s)))
            for r, c in kind.items():
                one[r][s] -= c
            order.append(s)
        if order is None:
            with pytest.raises(ValueError):
                S.place_class(kind, n, other, SPLITS)
        else:
            steps = sorted((-(p.score - sum(kind.values()) * j), p.order, p.split) for p in S.place_class(kind, n, other, SPLITS) for j in range(p.n))
            assert one == other and [s for *_, s in steps] == order


def test_component_splits(spark):
    random.seed(4)
    rows = [(k, random.choice("xy"), random.randrange(500), random.choice([None, *range(400)])) for k in range(420)]
    by_route = Counter(r for _, r, *_ in rows)
    rows = [row for row in rows if row[0] < 400 or by_route[row[1]]]
    counts, kept = Counter(), []
    limit = {r: n - n % 10 for r, n in by_route.items()}
    for row in rows:
        if counts[row[1]] < limit[row[1]]:
            counts[row[1]] += 1
            kept.append(row)
    df = spark.createDataFrame(kept, "id long, route string, entity long, near long").repartition(4)
    shares = {"train": (8, 10), "dev": (1, 10), "test": (1, 10)}
    got = {r["key"]: (r["component"], r["split"]) for r in S.component_splits(df, "id", "route", ["entity", "near"], shares, "q").collect()}
    up = {str(i): str(i) for i, *_ in kept}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for at in (2, 3):
        first = {}
        for row in kept:
            if row[at] is not None:
                a, b = root(str(row[0])), root(first.setdefault(row[at], str(row[0])))
                up[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i, r, *_ in kept:
        members[root(str(i))].append(r)
    assert {k: c for k, (c, _) in got.items()} == {str(i): root(str(i)) for i, *_ in kept}
    room = {r: {s: counts[r] * a // b for s, (a, b) in shares.items()} for r in counts}
    for name in sorted(members, key=lambda c: (-len(members[c]), sorted(Counter(members[c]).items()), hashed("q", c), c)):
        kind = Counter(members[name])
        split = max([s for s in SPLITS if all(room[r][s] >= n for r, n in kind.items())], key=lambda s: (sum(room[r][s] for r in kind), -SPLITS.index(s)))
        for r, n in kind.items():
            room[r][split] -= n
        assert {got[str(i)][1] for i, *_ in kept if root(str(i)) == name} == {split}
    assert all(n == 0 for r in room.values() for n in r.values())
    with pytest.raises(ValueError, match="divide"):
        S.component_splits(df.where("id > 3"), "id", "route", ["entity"], shares, "q")


def greedy(rows, keys, stages, most=None):
    used, out = [set() for _ in keys], []
    for name, where, order, count in stages:
        nth = 0
        for row in sorted(filter(where, rows), key=order):
            if count is not None and nth >= count or most is not None and len(out) >= most:
                break
            if all(row[k] is None or row[k] not in u for k, u in zip(keys, used, strict=True)):
                nth += 1
                out.append((row["id"], name, nth))
                for k, u in zip(keys, used, strict=True):
                    u.add(row[k])
    return sorted(out)


@pytest.fixture(scope="module")
def candidates(spark):
    random.seed(5)
    rows = [{"id": str(k), "route": random.choice("ab"), "x": random.randrange(90), "y": random.randrange(120), "z": random.randrange(70)} for k in range(500)]
    return rows, spark.createDataFrame(rows, "id string, route string, x long, y long, z long").repartition(5)


def test_stages_take_what_the_sequential_rule_takes(candidates):
    rows, df = candidates
    tier = F.when(F.col("x") % 3 == 0, 0).otherwise(1)
    order = [tier, digest("t", F.col("id")), F.col("id")]
    stages = [S.Stage("one", F.col("route") == "a", order, 20), S.Stage("two", F.col("route") == "b", order, None), S.Stage("three", F.lit(True), order, 5)]
    plain = lambda r: (0 if r["x"] % 3 == 0 else 1, hashed("t", r["id"]), r["id"])
    told = [("one", lambda r: r["route"] == "a", plain, 20), ("two", lambda r: r["route"] == "b", plain, None), ("three", lambda r: True, plain, 5)]
    for most in (None, 30):
        got = S.select_in_stages(df, ["x", "y", "z"], stages, most).select("id", "stage", "nth").collect()
        assert sorted(map(tuple, got)) == greedy(rows, ["x", "y", "z"], told, most)
    with pytest.raises(ValueError, match="one has"):
        S.select_in_stages(df, ["x"], [S.Stage("one", F.col("route") == "a", order, 400)], strict=True)
    assert S.select_in_stages(df.limit(0), ["x"], stages).count() == 0


def test_pools_share_nothing(candidates):
    rows, df = candidates
    order = [digest("p", F.col("id")), F.col("id")]
    stages = [(pool, S.Stage(route, (F.col("route") == route) & ((F.lit(pool) == "train") | (F.col("x") % 4 != 0)), order, n)) for pool, n in (("dev", 15), ("audit", 10), ("train", 1000)) for route in "ab"]
    got = S.isolated_pools(df, ["x", "y"], stages, "id")
    owner, used, want = [{}, {}], set(), set()
    for pool, n in (("dev", 15), ("audit", 10), ("train", 1000)):
        for route in "ab":
            fit = [r for r in rows if r["id"] not in used and r["route"] == route and (pool == "train" or r["x"] % 4) and owner[0].get(r["x"]) in (None, pool) and owner[1].get(r["y"]) in (None, pool)]
            for r in sorted(fit, key=lambda r: (hashed("p", r["id"]), r["id"]))[:n]:
                used.add(r["id"])
                want.add((r["id"], pool, route))
                owner[0][r["x"]] = owner[1][r["y"]] = pool
    assert {(r["id"], r["pool"], r["stage"]) for r in got.collect()} == want
    assert S.shared_values(got, "pool", ["x", "y"]).isEmpty() and not S.shared_values(got, "pool", ["z"]).isEmpty()


def test_weighted_splits(spark):
    random.seed(6)
    rows = [(k, random.choice([1, 1, 2, 3])) for k in range(300)]
    df, total = spark.createDataFrame(rows, "id long, steps long"), sum(w for _, w in rows)
    got = {r["id"]: r["split"] for r in S.exact_weight_splits(df, "steps", "id", "v", {"test": total // 10, "dev": total // 7}, "train").collect()}
    sums = Counter()
    for k, w in rows:
        sums[got[k]] += w
    assert len(got) == 300 and (sums["test"], sums["dev"]) == (total // 10, total // 7)
    for split in ("test",):  # of each weight, those first in the seeded order
        for w in (1, 2, 3):
            order = sorted((k for k, x in rows if x == w), key=lambda k: (hashed("v", k), k))
            chosen = {k for k in order if got[k] == split}
            assert chosen == set(order[: len(chosen)])
    with pytest.raises(ValueError):
        S.take_exact_weight(spark.createDataFrame([(1, 2), (2, 4)], "id long, steps long"), "steps", "id", "v", 3)


def test_registered_splits_are_exact(spark):
    found = registry.QUERIES["spl06_spl07_exact_weight_splits"](spark, SF_DIR).groupBy("split").agg(F.sum("steps").alias("w")).collect()
    weights = {r["split"]: r["w"] for r in found}
    assert weights["test"] == weights["dev"] == sum(weights.values()) // 10
    for r in registry.QUERIES["spl05_component_splits"](spark, SF_DIR).groupBy("component").agg(F.count_distinct("split").alias("n")).collect():
        assert r["n"] == 1
