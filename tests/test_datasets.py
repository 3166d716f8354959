"""Dataset builders: every row accounted for, quotas and splits exact, no key shared; the plan against full search."""

import hashlib
import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from quillspark.operators import datasets as D
from quillspark.operators import selection as S
from quillspark.plans import datasets as P
from tests.oracle import SF_DIR


@pytest.fixture(scope="module")
def table(spark):
    return lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet")


def test_plan_is_the_best_of_all():
    random.seed(1)
    text, both, direct, image = D.SCARCE_FIRST
    for _ in range(300):
        available = {r: random.randrange(120) for r in D.SCARCE_FIRST}
        ranges = {direct: (0, 30, 60), image: (0, 30, 80), text: (0, random.randrange(50), 50), both: (0, random.randrange(40), 30)}
        target = random.randrange(0, 300, 10)
        found = []
        for t, b, d, i in product(range(0, 60, 10), range(0, 50, 10), range(0, 70, 10), range(0, 90, 10)):
            n = {text: t, both: b, direct: d, image: i}
            if d + 2 * i + 2 * t + 3 * b == target and all(n[r] <= available[r] and ranges[r][0] <= n[r] <= ranges[r][2] for r in n) and t <= ranges[text][1] and b <= ranges[both][1]:
                found.append(((-t, -b, abs(d - 30), abs(d - i), d), n))
        assert D.route_plan(available, ranges, target) == (min(found, key=lambda x: x[0])[1] if found else None)


@pytest.mark.parametrize("exact", [False, True])
def test_pool_datasets(spark, table, exact):
    pool, build = P._pool(table).cache(), P.pool_build(table, exact)
    taken = [r for r in S.skew_join(build.taken.select("id", "split"), pool, ["id"], "inner").collect()]
    steps = Counter()
    for r in taken:
        steps[r["split"]] += D.ROUTE_STEPS[r["route"]]
    assert sum(steps.values()) == 200 and (not exact or steps["test"] == steps["dev"] == 20)
    for k in P.KEYS:
        assert len({r[k] for r in taken}) == len(taken)
    if not exact:
        by_route = Counter((r["route"], r["split"]) for r in taken)
        sizes = Counter(r["route"] for r in taken)
        assert all(by_route[r, "train"] == n * 8 // 10 and by_route[r, "dev"] == n // 10 for r, n in sizes.items())
    exposed = pool.where("source % 50 = 7").collect()
    for k in P.KEYS if exact else P.KEYS[:2]:
        assert not {r[k] for r in taken} & {r[k] for r in exposed}
    decisions = {r["id"]: r["reason"] for r in build.decisions.collect()}
    assert len(decisions) == pool.count() and {i for i, why in decisions.items() if why is None} == {r["id"] for r in taken} and set(decisions.values()) == {None, "exposed", "not_selected"}
    assert D.unfolded(build.taken).count() == 200


def test_routed_datasets(spark, table):
    records = P._records(table)
    build = P.first_dataset(table)
    taken = {r["id"]: r["route"] for r in build.taken.collect()}
    category = {r["id"]: r["category"] for r in records.collect()}
    assert all((category[i] == "search_free") == (r == "direct_answer") for i, r in taken.items()) and all(n <= P.QUOTAS[r] for r, n in Counter(taken.values()).items())
    assert Counter(taken.values())["direct_answer"] == min(8, sum(c == "search_free" for c in category.values()))
    attempts = [(r["id"], r["route"], r["reason"]) for r in build.decisions.collect()]
    assert {i for i, _, _ in attempts} == set(category) and {(i, r) for i, r, why in attempts if why is None} == set(taken.items())
    assert {i for i, _, why in attempts if why == "unattempted"} == {i for i, c in category.items() if c == "other"}
    previous = build.taken.select("id", "route")
    more = D.routed_dataset(records, P._shown(table), P._corpus(table), {"direct_answer": 10}, "x", previous)
    again = {r["id"]: r["route"] for r in more.taken.collect()}
    assert taken.items() <= again.items() and Counter(again.values())["direct_answer"] == min(10, sum(c == "search_free" for c in category.values()))
    with pytest.raises(ValueError, match="has"):
        D.routed_dataset(records, P._shown(table), P._corpus(table), {"direct_answer": 10_000}, "x", allow_shortfall=False)


def test_prompt_pools(spark, table):
    build = P.prompt_build(table)
    decisions = build.decisions.collect()
    taken = {r["id"]: (r["split"], r["route"]) for r in build.taken.collect()}
    assert len(decisions) == table("lineitem").count() and {r["id"] for r in decisions if r["reason"] is None} == set(taken)
    assert {"no_image", "no_results", "not_selected"} <= {r["reason"] for r in decisions}
    assert all(n <= {"dev": 40, "audit": 40, "train": 300}[s] for (s, _), n in Counter(taken.values()).items())
    rows = P._candidates(table).withColumn("image", F.concat_ws("/", F.col("entity") % 17, F.col("source"))).withColumn("near", F.col("source") % 997)
    placed = S.skew_join(rows.drop("route"), build.taken.select("id", "split"), ["id"], "inner")
    assert S.shared_values(placed, "split", P.POOL_KEYS).isEmpty()


def test_format_views(spark, table):
    build, pool = P.view_build(table), {r["id"]: r for r in P._pool(table).withColumn("near", F.col("source") % 997).where("route is not null").collect()}
    known = {"train": {r["source"] for r in pool.values() if r["source"] % 3}, "dev": {r["source"] for r in pool.values() if r["source"] % 4 < 3}}
    banned = [r for r in pool.values() if r["source"] not in known["train"] | known["dev"]]
    gone = {k: {r[k] for r in banned} for k in P.KEYS}
    allowed = [r for r in pool.values() if all(r[k] not in gone[k] for k in P.KEYS)]
    used, want = {k: set() for k in P.KEYS}, {}
    for split, route, n in P.VIEW:
        other = "train" if split == "dev" else "dev"
        tier = lambda r: 0 if r["source"] in known[split] else 2 if r["source"] in known[other] else 1  # noqa: E731, B023
        taken = 0
        for r in sorted((r for r in allowed if r["route"] == route), key=lambda r: (tier(r), hashlib.sha256(f"v6:{split}:{r['id']}".encode()).hexdigest(), r["id"])):
            if taken < n and all(r[k] not in used[k] for k in P.KEYS):
                taken += 1
                want[r["id"]] = split
                for k in P.KEYS:
                    used[k].add(r[k])
    assert {r["id"]: r["split"] for r in build.taken.collect()} == want
    reasons = Counter(r["reason"] for r in build.decisions.collect())
    assert sum(reasons.values()) == len(pool) and reasons[None] == len(want) and reasons["forbidden"] == len(pool) - len(allowed)
