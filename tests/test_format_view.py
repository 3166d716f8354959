"""The format view: what is forbidden, taken and left, and that rows that a key of few values forbids are not shuffled."""

import hashlib
import random

import pytest

from quillspark.operators import datasets

KEYS, QUOTAS = ["source", "entity", "near"], [("dev", "a", 3), ("train", "a", 6), ("train", "b", 50)]


def pool():
    rng = random.Random(2)
    some = lambda n: rng.choice([None, *range(n)])
    return [(f"r{k}", rng.choice("ab"), rng.choice([None, *range(60)] if k % 40 == 0 else range(60)), some(400), some(500)) for k in range(300)]


def brute(rows, train, dev):
    strange = [r for r in rows if r[2] not in train | dev]
    gone = {k: {r[i] for r in strange if r[i] is not None} for i, k in enumerate(KEYS, 2)}
    allowed = [r for r in rows if r not in strange and not any(r[i] in gone[k] for i, k in enumerate(KEYS, 2))]
    used, taken = {k: set() for k in KEYS}, {}
    for split, route, n in QUOTAS:
        own, other = (dev, train) if split == "dev" else (train, dev)
        turn = lambda r, split=split, own=own, other=other: (0 if r[2] in own else 2 if r[2] in other else 1, hashlib.sha256(f"s:{split}:{r[0]}".encode()).hexdigest(), r[0])
        for r in sorted((r for r in allowed if r[1] == route), key=turn):
            if n and not any(r[i] in used[k] for i, k in enumerate(KEYS, 2) if r[i] is not None):
                n -= 1
                taken[r[0]] = (route, split)
                for i, k in enumerate(KEYS, 2):
                    used[k].add(r[i])
    return taken, {r[0]: None if r[0] in taken else "not_selected" if r in allowed else "forbidden" for r in rows}


@pytest.mark.parametrize("few", [100_000, 0])
def test_view_is_that_of_the_rule(spark, monkeypatch, few):
    monkeypatch.setattr(datasets, "FEW", few)
    rows, train, dev = pool(), {*range(0, 40), None}, {*range(20, 57)}
    df = spark.createDataFrame(rows, "id string, route string, source long, entity long, near long")
    named = lambda x: spark.createDataFrame([(s,) for s in x for _ in range(2)], "source long")
    build = datasets.format_view(df, named(train), named(dev), KEYS, QUOTAS, "s", strict=False)
    taken, reasons = brute(rows, train, dev)
    assert {r["id"]: (r["route"], r["split"]) for r in build.taken.collect()} == taken and len(taken) > 20
    got = build.decisions.collect()
    assert len(got) == len(rows) and {r["id"]: r["reason"] for r in got} == reasons and len(set(reasons.values())) == 3
    assert {r["id"]: r["route"] for r in got} == {r[0]: r[1] for r in rows}


def test_rows_that_few_values_forbid_are_not_shuffled(spark):
    n = 40_000
    df = spark.range(n).selectExpr("concat('a-long-name-', id) AS id", "'a' AS route", "id AS source", "id % 9000 AS entity", "id % 5 AS near")
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that are not small
    spark.sparkContext.setJobGroup("view", "")
    build = datasets.format_view(df, df.where("source % 7 <> 0"), df.where("source % 11 = 1"), KEYS, QUOTAS, "s", strict=False)
    rows = [tuple(r) for r in datasets.accounted(build).collect()]
    spark.sparkContext.setJobGroup("", "")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stages = {s for job in tracker.getJobIdsForGroup("view") for s in tracker.getJobInfo(job).stageIds}
    assert rows == [("a", None, "forbidden", n)] and sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages) < 3.2e6
