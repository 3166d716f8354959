"""Bounded selections are found among the first rows, and are those of the whole table."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import selection as S


def greedy(rows, keys, order, wanted, used):
    taken, seen = [], {k: {r[k] for r in used} for k in keys}
    for r in sorted(rows, key=order):
        if len(taken) < wanted and all(r[k] not in seen[k] for k in keys):
            taken.append(r)
            for k in keys:
                seen[k].add(r[k])
    return taken


@pytest.mark.parametrize("crowded", [False, True])
def test_stages_from_prefixes(spark, monkeypatch, crowded):
    # Crowded: the first 3,000 rows in order share one key, so that the first prefix does not do.
    rows = [{"id": k, "a": 0 if crowded and k < 3000 else k % 1500, "b": k // 2} for k in range(6000)]
    df = spark.createDataFrame(rows, "id long, a long, b long").repartition(8)
    monkeypatch.setattr(S, "PREFIX", 20_000)
    calls, whole = [], S.unique_on
    monkeypatch.setattr(S, "unique_on", lambda found, *rest: calls.append(found.count()) or whole(found, *rest))
    stages = [S.Stage("even", F.col("id") % 2 == 0, [F.col("id")], 9), S.Stage("odd", F.col("id") % 2 == 1, [-F.col("id")], 7)]
    got = S.select_in_stages(df, ["a", "b"], stages)
    even = greedy([r for r in rows if r["id"] % 2 == 0], ["a", "b"], lambda r: r["id"], 9, [])
    odd = greedy([r for r in rows if r["id"] % 2], ["a", "b"], lambda r: -r["id"], 7, even)
    assert sorted((r["stage"], r["nth"], r["id"]) for r in got.collect()) == sorted([("even", k, r["id"]) for k, r in enumerate(even, 1)] + [("odd", k, r["id"]) for k, r in enumerate(odd, 1)])
    assert len(calls) > 2 if crowded else max(calls) < 1100


def test_beyond_prefixes_all_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "PREFIX", 10)
    df = spark.createDataFrame([(k, k % 3) for k in range(50)], "id long, a long")
    got = S.select_in_stages(df, ["a"], [S.Stage("all", F.lit(True), [F.col("id")], 5)]).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2]
    pools = S.isolated_pools(df, ["a"], [("x", S.Stage("s", F.col("a") == 0, [F.col("id")], 2)), ("y", S.Stage("s", F.lit(True), [F.col("id")], 40))], "id").collect()
    assert sorted(r["id"] for r in pools if r["pool"] == "x") == [0, 3] and sorted(r["id"] for r in pools if r["pool"] == "y") == [k for k in range(50) if k % 3]
