"""Builds of a bounded size copy no whole table, and account for every row of it."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import datasets as D
from quillspark.operators import exchange
from quillspark.operators import selection as S
from quillspark.operators import splits

ROWS = 12_000


@pytest.fixture()
def copied(monkeypatch):
    """Counts of the rows that each checkpoint wrote."""
    counts, settled = [], exchange.settled

    def counted(df):
        out = settled(df)
        counts.append(out.count())
        return out

    for module in (D, S, splits, exchange):
        monkeypatch.setattr(module, "settled", counted)
    return counts


@pytest.mark.parametrize("exact", [False, True])
def test_pool_datasets_copy_first_rows_alone(spark, copied, exact):
    routes = D.SCARCE_FIRST
    rows = [{"id": str(k), "route": routes[k % 4], "source": k // 3, "near": k * 7 % 5000} for k in range(ROWS)]
    pool = spark.createDataFrame(rows, "id string, route string, source long, near long").repartition(8)
    exposed = [r for r in rows if r["source"] % 50 == 7]
    ranges = {r: (10, 10, 40) for r in routes}
    exposed_keys = ["source", "near"] if exact else ["source"]
    build = D.pool_dataset(pool, pool.where("source % 50 = 7"), ["source", "near"], exposed_keys, ranges, 80, "t", exact)
    known = {k: {r[k] for r in exposed} for k in exposed_keys}
    got = {r["id"]: r["reason"] for r in build.decisions.collect()}
    taken = {r["id"] for r in build.taken.collect()}
    assert len(got) == ROWS and taken == {k for k, reason in got.items() if reason is None}
    assert {k for k, reason in got.items() if reason == "exposed"} == {r["id"] for r in rows if any(r[k] in known[k] for k in exposed_keys)}
    assert max(copied) < ROWS / 4


def test_availability_counts_all_where_first_rows_do_not_do(spark, monkeypatch):
    monkeypatch.setattr(S, "PREFIX", 10)
    pool = spark.createDataFrame([(k, "a" if k < 900 else "b", k // 2) for k in range(1000)], "id long, route string, source long")
    free = lambda rows: rows.where(F.col("source") >= 440)
    assert D.availability(pool, ["source"], {"a": 40, "b": 40, "c": 40}, free) == {"a": 10, "b": 40, "c": 0}


@pytest.mark.parametrize("few", [D.FEW, 10])
def test_prompt_pools_copy_first_rows_alone(spark, copied, monkeypatch, few):
    monkeypatch.setattr(D, "FEW", few)
    # Of ten rows two share a uid; in the order of ids the other of them is the last where nth is greater.
    rows = [{"id": f"{k:05d}", "uid": str(k - 1 if k % 10 == 3 else k), "nth": -k if k % 20 == 3 else k, "category": "ab"[k % 3 > 1], "source": k // 3, "near": k % 700} for k in range(ROWS)]
    df = spark.createDataFrame(rows, "id string, uid string, nth long, category string, source long, near long").repartition(8)
    quotas = [(pool, c, n) for pool, n in (("dev", 5), ("train", 20)) for c in "ab"]
    build = D.prompt_pool(df, [("odd", F.col("source") % 11 == 1)], df.where("near % 5 = 0"), ["source", "near"], quotas, "t")
    last, sound = {}, [r for r in rows if r["source"] % 11 != 1]
    for r in sound:
        last[r["uid"]] = max(last.get(r["uid"], (-ROWS, "")), (r["nth"], r["id"]))
    one = [r for r in sound if last[r["uid"]][1] == r["id"]]
    old = {k: {r[k] for r in rows if r["near"] % 5 == 0} for k in ("source", "near")}
    held, want = {}, {}
    for pool, c, n in quotas:
        fit = [r for r in one if r["category"] == c and r["id"] not in want and (pool == "train" or not any(r[k] in old[k] for k in old))]
        fit = [r for r in fit if all(held.get((k, r[k]), pool) == pool for k in old)]
        for r in sorted(fit, key=lambda r: (hashlib.sha256(f"t:{r['uid']}".encode()).hexdigest(), r["uid"]))[:n]:
            want[r["id"]] = pool
            held |= {(k, r[k]): pool for k in old}
    assert {r["id"]: r["split"] for r in build.taken.collect()} == want and Counter(want.values()) == {"dev": 10, "train": 40}
    kept = {r["id"] for r in one}
    reason = {r["id"]: "odd" if r["source"] % 11 == 1 else "repeated" if r["id"] not in kept else None if r["id"] in want else "not_selected" for r in rows}
    got = [tuple(r) for r in build.decisions.select("id", "reason").collect()]
    assert len(got) == ROWS and dict(got) == reason
    assert max(copied) < ROWS / 3


def test_stages_of_a_share_cut_the_order_and_move_keys_alone(spark, monkeypatch):
    monkeypatch.setattr(S, "PREFIX", 10)
    rows = [{"id": k * 7919 % ROWS, "route": "abc"[k % 3], "x": k % 400, "y": k // 5} for k in range(ROWS)]
    df = spark.createDataFrame(rows, "id long, route string, x long, y long").withColumn("text", F.repeat(F.lit("t"), 50)).repartition(8)
    given, written, unique, settled = [], [], S.unique_on, splits.settled
    monkeypatch.setattr(S, "unique_on", lambda found, *rest: given.append(found.count()) or unique(found, *rest))
    monkeypatch.setattr(splits, "settled", lambda found: written.append(found.columns) or settled(found))
    quotas = {"a": 150, "b": 200, "c": 100}
    got = S.select_in_stages(df, ["y", "x"], [S.Stage(r, F.col("route") == r, [F.col("id")], n) for r, n in quotas.items()])
    want, used = [], {"x": set(), "y": set()}
    for route, n in quotas.items():
        nth = 0
        for r in sorted((r for r in rows if r["route"] == route), key=lambda r: r["id"]):
            if nth < n and all(r[k] not in used[k] for k in used):
                nth += 1
                want.append((r["id"], route, nth))
                for k in used:
                    used[k].add(r[k])
    assert sorted(map(tuple, got.select("id", "stage", "nth").collect())) == sorted(want)
    assert given[0] < ROWS / 6 and sum("text" in columns for columns in written) == len(given)
