"""Best of a group of vectors in blocks, and BM25 without pairs that are out: both equal the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval as R


def plain(v, asked):
    pairs = asked.join(v, "label").where("vec_id <> query_id").withColumn("score", F.round(R.cosine(F.col("q"), F.col("embedding")), 9))
    best = pairs.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("o"))).alias("b"))
    return best.select("query_id", (-F.col("b.o")).alias("vec_id"), F.col("b.score").alias("score"))


@pytest.mark.parametrize("odd", [False, True])
def test_nearest_of_group_in_blocks(spark, monkeypatch, odd):
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 20)
    rng = random.Random(3)
    some = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    rows = [(k, rng.choice(some) if k % 3 else [2 * x for x in some[k % 60]], k % 4 if k % 29 else None) for k in range(200)]
    rows += [(300, [1.0, 2.0], 0), (301, None, 0), (302, [None, 1.0, 1.0, 1.0, 1.0], 1), (303, None, 9), (304, some[0], 9), (305, some[1], 8)]
    rows += [(310, [float("nan")] * 5, 2), (311, [1e-200] * 5, 3)] if odd else []
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asked = v.where("vec_id % 5 <= 1 or vec_id > 299").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    if odd:
        asked = asked.where("query_id <> 311 and label <> 3")  # 0 by 0 is an error there
    assert sorted(map(repr, R.nearest_of_group(v, asked, "label").collect())) == sorted(map(repr, plain(v, asked).collect()))


@pytest.mark.parametrize("common", [0.1, 0.5])
def test_pruned_bm25_without_pairs(spark, common):
    rng = random.Random(8)
    words = [f"r{k}" for k in range(60)]
    docs = [(k, rng.choice(["a", "b", None]), " ".join(rng.choices(["the", "of", "and"], k=rng.randint(1, 12)) + rng.sample(words, rng.randint(0, 4)))) for k in range(150)]
    asked = [(k, "ab"[k % 2], " ".join(rng.choices(["the", "of"], k=2) + rng.sample(words, n))) for k, n in enumerate([0, 0, 1, 1, 2, 3, 5, 8])]
    d, q = spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(asked, "id long, own string, text string")
    tokens = lambda t: F.filter(F.split(t, " "), lambda w: w != "")
    scored = R.bm25(q, d, tokens, "id", "doc_id").cache()
    out = scored.where("doc_id % 3 = 0").select("id", "doc_id")
    apart = scored.join(d, "doc_id").join(q.select("id", "own"), "id").where("own <> source").select("id", "doc_id", "score")
    rows = lambda df: sorted((r["id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    got = R.bm25_top(q, d, tokens, "id", "doc_id", 3, common=common, without=out)
    assert rows(got) == rows(R.top_k(scored.join(out, ["id", "doc_id"], "left_anti"), "id", 3, "doc_id"))
    assert rows(R.bm25_top(q, d, tokens, "id", "doc_id", 3, common=common, apart=("own", "source"))) == rows(R.top_k(apart, "id", 3, "doc_id"))


def test_few_terms_shuffle_no_postings(spark, monkeypatch):
    """Sums of a query and a document are shuffled, postings are not; where terms are many, rows are the same."""
    d = spark.createDataFrame([(k, f"w{k % 7} w{k % 5} the") for k in range(60)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "w1 w2 the"), (2, "w6")], "id long, text string")
    tokens = lambda t: F.split(t, " ")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = R.bm25(q, d, tokens, "id", "doc_id")
    assert "SortMergeJoin" not in plan(found) and "BroadcastHashJoin" in plan(found)
    rows = lambda: [sorted(map(tuple, x.collect())) for x in (R.bm25(q, d, tokens, "id", "doc_id"), R.bm25_top(q, d, tokens, "id", "doc_id", 3))]
    few = rows()
    monkeypatch.setattr(R, "FEW", 1)
    assert rows() == few and all(few)
