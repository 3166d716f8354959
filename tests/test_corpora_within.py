"""Corpora of their own: those of a task's size are scored there, larger ones by joins, to the same scores, and terms are not shuffled for the former."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval

split = lambda text: F.filter(F.split(text, " "), lambda t: t != "")


def rows(n=40, length=12):
    rng = random.Random(9)
    line = lambda m: " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(m))
    docs = [(1000 + k, k % 5, line(rng.randint(1, length))) for k in range(n)] + [(2000, 1, ""), (2001, 1, None), (2002, None, "w1"), (2003, 7, "w1")]
    asked = [(k, k % 6, line(4)) for k in range(12)] + [(50, 2, ""), (51, 2, None), (52, None, "w1"), (53, 1, "w1 w1 w2")]
    return asked, docs


def brute(asked, docs):
    found = {}
    for c in {d[1] for d in docs if d[1] is not None}:
        held = {i: Counter(t.split()) if t is not None else None for i, g, t in docs if g == c}
        mean = sum(sum(t.values()) for t in held.values() if t is not None) / max(1, sum(t is not None for t in held.values()))
        for q, g, text in asked:
            for d, t in held.items() if g == c else ():
                score = 0
                for w in set((text or "").split()) & set(t or ()):
                    df = sum(w in (x or ()) for x in held.values())
                    score += math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * sum(t.values()) / mean))
                if score:
                    found[q, d] = round(score, 6)
    return found


@pytest.mark.parametrize("scope", [4_000_000, 0, 30, 250])
def test_scores_are_those_of_each_corpus(spark, monkeypatch, scope):
    monkeypatch.setattr(retrieval, "SCOPE", scope)
    asked, docs = rows()
    q, d = spark.createDataFrame(asked, "q long, page long, text string"), spark.createDataFrame(docs, "d long, page long, text string")
    got = {(r["q"], r["d"]): r["score"] for r in retrieval.bm25(q, d, split, "q", "d", within="page").collect()}
    assert len(got) > 20 and got == pytest.approx(brute(asked, docs), abs=2e-6)


def test_terms_of_small_corpora_are_not_shuffled(spark):
    docs = [(p * 10 + k, p, " ".join(f"w{p}-{j}" for j in range(k * 20, k * 20 + 40))) for p in range(60) for k in range(9)]
    d = spark.createDataFrame(docs, "d long, page long, text string")
    q = d.groupBy("page").agg(F.array_join(F.collect_list("text"), " ").alias("text")).withColumn("q", F.col("page")).checkpoint()
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("within", "")
    n = len(retrieval.bm25(q, d, split, "q", "d", within="page").collect())
    spark.sparkContext.setJobGroup("", "")
    stages = {s for job in tracker.getJobIdsForGroup("within") for s in tracker.getJobInfo(job).stageIds}
    assert n == 540 and sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 5000  # there are 21,600 terms
