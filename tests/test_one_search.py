"""Routes ask once for what they find with and without a record's own documents; terms are counted where rows are read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval, routes


def tables(spark):
    rng = random.Random(4)
    docs = [(k, k % 12, " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(30))) for k in range(90)] + [(90, 3, ""), (91, 4, None)]
    asked = [(k, " ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(4))) for k in range(20)]
    return spark.createDataFrame(asked, "id long, query string"), spark.createDataFrame(docs, "doc_id long, source_id long, text string")


@pytest.mark.parametrize("apart", [100, 3])
def test_hits_with_and_without_own_documents(spark, monkeypatch, apart):
    monkeypatch.setattr(routes, "APART", apart)
    asked, corpus = tables(spark)
    own = corpus.select(F.col("source_id").alias("id"), "doc_id")
    scored = [tuple(r) for r in retrieval.bm25(asked.withColumnRenamed("query", "text"), corpus, routes._tokens, "id", "doc_id").collect()]
    best = lambda rows, i: [d for _, d in sorted((-s, d) for j, d, s in rows if j == i)[:3]]
    want = {i: (best(scored, i), best([x for x in scored if x[1] % 12 != i], i)) for i in {x[0] for x in scored}}
    searches, top = [], retrieval.bm25_top
    monkeypatch.setattr(retrieval, "bm25_top", lambda *a, **k: searches.append(a) or top(*a, **k))
    monkeypatch.setattr(retrieval, "bm25", None)
    got = {r["id"]: tuple([h["doc_id"] for h in r[c] or []] for c in ("hits", "others")) for r in routes._hits(asked, corpus, 3, own).collect()}
    assert got == want and any(a != b for a, b in want.values()) and len(searches) == (1 if apart == 100 else 2)


def test_terms_are_counted_once_a_row(spark):
    rows = [(1, [5, 3, 5, 9]), (2, []), (3, None), (4, [3])]
    df = spark.createDataFrame(rows, "doc_id long, terms array<long>").coalesce(1)
    found = lambda only: {r["doc_id"]: (r["length"], [(t["term"], t["tf"]) for t in r["terms"]]) for r in retrieval._counted(df, only).collect()}
    assert found(None) == {1: (4, [(3, 1), (5, 2), (9, 1)]), 2: (0, []), 3: (None, []), 4: (1, [(3, 1)])}
    assert found(np.array([5, 9])) == {1: (4, [(5, 2), (9, 1)]), 2: (0, []), 3: (None, []), 4: (1, [])}
