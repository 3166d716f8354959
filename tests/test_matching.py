"""Token overlap against multisets, and in time that grows with the length of the texts."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from quillspark.functions import matching as M


def test_overlap_of_multisets(spark):
    random.seed(1)
    rows = [([random.choice("abcdé") for _ in range(random.randrange(9))], [random.choice("abcdé") for _ in range(random.randrange(9))]) for _ in range(300)] + [([], []), (["a"], [])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(M.overlap_count(F.col("a"), F.col("b")), M._merged(F.col("a"), F.array_distinct("b"), False)).collect()
    assert [tuple(r) for r in got] == [(sum((Counter(a) & Counter(b)).values()), sum(t in b for t in a)) for a, b in rows]


def test_long_texts(spark):
    random.seed(2)
    words = [f"w{random.randrange(15_000)}" for _ in range(30_000)]
    df = spark.createDataFrame([(words, words[::-1])], "a array<string>, b array<string>")
    began = time.time()
    assert df.select(M.overlap_count(F.col("a"), F.col("b"))).first()[0] == 30_000
    assert time.time() - began < 20
