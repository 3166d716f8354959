"""A value that is its group's mean has no advantage, in whatever order the mean was summed."""

from itertools import permutations

from pyspark.sql import functions as F

from quillspark.operators import credit as C


def test_value_at_the_mean(spark):
    rows = [(k, x) for k, xs in enumerate(permutations((0.1, 0.3, 0.2, 0.2))) for x in xs] + [(k + 100, x) for k, xs in enumerate(permutations((1.4, 0.7, 0.3, 0.4))) for x in xs]
    got = C.group_advantages(spark.createDataFrame(rows, "g int, v double").coalesce(1), ["g"], "v", "x").where("v = 0.2 or v = 0.7").select("v", "x").distinct().collect()
    assert sorted(map(tuple, got)) == [(0.2, 0.0), (0.7, 0.0)]
    apart = C.group_advantages(spark.createDataFrame([(1, 1.0), (1, 1.0 + 1e-9)], "g int, v double").withColumn("v", F.col("v") * 1e6), ["g"], "v", "x")
    assert all(r["x"] != 0 for r in apart.collect())
