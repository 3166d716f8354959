"""Scans of whole texts hold a few rows at a time in Python, with the results of the column functions."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import equivalence as E
from quillspark.functions.batches import few
from quillspark.operators import anchors as N


def test_pieces():
    batch = pa.RecordBatch.from_pydict({"x": list(range(150))})
    assert [p.num_rows for p in few(iter([batch, batch]))] == [64, 64, 22] * 2
    assert [x for p in few(iter([batch])) for x in p.column("x").to_pylist()] == list(range(150))


def test_equal_to_columns(spark):
    texts = ["The twenty-one km road, 3,000 m of 5 kg at $12", None, "", "a an the", "Zwölf ﬁne 1 ½ euro é"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    want = df.select("id", F.explode(N.placed_tokens("text")).alias("t")).select("id", "t.*").collect()
    got = N.with_placed_tokens(df, "text")
    assert got.columns == ["id", "token", "raw", "start", "end"] and got.collect() == want and want
    assert E.with_quantities(df, "text").collect() == df.select("id", E.read(F.col("text"))["quantities"].alias("quantities")).collect()
    assert N.with_placed_tokens(df.limit(0), "text").count() == 0
