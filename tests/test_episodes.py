"""Episodes, paired runs and answers on small cases."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import episodes as E


def test_routes(spark):
    df = spark.createDataFrame([(r, [f"c{k}" for k in range(n)]) for r in [*E.ROUTES, "unknown"] for n in range(5)], "route string, contents array<string>")
    for r in df.select("route", F.size("contents").alias("n"), E.constructed(F.col("route"), F.col("contents")).alias("s")).select("*", E.follows_route(F.col("route"), F.col("s")).alias("ok")).collect():
        fits = r["n"] == len(E.ROUTES.get(r["route"], [])) and r["n"] > 0
        assert r["ok"] == fits and (r["s"] is not None) == fits
    wrong = spark.createDataFrame([("text_search_answer", [("initial_to_text_search", "text_search"), ("text_information_to_answer", "text_search")])], "route string, s array<struct<transition: string, action: string>>")
    assert not wrong.select(E.follows_route(F.col("route"), F.col("s")).alias("ok")).first()["ok"]


def test_failures(spark):
    calls = [("text", "The Tower", "success", ["built in 1901"]), ("text", "tower!", "error", ["in 1950"])]
    df = spark.createDataFrame([("1901", False, calls), ("1950", False, calls), ("1901", True, calls), ("", False, calls), (None, False, [])], "a string, ok boolean, c array<struct<tool: string, query: string, status: string, results: array<string>>>")
    got = df.select(E.repeats_search(F.col("c")).alias("again"), E.copies_span(F.col("a"), F.col("ok"), F.col("c")).alias("span")).collect()
    assert [r["again"] for r in got] == [True] * 4 + [False] and [r["span"] for r in got] == [True, False, False, False, False]
    df = spark.createDataFrame([("Acme Tower", ["1901"], ["Acme Tower"], False), ("the acme tower", ["Acme Tower"], ["Acme Tower"], False), ("Acme Tower", ["1901"], ["Acme Tower"], True), ("x", ["1901"], ["Acme Tower"], False)], "a string, ok array<string>, e array<string>, asks boolean")
    assert [r[0] for r in df.select(E.copies_entity(F.col("a"), F.col("ok"), F.col("e"), F.col("asks"))).collect()] == ["Acme Tower", None, None, None]


def test_pairs_are_asserted(spark):
    schema = "id int, prompt string, score double"
    left, right = spark.createDataFrame([(1, "p", 0.5), (2, "q", 1.0)], schema), spark.createDataFrame([(2, "q", 0.0), (1, "p", 0.25)], schema)
    got = sorted(map(tuple, E.paired(left, right, "id", ["prompt"], 2).select("id", "prompt", "left_score", "right_score").collect()))
    assert got == [(1, "p", 0.5, 0.25), (2, "q", 1.0, 0.0)]
    for bad, expected in ((right.limit(1), None), (right.unionByName(right), None), (right.withColumn("prompt", F.lit("z")), None), (right, 3)):
        with pytest.raises(ValueError):
            E.paired(left, bad, "id", ["prompt"], expected)


def test_aliases_of_fields(spark):
    rows = [({"answer_aliases": '["Blue  Whale", "blue whale"]', "answers": '{"text": "whale"}', "answer": '"Quoted"', "gt_answer": "", "other": "no"},), ({"answer": "plain"},), ({"answer": "[not json"},), ({},)]
    got = [r[0] for r in spark.createDataFrame(rows, "row map<string,string>").select(E.answer_aliases(F.col("row"))).collect()]
    assert got[0] == ["Blue Whale", "whale", "Quoted"] and got[1] == ["plain"] and got[3] == []


def test_alignment_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.5, 9.0], [1, 0]), ([], [], []), ([1.0], [1.0, 2.0], [1])], "a array<double>, b array<double>, m array<int>")
    assert [r[0] for r in df.select(E.alignment_error(F.col("a"), F.col("b"), F.col("m"))).collect()] == [0.5, 0.0, None]
    assert df.limit(1).select(E.alignment_error(F.col("a"), F.col("b"))).first()[0] == 7.0
