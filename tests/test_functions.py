"""Small cases of the functions that SQL cannot check."""

import json

from pyspark.sql import functions as F

from quillspark.functions import equivalence as E
from quillspark.functions.actions import parsed_action
from quillspark.operators import compaction as C
from quillspark.operators import grouping as G
from quillspark.operators import splits as S
from quillspark.sources import readers, sinks


def test_action_errors(spark):
    cases = {
        "": "empty_output", "<answer>a</answer>": "missing_reason", "<reason>a<answer>b</answer>": "incomplete_xml", "<reason></reason><answer>a</answer>": "empty_reason",
        "<reason>a</reason><reason>b</reason><answer>c</answer>": "multiple_reasons", "<reason>a</reason><jump>b</jump>": "unknown_action",
        "<reason>a</reason><answer>b</answer><answer>c</answer>": "multiple_actions", "<reason>a</reason><text_search> </text_search>": "empty_query",
        "<reason>a</reason><answer> </answer>": "empty_answer", "<reason><answer>b</answer></reason>": "nested_action", "<reason>a</reason><information>x</information>": "forged_information",
        "so <reason>a</reason><answer>b</answer>": "extra_text", "<reason>a <b></reason><answer>c</answer>": "invalid_xml",
        "<reason>a</reason><answer>b</answer>": None, "<reason>a</reason>\n<search><img></search>": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    found = {r["raw"]: r["error"] for r in df.select("raw", parsed_action(F.col("raw"))["error"].alias("error")).collect()}
    assert found == cases


def test_numbers_and_times():
    assert " ".join(E.in_digits("two hundred and five people".split())) == "205 people"
    assert E.spelled_out("three hundred twenty thousand four hundred six".split()) == 320_406
    assert E.spelled_out(["thousand"]) == 1000 and E.spelled_out("one million two".split()) == 1_000_002
    for text, minutes in {"9 am": 540, "12:30 a.m.": 30, "at 18:05": 1085, "12 pm": 720, "25:00": None, "in 1998": None, "13 pm": None}.items():
        assert E.reading(text)["clock"] == minutes, text
    assert [(q["dimension"], round(q["base"], 9)) for q in E.reading("5 km, 32 °F, 3 million dollars and $2k")["quantities"]] == [("length", 5000.0), ("temperature", 0.0), ("currency:usd", 3e6), (None, 2000.0)]
    assert (E.reading("ten to 12")["low"], E.reading("ten to 12")["high"]) == (10.0, 12.0)


def test_equivalence(spark):
    cases = [
        ("5 km", ["5000 meters"], "how long", "unit"), ("1,200", ["1200"], "how many", "exact"), ("$3 million", ["3000000 dollars"], "cost", "unit"),
        ("9 am", ["09:00"], "when does it open", "numeric"), ("free", ["no cost"], "price", "semantic"), ("Queen Anne Stuart", ["Anne Stuart"], "who", "alias"),
        ("Anne Stuart of England", ["Anne Stuart"], "who", "alias"), ("50 percent", ["0.5 %", "50%"], "how much", "unit"), ("5-7", ["five to 7"], "how many", "numeric"),
        ("7 kg", ["8 kg"], "weight", None), ("$5 for 3 kg", ["$6 for 3 kg"], "cost", None), ("twenty", ["21"], "how many", None), (None, [], "", None), ("x", [None], "", None),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, said string, aliases array<string>, question string, way string")
    ways = ("exact", "numeric", "unit", "alias", "semantic")
    judged = E.judged(E.with_readings(df, F.col("said"), F.col("aliases")), F.col("question"), "e").select("k", "way", "e")
    for r in judged.collect():
        if r["way"]:
            assert r["e"][r["way"]] and r["e"]["f1"] == 1.0, r
        else:
            assert not any(r["e"][w] for w in ways) and not r["e"]["strict"], r
    score = judged.select("k", E.answer_score(F.col("e")).alias("s"))
    assert {r["k"]: r["s"] for r in score.where("k in (0, 12)").collect()} == {0: 1.0, 12: 0.0}


def test_support(spark):
    cases = [
        (["blue whales"], "the blue whale", "", "alias_equivalent"), ([], "", "", "none"), (["Anne Stuart"], "So said Anne Stuart.", "", "normalized_exact"),
        (["King Louis Philippe of France"], "it was Louis Philippe who", "", "alias_equivalent"), (["2 km"], "about 2000 metres away", "", "unit_equivalent"),
        (["large brown river dog"], "a brown dog", "", "core_token_recall"), (["whale"], "dolphin", "", "none"), ([" ", None, "cat"], "a cat", "", "normalized_exact"),
    ]
    df = spark.createDataFrame(cases, "aliases array<string>, said string, question string, way string")
    for r in E.with_readings(df, F.col("said"), F.col("aliases")).select("way", E.supported(F.col("_said"), F.col("_aliases"), F.col("question")).alias("m")).collect():
        assert r["m"]["match_type"] == r["way"], r
    assert ["length:2000"] in [r["s"] for r in df.select(E.signatures(E.read(F.col("said"))).alias("s")).collect()]


def test_compaction():
    assert C.trim(["One two.", "Three four."], 8) == "One two."
    assert C.trim(["A very long sentence"], 6) == "A very"
    assert C.grow(["a b.", "x y.", "c d."], {"x"}, 9) == "x y. c d."
    assert C.grow([], {"x"}, 5) == ""


def test_choices():
    assert S.largest_remainders({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}
    assert S.exact_subset([("a", 3), ("b", 5), ("c", 7)], 12) == ["b", "c"]
    assert S.exact_subset([("a", 2)], 3) is None
    assert S.equal_capacity({("a",): 3, ("a", "b"): 5}, ["a", "b"]) == 4
    assert S.greedy_cover([("x", {1, 2}, 5), ("y", {1, 2}, 3), ("z", {3}, 1)], 2) == ["y", "z"]
    assert sum(S.best_plan({"a": 50, "b": 50}, {"a": (0, 20, 50), "b": (0, 20, 50)}, 60).values()) == 60


def test_unique_choice_is_the_sequential_one(spark):
    data = [(i, (i * 7) % 11, (i * 5) % 6) for i in range(40)]
    expected, a, b = [], set(), set()
    for i, x, y in data:
        if x not in a and y not in b:
            expected.append(i)
            a.add(x)
            b.add(y)
    df = spark.createDataFrame(data, "i int, x int, y int")
    assert sorted(r["i"] for r in S.unique_on(df, ["x", "y"], [F.col("i")]).collect()) == expected


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    found = {r["id"]: r["component"] for r in G.components(edges).collect()}
    assert found == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, token string")
    sinks.write_json_lines(df, f"{tmp_path}/j")
    line = next(x for p in tmp_path.glob("j/part-*") for x in p.read_text().splitlines())
    assert list(json.loads(line)) == ["id", "token"]
    df.write.parquet(f"{tmp_path}/p")
    df.write.mode("append").parquet(f"{tmp_path}/p")
    try:
        readers.read_records(spark, f"{tmp_path}/p", ["id"], "id")
        raise AssertionError("a repeated key passed")
    except ValueError:
        pass
    assert sinks.without_secrets(df).first()["token"] == "[redacted]"
    assert sinks.manifest(spark, f"{tmp_path}/j").count() >= 1
