"""Adapters on rows of every shape: nulls, wrong kinds, records of several forms, images and evidence that are there or not."""

import json

from pyspark.sql import functions as F

from quillspark.sources import adapters as A


def rows_of(spark, values):
    return spark.createDataFrame([("a", k, v if v is None else json.dumps(v)) for k, v in enumerate(values)], "annotation string, nth long, j string").select("annotation", "nth", F.try_parse_json("j").alias("row"))


def test_held_out_rows(spark):
    good = {"id": 7, "query": " what? ", "answer": "Paris", "image": {"path": "i/1"}, "evidence": [{"title": "T", "snippet": "in PARIS."}, "x", {"text": ""}, 5], "license": "cc"}
    values = [
        good, {**good, "id": " ", "query": None}, {**good, "answer": '["a", "A", "b"]'}, {**good, "answers": ["", None], "answer": ""}, {**good, "image": None}, {**good, "image": "i/2"}, {**good, "evidence": "about paris"}, {**good, "evidence": []},
        {**good, "license": ""}, None, 5, [], {},
    ]
    images = spark.createDataFrame([("i/1", "s1"), ("i/1", "s1")], "path string, sha256 string")
    found = {r["nth"]: r for r in A.held_out(rows_of(spark, values), images).collect()}
    assert len(found) == len(values)
    assert (found[0]["source_id"], found[0]["question"], found[0]["aliases"], found[0]["image"], found[0]["text_records"], found[0]["reasons"]) == ("7", "what?", ["Paris"], "s1", ["T | in PARIS.", "x", "5"], [])
    reasons = {k: r["reasons"] for k, r in found.items()}
    assert reasons[1] == ["empty_question", "missing_source_data_id"] and found[2]["aliases"] == ["a", "b"] and reasons[3] == ["empty_answer"] and reasons[4] == ["missing_query_image"] and reasons[5] == ["unreadable_query_image"]
    assert reasons[6] == [] and reasons[7] == ["offline_evidence_missing"] and reasons[8] == ["missing_license_metadata"]
    everything = ["empty_answer", "empty_question", "missing_license_metadata", "missing_query_image", "missing_source_data_id", "offline_evidence_missing"]
    assert all(reasons[k] == everything for k in (9, 10, 11, 12))
    counts = {r["reason"]: r["rows"] for r in A.rejections(A.held_out(rows_of(spark, values), images, licence="cc")).collect()}
    assert counts["accepted"] == sum(not set(r) - {"missing_license_metadata"} for r in reasons.values()) and "missing_license_metadata" not in counts
    beside = spark.createDataFrame([("7", '["more of paris"]')], "source_id string, j string").select("source_id", F.parse_json("j").alias("record"))
    both = A.held_out(rows_of(spark, [good]), images, beside, evidence_mode="both").first()
    assert both["image_records"] == both["text_records"] == ["T | in PARIS.", "x", "5", "more of paris"]
    assert A.held_out(rows_of(spark, [good]).limit(0), images).count() == 0


def test_web_search_rows(spark):
    rows = spark.createDataFrame([(0, "1", "q", True, "a", ["b", "A"]), (1, None, None, None, None, None), (2, "2", "", False, "", None)], "nth long, sample_id string, query string, image_ok boolean, gt_answer string, alternatives array<string>")
    site = "array<struct<title: string, snippet: string>>"
    ranked = spark.createDataFrame([(0, "1", [("old", "x")]), (5, "1", [("new", None), (" ", ""), (None, "y")]), (1, "2", None)], f"nth long, sample_id string, websites {site}")
    texts = spark.createDataFrame([(3, "1", None, "second", "z"), (1, "1", "first", "no", "no"), (2, "1", "", "", " "), (1, "2", None, None, None)], "nth long, sample_id string, retrieved string, original string, snippet string")
    found = {r["nth"]: r for r in A.web_search(rows, ranked, texts).collect()}
    assert found[0]["image_records"] == ["new", "y"] and found[0]["text_records"] == ["first", "second"] and found[0]["aliases"] == ["a", "b"] and found[0]["reasons"] == []
    assert found[1]["reasons"] == ["missing_source_data_id"] and found[2]["reasons"] == ["unusable_query_image"] and found[2]["text_records"] == []


def test_splits_and_websites(spark):
    said = [({"split": "Human-eval"}, "x"), ({}, "a/b/infoseek_HUMAN.jsonl"), ({}, "train_val.jsonl"), ({"data_split": "dev"}, "test.jsonl"), ({}, "other"), (None, "test")]
    df = spark.createDataFrame([(k, json.dumps(r), n) for k, (r, n) in enumerate(said)], "k long, j string, n string").withColumn("r", F.parse_json("j"))
    assert [r["s"] for r in df.select("k", A.split_of(F.col("r"), F.col("n")).alias("s")).orderBy("k").collect()] == ["human", "human", "val", "dev", "unknown", "test"]
    rows = rows_of(spark, [{"website0_info": {"title": "a"}, "Website_x": "b", "search_results": [], "other": 1}, {"website0_info": None}, None])
    assert [r[0] and len(r[0]) for r in rows.orderBy("nth").select(A.with_websites(F.col("row"))).collect()] == [2, None, None]
