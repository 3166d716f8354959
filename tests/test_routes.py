"""Every decision of the text route and of the image-to-text route, on small records."""

from pyspark.sql import functions as F

from quillspark.operators import routes

CORPUS = [
    (1, 10, "Acme Tower was opened in 1901 by the mayor"), (2, 11, "the opening of Acme Tower drew crowds in 1901"), (3, 99, "Bolt Works makes bolts in Gotham"), (4, 98, "completely different matters of weather"),
    (5, 97, "date of Carver House: finished 1950 after a long delay of many years"), (6, 96, "an old long winding story of rivers"),
]


def corpus(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, source_id long, text string")


def test_text_route(spark):
    records = [
        (10, "When was Acme Tower opened by the mayor", ["1901"], None), (11, "", ["1901"], "query_too_short"), (12, "Acme Tower opened 1901", ["1901"], "answer_leak"),
        (13, "Which Acme is Tower hidden phrase stands here", ["1901"], "unavailable_context_leak"), (14, "What about unicorn sparkle glitter", ["1901"], "evidence_miss"),
        (15, " ".join(f"w{k}" for k in range(50)), ["1901"], None), (16, "Where does Bolt Works make bolts", ["Paris"], "evidence_miss"),
    ]
    titles = spark.createDataFrame([(13, "the Acme Tower hidden phrase stands out"), (10, "something else"), (14, None)], "id long, title string")
    df = spark.createDataFrame([r[:3] for r in records], "id long, question string, aliases array<string>")
    got = {r["id"]: r for r in routes.text_route(df, titles, corpus(spark)).collect()}
    assert got[10]["reason"] is None and got[10]["hit_leave_one_out"] and 1 in got[10]["documents"]
    assert {i: got[i]["reason"] for i in (12, 13, 14, 16)} == {i: why for i, _, _, why in records if i in (12, 13, 14, 16)}
    assert got[11]["reason"] in ("empty_query", "query_too_short", "evidence_miss") and len(got) == len(records)
    alone = spark.createDataFrame([(97, "When was Carver House finished after delay", ["1950"])], "id long, question string, aliases array<string>")
    only = routes.text_route(alone, titles, corpus(spark)).first()
    assert only["reason"] is None and only["hit_leave_one_out"] is False


def test_image_text_route(spark):
    shown = [
        (1, 1, "Carver House - Guide", 50), (1, 2, "Visit Carver House", 51), (3, 1, "<image> tower", 52), (4, 1, "Carver House of 1950", 53), (5, 1, "the picture", 54), (6, 1, "<b>", 55),
        (7, 1, "Carver House", 56), (8, 1, "Carver House", 5), (9, 1, "Zanzibar Palace", 57), (10, 1, "Long Winding Story", 58),
    ]
    records = [
        (1, "When was this finished", ["1950"], None), (2, "When was this finished", ["1950"], "cache_miss"), (3, "When was this finished", ["1950"], "forbidden_visual_placeholder"),
        (4, "When was this finished", ["1950"], "answer_already_in_image_information"), (5, "When was this finished", ["1950"], "image_entity_too_generic"), (6, "When was this finished", ["1950"], "image_entity_not_found"),
        (7, "Tell me more", ["1950"], "relation_not_found"), (8, "When was this finished", ["1950"], "text_evidence_only_image_context"), (9, "When was this finished", ["1777"], "text_evidence_miss"),
        (10, "When was it", ["rivers"], None),
    ]
    results = spark.createDataFrame(shown, "id long, rank int, title string, doc_id long")
    df = spark.createDataFrame([r[:3] for r in records], "id long, question string, aliases array<string>")
    got = {r["id"]: r for r in routes.image_text_route(df, results, corpus(spark)).collect()}
    assert {i: r["reason"] for i, r in got.items()} == {i: why for i, _, _, why in records}
    assert got[1]["entity"] == "Carver House" and got[1]["query"] == "date of Carver House" and got[1]["documents"] == [5]


def test_context_leaks(spark):
    df = spark.createDataFrame([("a b c d e", ["x"], ["q a b c d z"]), ("a b c d e", ["A b c, d"], ["q a b c d z"]), ("a b c", ["x"], ["a b c"])], "q string, v array<string>, h array<string>")
    assert [r[0] for r in df.select(routes.leaks_context(F.col("q"), F.col("v"), F.col("h"))).collect()] == [True, False, False]
