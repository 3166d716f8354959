"""Relations against a plain search in order, and blocks that come back whatever their texts."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from quillspark.functions import information as I
from quillspark.functions import relations as L


def test_expressions():
    assert L.expression_of("who (was) designed") == (r"\bwho\s+(?:was\s+)?designed\b", [["who"], ["designed"]])
    assert L.expression_of("what|which (is the) breed|species")[0] == r"\b(?:what|which)\s+(?:is\s+the\s+)?(?:breed|species)\b"
    assert L.expression_of("who|which_organization .. operate|operates") == (r"\b(?:who|which\s+organization)\b.*\b(?:operate|operates)\b", [["who", "which"], ["operate", "operates"]])
    assert L.expression_of("who .. wrote|authored")[0] == r"\bwho\b.*\b(?:wrote|authored)\b" and L.expression_of("where is")[0] == r"\bwhere\s+is\b"
    assert len({n for n, _, _ in L.RELATIONS}) == len(L.RELATIONS) == 66


def test_first_relation_in_order(spark):
    random.seed(7)
    words = sorted({w for _, _, p in L.RELATIONS for w in re.findall(r"[a-z]+", p)}) + ["it", "Ünder", "ｗｈｏ", "isn't", "where-is"]
    texts = ["", None, "who", "WHO\tis  THE architect", "whose designed", "wholly built", "ｗｈｏ designed ﬁt"] + [" ".join(random.choices(words, k=random.randrange(2, 9))) for _ in range(600)]
    texts += [p.replace("|", " ").replace("..", "x").replace("(", "").replace(")", "").replace("_", " ") for _, _, p in L.RELATIONS]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, q string").select("k", L.question_relation(F.col("q")).alias("r"), L.question_kind(F.col("q")).alias("kind")).collect()
    for r in found:
        plain = " ".join(unicodedata.normalize("NFKC", texts[r["k"]] or "").casefold().split())
        first = next(((n, rel, L.prefix_of(rel)) for n, rel, p in L.RELATIONS if re.search(L.expression_of(p)[0], plain)), (None, None, None))
        assert tuple(r["r"]) == first, plain
        assert r["kind"] == next((n for n, p in L.KINDS if re.search(L.expression_of(p)[0], (texts[r["k"]] or "").lower())), "unknown")


def test_blocks_come_back(spark):
    random.seed(8)
    pieces = ["<b>", "&amp;", "&", " [cache_document=x]", "title: ", "1. ", "é", "a", "</information>", "]", "\\"]
    flat = lambda: " ".join("".join(random.choices(pieces, k=random.randrange(1, 6))).split())
    rows = [(k, [(flat(), f"d{j}") for j in range(random.randrange(1, 14))]) for k in range(120)]
    df = spark.createDataFrame(rows, "k long, items array<struct<text: string, document_id: string>>")
    for kind in I.HEADERS:
        for r in df.select("k", I.parsed_block(I.information_block(kind, F.col("items"))).alias("p")).collect():
            assert r["p"]["kind"] == kind and r["p"]["fault"] is None
            assert [(x["text"], x["document_id"]) for x in r["p"]["items"]] == [(t, d if kind == "text" else None) for t, d in rows[r["k"]][1]]
    empty = df.limit(1).select(I.information_block("image", F.array().cast("array<struct<text: string, document_id: string>>")).alias("b"), I.parsed_block(F.lit(None).cast("string")).alias("p"), I.parsed_block(F.lit("")).alias("q")).first()
    assert empty["b"] is None and empty["p"]["fault"] == empty["q"]["fault"] == "no opening"


def test_results_and_entities(spark):
    state = [("tool", "<information>\n[Text Search Results] x\n 1. Alpha [cache_document=d:1]\r\n2.  Beta\n\nnot ranked\n10. Ga [cache_document=q] mma \n</information>"), ("assistant", "1. no [Text Search Results]"), ("tool", "1. no")]
    calls = [("image_search", "success", ["it identifies the query image as  The Tower. Official", "File:Big Ben - Wikipedia", "the tower - Wikimedia Commons page", "none"]), ("image_search", "error", ["Nope - Wikipedia"]), ("text_search", "success", ["Nope - Wikipedia"])]
    df = spark.createDataFrame([(state, calls), (None, None)], "s array<struct<role: string, content: string>>, c array<struct<tool: string, status: string, results: array<string>>>")
    found = df.select(I.text_results(F.col("s")).alias("t"), I.identified_entities(F.col("c")).alias("e")).collect()
    assert [tuple(x) for x in found[0]["t"]] == [("d:1", "Alpha"), ("", "Beta"), ("q", "Ga  mma")] and found[0]["e"] == ["The Tower", "Big Ben"] and found[1]["e"] is None
