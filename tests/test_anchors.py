"""Search gates, anchors, entities, token windows and leakage on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import anchors, gates, leakage, token_windows


def test_every_fault_of_a_text_search(spark):
    good = ("When was Acme Tower opened", "The Acme Tower stands here", "Tell me of it", ["1901"], [("d1", "Acme Tower opened in 1901")], ["d9"])
    cases = {
        "": good,
        "strict_parser_invalid": ("<b> Acme Tower opened", *good[1:]),
        "query_answer_leak": ("Acme Tower opened 1901", *good[1:]),
        "unreachable_evidence": (*good[:4], [("d1", "nothing of the kind")], ["d9"]),
        "same_context_evidence_only": (*good[:5], ["d1"]),
    }
    rows = [(k, *v) for k, v in cases.items()] + [
        ("entity_not_visible", "Bolt Works history", *good[1:]), ("missing_visible_entity", "tower stands tall there", *good[1:]), ("generic_query", "what is this", *good[1:]),
        ("unresolvable_visual_reference", "name of tower", *good[1:]), ("question_copy_query", "stands here now", good[1], "where it stands here now", *good[3:]), ("unreachable_evidence", *good[:4], None, ["d9"]),
    ]
    schema = "fault string, query string, visible string, question string, aliases array<string>, results array<struct<document_id: string, text: string>>, own array<string>"
    found = spark.createDataFrame(rows, schema).select("fault", gates.text_search_faults(*map(F.col, ("query", "visible", "question", "aliases", "results", "own"))).alias("f")).collect()
    for r in found:
        assert (r["fault"] in r["f"]) if r["fault"] else r["f"] == [], r
    assert [r["f"] for r in found[1:5]] == [[k] for k in list(cases)[1:]]


def test_anchors_by_kind_and_source(spark):
    cases = [
        ("where is Acme Tower today", "about the Acme Tower", "", ("Acme Tower", "named_entity", "question")), ("the NASA budget", "what did NASA do", "", ("NASA", "uppercase_acronym", "question")),
        ("route B52 length", "none", "the route B52 goes on", ("B52", "numeric_identifier", "information")), ('song "Blue Moon" author', 'who wrote "Blue Moon"', "", ("Blue Moon", "quoted_entity", "question")),
        ("some plain words", "other plain words", "", None), ("", "Acme", "Acme", None),
    ]
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, query string, question string, information string")
    got = {r["k"]: r["a"] for r in df.select("k", anchors.query_anchor(F.col("query"), F.col("question"), F.col("information")).alias("a")).collect()}
    assert {k: v and tuple(v) for k, v in got.items()} == {k: c[3] for k, c in enumerate(cases)}


def test_entities_of_titles(spark):
    rows = [
        ("a", 1, "Acme Tower - Travel Guide"), ("a", 2, "Visit the Acme Tower Today"), ("b", 2, "Bolt Works"), ("b", 1, "Carver House Museum.jpg"), ("c", 1, "the picture"), ("c", 2, "image of a thing"),
        ("d", 1, "<b>x</b>"), ("d", 2, None),
    ]
    got = {r["request"]: (r["entity"], r["rank"], r["method"], r["fault"]) for r in anchors.visible_entity(spark.createDataFrame(rows, "request string, rank int, title string")).collect()}
    assert got == {
        "a": ("Acme Tower", 1, "shared_visible_title_phrase", None), "b": ("Carver House Museum", 1, "cleaned_top1_title", None),
        "c": ("", 0, "none", "image_entity_too_generic"), "d": ("", 0, "none", "image_entity_not_found"),
    }


def test_token_places(spark):
    text = "The ﬁrst two Öne's, and a 3rd"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    rows = [r["x"] for r in df.select(anchors.placed_tokens("t").alias("x")).collect()]
    plain = text.replace("ﬁ", "fi")
    assert [t["token"] for t in rows[0]] == ["first", "2", "öne's", "and", "3rd"] and all(plain[t["start"] : t["end"]] == t["raw"] for t in rows[0]) and rows[1] == [] == rows[2]


def test_token_windows_cover_the_text(spark):
    path = str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    random.seed(1)
    texts = ["", None, "short text", " ".join(random.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(700)), "word " * 30]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    for most in (None, 3):
        for r in df.select("k", "t", token_windows.token_windows(F.col("t"), path, 40, 8, most).alias("w")).collect():
            spans = model.encode(r["t"] or "", add_special_tokens=False).offsets
            assert [w["start"] for w in r["w"]] == [32 * i for i in range(len(r["w"]))] and len(r["w"]) <= (most or 10**9)
            assert all(w["text"] == r["t"][spans[w["start"]][0] : spans[w["start"] + w["tokens"] - 1][1]] for w in r["w"])
            if most is None and spans:
                assert r["w"][-1]["start"] + r["w"][-1]["tokens"] == len(spans) and len({i for w in r["w"] for i in range(w["start"], w["start"] + w["tokens"])}) == len(spans)


def test_leakage_against_all_pairs(spark):
    random.seed(2)
    words = lambda: [f"w{random.randrange(40)}" for _ in range(12)]
    references = [(i, f"t{i % 5}" if i % 2 else None, random.getrandbits(16), words()) for i in range(25)]
    candidates = [(100 + i, f"t{random.randrange(30)}", h ^ (1 << random.randrange(16)) if i % 3 else random.getrandbits(16), [*w[:-1], "new"] if i % 2 else list(w)) for i, (_, _, h, w) in enumerate(references * 2)]
    schema = "id long, text string, hash long, tokens array<string>"
    c, r = spark.createDataFrame(candidates, schema), spark.createDataFrame(references, schema)
    got = {tuple(x) for x in leakage.audit(c, r, ["text"], radius=2, least=0.7, most=3, bits=16).collect()}
    expected = set()
    for i, t, h, w in candidates:
        if same := [j for j, u, _, _ in references if u is not None and u == t]:
            expected.add((i, min(same), "text"))
        expected |= {(i, j, "near_hash") for j, _, g, _ in references if (g ^ h).bit_count() <= 2}
    for j, _, _, v in references:
        near = sorted((-len(set(w) & set(v)) / len(set(w) | set(v)), i) for i, _, _, w in candidates if set(w) != set(v))
        expected |= {(i, j, "similar_tokens") for s, i in [x for x in near if x[0] <= -0.7][:3]}
    assert got == expected
    assert {x["id"] for x in leakage.clean(c, leakage.audit(c, r, ["text"], 2, 0.7, 3, 16)).collect()} == {i for i, *_ in candidates} - {i for i, _, _ in expected}
