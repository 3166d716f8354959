"""Infilling and chat formatting against plain Python, on whole small tables and on hard little cases."""

import hashlib
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat_formatting, fill_in_middle, queries
from tests.oracle import SF_DIR, connection, of_frame, of_sql

# --- 12: fill in the middle ---


def infilled(plan, doc_id, text):
    units = re.findall(plan.unit, text)
    h = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in plan.marks) or h3 % 100 >= plan.rate:
        return len(units), "plain", None, None, text
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(part) for part in (units[:low], units[low:high], units[high:]))
    p, s, m = plan.marks
    if h4 % 100 < plan.spm:
        return len(units), "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return len(units), "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


HARD_TEXTS = [None, "", "\n", "\n\n\n", "a", "a\nb", "a\nb\n", "é\n漢字\n\U0001f600 x", "with <P> mark\nx", "ends in <\nS>\n<S", "<", "\r\n\x0b\u2028 no line\n", "line\n" * 50_000, "x" * 300_000]


@pytest.mark.parametrize("plan", [fill_in_middle.Plan(), fill_in_middle.Plan(unit=r"\s*\S+\s*", seed=3, rate=60, spm=30, marks=("[pre]", "[suf]", "[mid]"))])
def test_infill_against_lists_of_units(spark, plan):
    random.seed(5)
    texts = HARD_TEXTS + ["".join(random.choice("ab<PSM>\n\n ") for _ in range(random.randrange(60))) for _ in range(300)]
    rows = [(None if k % 50 == 7 else k, t, "kept", 5) for k, t in enumerate(texts)] + [(4, "a", "kept", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fim_text string, n int").repartition(3)
    cut = fill_in_middle.infill(docs, plan)
    assert cut.columns == ["doc_id", "_fim_text", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = cut.withColumn("again", fill_in_middle.original(F.col("output"), F.col("form"), plan.marks)).collect()
    if plan.unit == fill_in_middle.LINE:  # its units tile every text
        expected = sorted(((i, *infilled(plan, i, t or ""), t or "") for i, t, *_ in rows), key=repr)
        assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in found), key=repr) == expected
    assert sorted((repr(r["doc_id"]), r["again"]) for r in found) == sorted((repr(i), t or "") for i, t, *_ in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle.infill(docs.limit(0), plan).count() == 0


def test_matcher_streams():
    unit, text = re.compile(fill_in_middle.LINE), "ab\n" * 200_000 + "end"
    assert fill_in_middle.count_units(unit, text) == 200_001
    assert fill_in_middle.unit_ends(unit, text, 0, 0) == (0, 0) and fill_in_middle.unit_ends(unit, text, 5, 200_001) == (15, len(text)) and fill_in_middle.unit_ends(unit, text, 7, 7) == (21, 21)


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P>", "P>", "<M>"), ("aba", "x", "y"), ("", "x", "y"), ("ab", "bc", "d")])
def test_marks_that_overlap_are_refused(marks):
    with pytest.raises(ValueError):
        fill_in_middle.Plan(marks=marks).checked()


# --- 13: chat formatting ---


SAYS = [("user", "Hi"), ("assistant", "Hello")]
LAYOUTS = {
    "messages": {"messages": [{"role": "human", "content": "Hi"}, {"content": "Hello", "role": "assistant"}], "id": 3},
    "message_parts": {"messages": [{"role": "user", "content": [{"type": "text", "text": "H"}, {"type": "text", "text": "i"}]}, {"role": "assistant", "content": [{"type": "text", "text": "Hello"}]}]},
    "data_messages": {"data": {"messages": [{"role": "user", "content": "Hi"}, {"role": "assistant", "content": "Hello"}]}},
    "from_value": {"conversations": [{"from": "human", "value": "Hi"}, {"from": "gpt", "value": "Hello"}], "metadata": {"a": [1, {"b": 2}]}},
    "exchanges": {"conversation": [{"human": "Hi", "assistant": "Hello"}]},
    "instruction_output": {"instruction": "Hi", "input": "", "output": "Hello"},
    "instruction_response": {"instruction": "Hi", "response": "Hello", "category": "qa"},
    "prompt_completion": {"prompt": "Hi", "completion": "Hello"},
    "prompt_response": {"response": "Hello", "prompt": "Hi"},
    "prompt_messages": {"prompt": [{"role": "user", "content": "Hi"}], "completion": [{"role": "assistant", "content": "Hello"}]},
    "preference": {"prompt": "Hi", "chosen": "Hello", "rejected": "No"},
    "question_answer": {"question": "Hi", "answer": "Hello", "context": None},
}


def test_every_layout_gives_the_same_turns(spark):
    rows = [(k, 0, json.dumps(record)) for k, record in enumerate(LAYOUTS.values())]
    found = {}
    for r in chat_formatting.canonical_turns(spark.createDataFrame(rows, "conv_id long, place long, record string")).orderBy("conv_id", "nth").collect():
        found.setdefault(r["layout"], []).append((r["role"], r["text"]))
    assert found == dict.fromkeys(LAYOUTS, SAYS)
    assert {x.name for x in chat_formatting.LAYOUTS} == {*LAYOUTS, "turn"}
    more = {"system": "S", "instruction": "do", "input": "this", "output": 5}
    assert list(chat_formatting.turns_of(more, chat_formatting.layout_of(chat_formatting.field_paths(more)))) == [("system", "S"), ("user", "do\n\nthis"), ("assistant", "5")]


def test_unknown_layouts_stay_apart(spark):
    bad = [None, "", "{", "3", "[]", "{}", json.dumps({"prompt": "a"}), json.dumps({"prompt": "a", "completion": "b", "more": "c"}), json.dumps({"messages": []}), "[" * 100_000]
    rows = [(k, 0, x) for k, x in enumerate(bad)] + [(None, None, json.dumps({"role": None, "text": None})), (90, 1, json.dumps({"prompt": "a", "completion": "b"}))]
    records = spark.createDataFrame(rows, "conv_id long, place long, record string")
    found = chat_formatting.canonical_turns(records).collect()
    assert {r["conv_id"] for r in found if r["layout"] is None} == set(range(len(bad))) and all(r["fingerprint"] for r in found)
    assert sorted((r["role"], r["text"]) for r in found if r["layout"]) == [("", ""), ("assistant", "b"), ("user", "a")]
    assert chat_formatting.canonical_turns(records.limit(0)).count() == 0
    told = chat_formatting.fingerprint(chat_formatting.field_paths({"a": [{"b": 1}, {"c": 2}]}))
    assert told == chat_formatting.fingerprint(chat_formatting.field_paths({"a": [{"c": "x", "b": []}]})) != chat_formatting.fingerprint(chat_formatting.field_paths({"a": {"b": 1, "c": 2}}))


def test_template_gives_back_every_text():
    random.seed(2)
    pieces = ["\\", "#", "###", "</turn>", "<", "/turn>", ": ", ":", "\n", "### User: ", "é", "=", "x"]
    texts = ["", "\\" * 5, "a</turn", "</turn>\n### User: x</turn>\n"] + ["".join(random.choices(pieces, k=random.randrange(12))) for _ in range(3000)]
    for k, text in enumerate(texts):
        role = ("user", "assistant", "tool", "", "User", "=user", texts[-k])[k % 7]
        segment, start, length = chat_formatting.segment_of(role, text)
        assert chat_formatting.read_segment(segment) == (role, text) and chat_formatting.unescaped(segment[start : start + length]) == text
    began = time.time()
    assert chat_formatting.read_segment(chat_formatting.segment_of("user", "\\<" * 500_000)[0]) == ("user", "\\<" * 500_000)
    assert time.time() - began < 10
    with pytest.raises(ValueError):
        chat_formatting.read_segment("### User: a</turn>b</turn>\n")


def test_formatted_conversations(spark):
    rows = [(1, 2, 0, "assistant", "b\\</turn>"), (1, 1, 0, "user", "a"), (1, 3, 0, None, None), (1, 3, 0, None, None), (None, 0, 0, "assistant", "é"), (2, 0, 0, "tool", "### "), (2, None, 0, "assistant", "w " * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, place long, nth long, role string, text string").withColumn("segment", F.lit("clash"))
    formatted = chat_formatting.format_turns(turns)
    digests = {r["conv_id"]: r for r in chat_formatting.read_back(formatted).collect()}
    assert {c: (r["n_turns"], r["loss_chars"]) for c, r in digests.items()} == {1: (4, 9), None: (1, 1), 2: (2, 200_000)}
    assert digests[1]["turns_sha256"] == hashlib.sha256("user\na\nassistant\nb\\</turn>\n\n\n\n\n".encode()).hexdigest()
    whole = {r["conv_id"]: r for r in chat_formatting.samples(formatted).collect()}
    assert whole[1]["text"] == "### User: a</turn>\n### Assistant: b\\\\\\</turn></turn>\n### =: </turn>\n### =: </turn>\n"
    for c, r in digests.items():
        learned = "".join(chat_formatting.unescaped(whole[c]["text"][s : s + n]) for s, n in whole[c]["loss"])
        assert hashlib.sha256(learned.encode()).hexdigest() == r["loss_sha256"] and len(whole[c]["text"]) == r["formatted_chars"] and whole[c]["n_turns"] == r["n_turns"]
    assert of_frame(chat_formatting.read_back(chat_formatting.sorted_again(formatted.repartition(5)))) == of_frame(chat_formatting.read_back(formatted))
    assert chat_formatting.read_back(chat_formatting.format_turns(turns.limit(0))).count() == 0 == chat_formatting.samples(formatted.limit(0)).count()


@pytest.mark.parametrize("name", ["op12_streaming_infill", "op13_schema_chat"])
def test_hard_rows_agree_with_sql(spark, tmp_path, name):
    docs = [(k, t) for k, t in enumerate(HARD_TEXTS)] + [(None, "a\nb"), (3, "\n\n\n")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    talk = [(1, 0, "user", None), (1, 1, "assistant", "\\ ### </turn> </turn"), (1, 1, "assistant", "same turn"), (2, 0, "tool:x\\", "####"), (3, 0, None, ""), (4, 5, "assistant", "long " * 50_000)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    con = connection()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert of_frame(queries.QUERIES[name](spark, str(tmp_path))) == of_sql(con, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op12_streaming_infill", "op13_schema_chat"])
def test_control_texts_come_back(spark, name):
    found = queries.QUERIES[name](spark, SF_DIR).collect()
    if name == "op13_schema_chat":
        control = next(r for r in found if r["conv_id"] == -7)
        assert (control["n_turns"], control["loss_chars"]) == (2, 26) and control["loss_sha256"] == hashlib.sha256(b"\\### Assistant: </turn> ok").hexdigest()
    else:
        texts = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
        assert {r["doc_id"]: r["restored_sha256"] for r in found} == texts
