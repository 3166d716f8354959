"""Recursive scans against json and csv of the standard library, and overlap by plain sets; invariants of rows full of nulls."""

import csv
import json
import random

from pyspark.sql import functions as F

from quillspark.operators import invariants
from quillspark.sources import scalars


def walk(value, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}" if k.replace("_", "a").isalnum() and not k[0].isdigit() else f'{path}."{k}"')
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")
    elif value is not None:
        yield path, value


def test_scalars_of_files(spark, tmp_path):
    random.seed(3)
    value = lambda d: random.choice(["t", "", "é 漢", 3, True, None, [], {}]) if d > 4 or random.random() < 0.3 else random.choice([[value(d + 1) for _ in range(3)], {k: value(d + 1) for k in random.sample(["a", "b_1", "c d", "9", "url"], 2)}])
    records = [value(0) for _ in range(60)]
    (tmp_path / "a.jsonl").write_text("\n".join([*map(json.dumps, records), "", "{broken http://X.org/p?q=1 text", "  "]))
    found, broken = scalars.json_scalars(spark, str(tmp_path))
    got = sorted(((r["line"], r["path"], r["value"]) for r in found.collect()))
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    assert got == sorted((k, p, text(v)) for k, r in enumerate(records, 1) for p, v in walk(r))
    assert [(r["line"], r["text"][:7]) for r in broken.collect()] == [(62, "{broken")]


def test_cells_of_files(spark, tmp_path):
    held = {"a": [["id", "na,me"], ["1", 'x "y"'], ["2", "é"]], "b": [["k"], ["z"], ["w"]], "c": [["only", "head"]]}
    for name, rows in held.items():
        with (tmp_path / f"{name}.csv").open("w", newline="") as f:
            csv.writer(f).writerows(rows)
    got = {(r["file"][-5], r["line"], r["path"], r["value"]) for r in scalars.csv_scalars(spark, str(tmp_path)).collect()}
    assert got == {(n, k, c, v) for n, rows in held.items() for k, r in enumerate(rows[1:], 2) for c, v in zip(rows[0], r, strict=True)}


def test_overlap(spark):
    wanted = spark.createDataFrame([(1, "What is_this?", "HTTP://A.org/x", "IMG1"), (2, "", "", ""), (3, "ﬁne  day", None, "img2"), (4, None, "http://a.org/xy", None)], "id long, question string, url string, image string")
    seen = spark.createDataFrame([("f", "STRING", "what IS this"), ("f", "STRING", "what is this!"), ("g", "STRING", "http://a.org/X"), ("g", "STRING", "Fine day"), ("g", "BIGINT", "img2"), ("h", "STRING", "img1"), ("h", "STRING", "")], "file string, kind string, value string")
    broken = spark.createDataFrame([("i", "{see http://a.org/xyz and"), ("j", "a.org/xy")], "file string, text string")
    got = {(r["id"], r["file"], r["match"]) for r in scalars.overlap(wanted, seen, broken).collect()}
    assert got == {(1, "f", "question"), (1, "g", "url"), (1, "h", "image"), (3, "g", "question"), (1, "i", "url"), (4, "i", "url")}
    assert scalars.overlap(wanted, seen.limit(0)).count() == 0


def test_invariants_of_null_rows(spark):
    for ddl, check, first in ((invariants.TRAJECTORY, invariants.trajectory_faults, "unknown route"), (invariants.EXAMPLE, invariants.example_faults, "invalid split")):
        df = spark.range(1).select(F.from_json(F.lit("{}"), ddl).alias("r")).select("r.*")
        faults = [f["rule"] for f in check(df).first()["faults"]]
        assert faults[0] == first and "empty identifier" in faults and check(df.limit(0)).count() == 0


def test_violations_name_lines(spark, tmp_path):
    good = {
        "trajectory_id": "t", "source_data_id": "s", "route": "direct_answer", "question": "q", "canonical_answer": "a  <b> & c", "accepted_answers": ["a  <b> & c"],
        "steps": [{"transition": "initial_to_direct_answer", "state": [{"role": "user", "content": "q", "trainable": False}], "target": "<reason>r</reason><answer>a &lt;b&gt; &amp; c</answer>"}],
    }
    bad = json.loads(json.dumps(good))
    bad["steps"][0]["state"].append({"role": "user", "content": " ", "trainable": True})
    bad["steps"].append(good["steps"][0])
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps(good), "", json.dumps(bad), "[]", json.dumps({**good, "route": "x", "schema_version": "protocol-sft-v0.1"})]))
    found = invariants.line_violations(spark, str(tmp_path)).collect()
    assert {(r["line"], r["step"], r["rule"]) for r in found} == {(3, None, "wrong number of steps"), (3, 0, "empty message"), (3, 0, "trainable history"), (4, None, "not an object"), (5, None, "unknown route")}
