"""Releases: every way in which one can be broken gives a violation, a sound one none."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources import releases as R


def release(spark, folder):
    df = spark.range(60).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("é\n"), F.col("id").cast("string"))).alias("text")).repartition(3)
    parts = {"all": (F.lit(True), ["text", "id"]), "some": (F.col("id") < 7, ["id"]), "none": (F.lit(None).cast("boolean"), ["id"]), "odd": (F.col("id") % 2 == 1, ["id", "text"])}
    return R.write_release(df, parts, folder, {"version": "1", "source": "x"})


def told(found):
    return sorted(((r["part"], r["rule"]) for r in found.collect()), key=repr)


def test_sound_release(spark, tmp_path):
    manifest = release(spark, f"{tmp_path}/r")
    assert {r["name"]: r["rows"] for r in manifest.where("kind = 'part'").collect()} == {"all": 60, "some": 7, "none": 0, "odd": 30}
    assert R.verify_release(spark, f"{tmp_path}/r", {"all": 60, "none": 0}, {"version": "1"}).isEmpty()
    back = R.read_part(spark, f"{tmp_path}/r", "all", "id long, text string").collect()
    assert sorted((r["id"], r["text"]) for r in back) == [(k, None if k % 3 == 0 else f"é\n{k}") for k in range(60)]
    with pytest.raises(Exception, match="(?i)exists"):
        release(spark, f"{tmp_path}/r")


def files(folder, part):
    return sorted((folder / "r" / "parts" / f"part={part}").glob("part-*"))


@pytest.mark.parametrize("how", ["flip", "swap", "cut", "gone", "more", "part gone", "unfinished", "empty"])
def test_broken_release(spark, tmp_path, how):
    release(spark, f"{tmp_path}/r")
    file = files(tmp_path, "all")[0]
    lines = file.read_text().splitlines(keepends=True)
    for crc in (tmp_path / "r").rglob(".*.crc"):
        crc.unlink()
    if how == "flip":
        file.write_text("".join(lines).replace('"id":', '"ie":', 1))
    elif how == "swap":
        file.write_text("".join([lines[1], lines[0], *lines[2:]]))
    elif how == "cut":
        file.write_text("".join(lines[:-1]))
    elif how == "gone":
        file.unlink()
    elif how == "more":
        (file.parent / "part-extra.txt").write_text("{}\n{}\n")
    elif how == "part gone":
        for f in files(tmp_path, "some"):
            f.unlink()
    elif how == "empty":
        for f in (tmp_path / "r" / "parts").rglob("part-*"):
            f.unlink()
    else:
        for f in (tmp_path / "r" / "manifest").iterdir():
            f.unlink()
        (tmp_path / "r" / "manifest").rmdir()
    expected = {
        "flip": [("all", "changed")], "swap": [("all", "changed")], "cut": [("all", "wrong count"), ("all", "wrong size")], "gone": [("all", "missing file"), ("all", "wrong count")],
        "more": [("all", "unlisted file"), ("all", "wrong count")], "part gone": [("some", "missing file"), ("some", "wrong count")], "unfinished": [(None, "no manifest")],
    }
    found = told(R.verify_release(spark, f"{tmp_path}/r"))
    if how == "empty":
        assert {x for x in found if x[1] == "wrong count"} == {("all", "wrong count"), ("odd", "wrong count"), ("some", "wrong count")} and ("all", "missing file") in found
    else:
        assert sorted(set(found), key=repr) == sorted(expected[how], key=repr)


def test_expectations(spark, tmp_path):
    release(spark, f"{tmp_path}/r")
    found = R.verify_release(spark, f"{tmp_path}/r", {"all": 61, "lost": 1}, {"version": "2", "source": "x", "other": "y"})
    assert told(found) == sorted([("all", "wrong count"), ("lost", "wrong count"), (None, "wrong fact"), (None, "wrong fact")], key=repr)
