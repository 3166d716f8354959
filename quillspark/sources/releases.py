"""Releases: several artefacts written by one pass over the rows, committed by a manifest that is written last, and verified against it.

A folder without a manifest is unfinished.  The manifest has a row for each file (bytes,
lines, digest), for each artefact (rows as they were counted while they were written) and
for each fact, such as the version or the digest of what the release was made from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.exchange import settled
from quillspark.sources.ranges import numbered_lines

MANIFEST = "kind string, name string, part string, bytes long, rows long, digest string"
_PLACE = r"((?:part=[^/]+/)?[^/]+)$"


def file_sums(spark: SparkSession, folder: str) -> DataFrame:
    """name, part, bytes, rows, digest of the files of lines under ``folder``; files are read in ranges, so of any size.

    The digest is the sum of the lines' SHA-256, each taken with its number: lines that
    change, move, come or go change it.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.regexp_extract("path", _PLACE, 1)
    files = listed.select(name.alias("name"), F.col("length").cast("long").alias("bytes"))
    word = F.conv(F.substring(F.sha2(F.concat_ws(":", "line", "value"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    lines = numbered_lines(spark, folder).groupBy(F.regexp_extract("file", _PLACE, 1).alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.sum(word).cast("string").alias("digest"))
    part = F.regexp_extract("name", r"^part=([^/]+)/", 1)
    return files.join(lines, "name", "left").select("name", part.alias("part"), "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("digest", F.lit("0")).alias("digest"))


def write_release(df: DataFrame, parts: dict[str, tuple[Column, list[str]]], folder: str, facts: dict[str, str] | None = None) -> DataFrame:
    """Writes ``df`` into a new folder as artefacts of JSON lines, sorted keys, and returns the manifest, which is written last.

    ``parts`` maps an artefact to which rows it has and their columns; a row may be in
    several.  All are written by one job, whose counts are observed; if the files hold
    other numbers of rows, the release is not committed.
    """
    spark = df.sparkSession
    lines = F.array(*[F.when(F.coalesce(where, F.lit(False)), F.struct(F.lit(name).alias("part"), F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("value"))) for name, (where, columns) in parts.items()])
    rows = df.select(F.explode(F.array_compact(lines)).alias("x")).select("x.part", "x.value")
    seen = Observation(f"release {folder}")
    counted = rows.observe(seen, F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("part") == name).alias(name) for name in parts])
    counted.write.mode("errorifexists").partitionBy("part").text(f"{folder}/parts")
    counts = seen.get
    files = settled(file_sums(spark, f"{folder}/parts").where("part <> ''"))
    held = {r["part"]: r["rows"] for r in files.groupBy("part").agg(F.sum("rows").alias("rows")).collect()}  # a row for each artefact
    if any(held.get(name, 0) != counts[name] for name in parts):
        raise ValueError(f"the artefacts of {folder} do not hold the rows that were counted")
    told = [("part", name, name, None, counts[name], None) for name in parts] + [("fact", k, None, None, None, v) for k, v in (facts or {}).items()]
    manifest = files.select(F.lit("file").alias("kind"), "name", "part", "bytes", "rows", "digest").unionByName(spark.createDataFrame(told, MANIFEST))
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_part(spark: SparkSession, folder: str, part: str, schema: str) -> DataFrame:
    """An artefact's rows; a release that is not committed is an error."""
    read_manifest(spark, folder)
    return spark.read.schema(schema).json(f"{folder}/parts/part={part}")


def verify_release(spark: SparkSession, folder: str, expected: dict[str, int] | None = None, facts: dict[str, str] | None = None) -> DataFrame:
    """part, name, rule, told, found of everything in which a release differs from its manifest, and that from what is expected: no rows for a sound one.

    Rules: no manifest; missing file, unlisted file, wrong size, changed (equal size, other
    lines); wrong count (an artefact's rows, by the manifest or as ``expected``); wrong fact.
    """
    ddl = "part string, name string, rule string, told string, found string"
    try:
        manifest = settled(read_manifest(spark, folder))
    except AnalysisException:
        return spark.createDataFrame([(None, folder, "no manifest", None, None)], ddl)
    listed = manifest.where("kind = 'file'").select("name", "part", "bytes", "rows", "digest")
    try:
        here = settled(file_sums(spark, f"{folder}/parts").where("part <> ''"))
    except AnalysisException:  # the folder is gone
        here = listed.limit(0)
    now = here.select("name", *[F.col(c).alias(f"{c}_now") for c in ("part", "bytes", "rows", "digest")])
    both = listed.join(now, "name", "full")
    rule = (
        F.when(F.col("bytes_now").isNull(), "missing file").when(F.col("bytes").isNull(), "unlisted file").when(F.col("bytes") != F.col("bytes_now"), "wrong size").when(F.col("digest") != F.col("digest_now"), "changed")
    )
    files = both.withColumn("rule", rule).where("rule is not null").select(F.coalesce("part", "part_now").alias("part"), "name", "rule", F.col("bytes").cast("string").alias("told"), F.col("bytes_now").cast("string").alias("found"))
    counts = manifest.where("kind = 'part'").select("part", F.col("rows").alias("told")).join(here.groupBy("part").agg(F.sum("rows").alias("found")), "part", "left").fillna(0, ["found"])
    found = [files, counts.where("told <> found").select("part", F.lit(None).cast("string").alias("name"), F.lit("wrong count").alias("rule"), F.col("told").cast("string").alias("told"), F.col("found").cast("string").alias("found"))]
    for kind, wanted, rule, column in (("part", expected, "wrong count", "rows"), ("fact", facts, "wrong fact", "digest")):
        if wanted:
            asked = spark.createDataFrame([(k, str(v)) for k, v in sorted(wanted.items())], "name string, told string")
            held = asked.join(manifest.where(F.col("kind") == kind).select("name", F.col(column).cast("string").alias("found")), "name", "left").where("not told <=> found")
            found.append(held.select(F.when(F.lit(kind == "part"), F.col("name")).alias("part"), F.when(F.lit(kind == "fact"), F.col("name")).alias("name"), F.lit(rule).alias("rule"), "told", "found"))
    return reduce(DataFrame.unionByName, found).distinct()
