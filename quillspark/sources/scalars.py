"""Every scalar of a project's JSON and CSV files, and what of it equals a candidate's question, URL or image.

JSON is descended level by level: the containers of a level are exploded into the next, until
there are none, so that work follows the depth of the data and each level is spread over
all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import compatibility_fold
from quillspark.operators.exchange import settled, skew_join, unused
from quillspark.sources.ranges import numbered_lines

LONGEST_URL = 2048


def scalar_values(df: DataFrame, column: str) -> DataFrame:
    """The other columns of ``df`` with path, kind and value of each scalar in the VARIANT ``column``.

    Paths are as in $.turns[0].text, kinds as the types of VARIANT; a text is given as it is,
    another value as its JSON; nulls, and empty containers, have no rows.
    """
    kept = [c for c in df.columns if c != column]
    at, node = unused("path", df.drop(column)), unused("_node", df)
    level, found = df.select(*kept, F.lit("$").alias(at), F.col(column).alias(node)), []
    while True:
        kind = F.schema_of_variant(node)
        typed = settled(level.select("*", F.coalesce(F.regexp_extract(kind, "^[A-Z]+", 0), F.lit("VOID")).alias("kind")))
        value = F.when(F.col("kind") == "STRING", F.try_variant_get(node, "$", "string")).otherwise(F.to_json(node))
        found.append(typed.where(~F.col("kind").isin("OBJECT", "ARRAY", "VOID")).select(*kept, at, "kind", value.alias("value")))
        inner = typed.where(F.col("kind").isin("OBJECT", "ARRAY"))
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, found)
        below = inner.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(node).outer()))
        plain = F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$")
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(plain, F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit('."'), "key", F.lit('"')))
        level = below.select(*kept, F.concat(at, step).alias(at), F.col("value").alias(node))


def json_scalars(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """file, line, path, kind, value of all scalars of the lines of JSON under ``path``; and file, line, text of the lines that are no JSON."""
    lines = numbered_lines(spark, path).where(~F.col("value").rlike(r"^\s*$")).withColumn("row", F.try_parse_json("value"))
    return scalar_values(lines.where("row is not null").select("file", "line", "row"), "row"), lines.where("row is null").select("file", "line", F.col("value").alias("text"))


def csv_scalars(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """file, line, path (the column's name in the file's first line), kind, value of all cells of the CSV files under ``path``, each with a header of its own; a record is a line."""
    lines = numbered_lines(spark, path).where(~F.col("value").rlike(r"^\s*$"))
    wide = lines.groupBy().agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(separator), F.lit(""))))).first()[0]
    width = 1 + (wide or 0)
    cells = F.from_csv("value", ", ".join(f"c{k} string" for k in range(width)), {"sep": separator, "escape": '"'})
    split = lines.select("file", "line", F.posexplode(F.array(*[cells[f"c{k}"] for k in range(width)])).alias("place", "value")).where("value is not null")
    first = settled(lines.groupBy("file").agg(F.min("line").alias("head")))
    placed = skew_join(split, first, ["file"], "inner")
    names = settled(placed.where("line = head").select("file", "place", F.col("value").alias("path")))
    return skew_join(placed.where("line > head").drop("head"), names, ["file", "place"], "inner").select("file", "line", "path", F.lit("STRING").alias("kind"), "value")


def plain_text(text: Column) -> Column:
    """A text in its compatibility form without case, signs and repeated blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(compatibility_fold(F.coalesce(text, F.lit(""))), "_", " "), r"(?U)[^\w]+", " "))


def overlap(candidates: DataFrame, scalars: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """id, file, match of ``candidates`` (id, question, url, image) that ``scalars`` (file, kind, value) repeat.

    A text equals a question in its plain form, and a URL or an image id but for case; empty
    ones match nothing.  In ``broken`` lines (file, text) URLs count wherever they stand.
    """
    keys = [("question", plain_text(F.col("question"))), ("url", F.lower("url")), ("image", F.lower("image"))]
    wanted = candidates.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("match"), c.alias("key")) for m, c in keys])).alias("k")).select("id", "k.match", "k.key").where("key <> ''")
    texts = scalars.where("kind = 'STRING'").select("file", "value").distinct()
    told = [("question", plain_text(F.col("value"))), ("url", F.lower("value")), ("image", F.lower("value"))]
    seen = texts.select("file", F.explode(F.array(*[F.struct(F.lit(m).alias("match"), c.alias("key")) for m, c in told])).alias("k")).select("file", "k.match", "k.key")
    if broken is not None:
        runs = broken.select("file", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(https?://[^\s\"'<>]+)"), 1)).alias("run")).distinct()
        ends = F.sequence(F.lit(8), F.least(F.length("run"), F.lit(LONGEST_URL)))
        starts = runs.select("file", F.lit("url").alias("match"), F.explode(F.transform(ends, lambda n: F.substring("run", F.lit(1), n))).alias("key"))
        seen = seen.unionByName(skew_join(starts, wanted.where("match = 'url'").select("key").distinct(), ["key"], "left_semi"))
    return skew_join(wanted, seen.distinct(), ["match", "key"], "inner").select("id", "file", "match").distinct()

