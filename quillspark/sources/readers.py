"""Readers with declared schemas, required columns and unique keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """JSON lines, blank ones skipped; a bad line fails the read, or is dropped if not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def tolerant_ids(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """id of each line of JSON that is an object with one of ``keys``, the first of them it has; other lines are skipped."""
    lines = spark.read.text(path).withColumn("row", F.from_json("value", "map<string,string>"))
    return lines.select(F.coalesce(*[F.nullif(F.col("row")[k], F.lit("")) for k in keys]).alias("id")).where("id is not null")


def reference_hashes(spark: SparkSession, path: str, keys: tuple[str, str]) -> DataFrame:
    """line, raw, hash of lines of JSON: a number under the first key, or a hexadecimal text under the second."""
    number, text = (F.get_json_object("value", f"$.{k}") for k in keys)
    found = spark.read.text(path).select(F.col("value").alias("line"), F.coalesce(number, text).alias("raw"), F.coalesce(number.cast("long"), F.conv(text, 16, 10).cast("long")).alias("hash"))
    return found.where("hash is not null")


def read_wrapped_json(spark: SparkSession, path: str, keys: tuple[str, ...] = ("data", "records", "items", "examples")) -> DataFrame:
    """Rows of JSON documents that are arrays of objects, or objects that hold one under a known key."""
    found = spark.read.option("multiLine", True).json(path)
    inner = [k for k in keys if k in found.columns and found.schema[k].dataType.typeName() == "array"]
    return found.select(F.inline(F.coalesce(*map(F.col, inner)))) if inner else found


def read_records(spark: SparkSession, path: str, columns: list[str], key: str | None = None) -> DataFrame:
    """Parquet with its required columns alone; a missing column or a key that repeats is an error."""
    found = spark.read.parquet(path)
    if missing := [c for c in columns if c not in found.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    found = found.select(*columns)
    if key is not None and (twice := found.groupBy(key).count().where("count > 1").first()) is not None:
        raise ValueError(f"{key} {twice[0]} repeats in {path}")
    return found


def read_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True) -> DataFrame:
    """CSV with a header or without: a first line that names the columns is one.

    Cells may hold line ends; if they do not, say so (``multi_line`` false): then a large file is read by many tasks.
    """
    reader = lambda: spark.read.option("multiLine", multi_line).option("escape", '"')
    first = reader().csv(path).first()
    header = first is not None and [x for x in first] == schema.fieldNames()
    return reader().schema(schema).option("header", header).csv(path)


def indexed(df: DataFrame, key: str) -> DataFrame:
    """``df`` with row_index, its rank from 0 by key: range partitions, their sizes, then a rank within each."""
    from pyspark.sql import Window

    from quillspark.operators.grouping import settled

    placed = settled(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    earlier = sizes.select("_part").join(sizes.select(F.col("_part").alias("p"), "n"), F.col("p") < F.col("_part"), "left").groupBy("_part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return placed.join(earlier, "_part").withColumn("row_index", F.col("_before") + nth - 1).drop("_part", "_before")


def tar_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, member, content of the files in TAR archives; each archive is read by one task, member by member."""
    import io
    import tarfile

    def members(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(suffix) and ".." not in m.name.split("/"):
                            yield pd.DataFrame([(name, m.name, tar.extractfile(m).read())], columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, content binary")
