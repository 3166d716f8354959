"""Writers: sorted-key JSON lines, tables that are never overwritten, manifests of digests, redacted provenance."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

REPORT_ROWS = 10_000


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines whose keys are in sorted order."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def write_new(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet in a folder that must not exist yet."""
    df.write.mode("errorifexists").partitionBy(*(by or [])).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_dataset(rows: DataFrame, rejected: DataFrame, folder: str, split: str = "split") -> DataFrame:
    """Writes a dataset into a folder that must not exist: all accepted rows, the rows of each split, the rejected ones and a manifest.

    Returns the manifest (path, bytes, sha256), which is written last: a folder without one
    is unfinished.
    """
    write_json_lines(rows, f"{folder}/trajectories")
    rows.select(*sorted(rows.columns)).write.mode("errorifexists").partitionBy(split).json(f"{folder}/splits")
    write_json_lines(rejected, f"{folder}/rejected")
    found = manifest(rows.sparkSession, folder).where(~F.col("path").rlike(r"/[._][^/]*$"))
    found.write.mode("errorifexists").parquet(f"{folder}/manifest")
    return rows.sparkSession.read.parquet(f"{folder}/manifest")


def append_log(rows: DataFrame, folder: str, batch: str) -> bool:
    """Adds the rows of a batch to an append-only log of JSON lines, once: a batch that is there already is left alone (False)."""
    try:
        write_json_lines(rows, f"{folder}/batch={batch}")
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        return False
    return True


def read_log(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All rows of an append-only log with their batch."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", StringType())])).json(folder)


def without_secrets(df: DataFrame, pattern: str = r"(?i)key|token|secret|password|authorization") -> DataFrame:
    """``df`` with the values of columns of secret names overwritten."""
    import re

    return df.select(*[F.lit("[redacted]").alias(c) if re.search(pattern, c) else F.col(c) for c in df.columns])


def report(df: DataFrame, title: str) -> str:
    """A result of REPORT_ROWS rows at most as a Markdown table; a larger one is an error."""
    found = df.limit(REPORT_ROWS + 1).collect()
    if len(found) > REPORT_ROWS:
        raise ValueError(f"a report has {REPORT_ROWS} rows at most")
    rows = [df.columns, ["---"] * len(df.columns), *[[json.dumps(x) if isinstance(x, dict | list) else str(x) for x in r] for r in found]]
    return f"## {title}\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"
