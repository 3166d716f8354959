"""Helpers shared by the training-data operators; what other operators need too is in ``quillspark.operators.exchange``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.exchange import connected_components, shared_folder, skew_join, unused
from quillspark.operators.exchange import settled as checkpointed

__all__ = ["SPACES", "WORD", "checkpointed", "connected_components", "rows_of", "shared_folder", "skew_join", "small", "unused", "written"]

#: Bytes that count as white space in every contract of this subpackage: [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to a new folder beside the checkpoints, and read again: for whole texts, which it compresses."""
    folder = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` a few at a time, so that what Python makes of whole texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A local table of rows whose number a parameter bounds (never the data)."""
    return spark.createDataFrame(rows, schema)
