"""Exact deduplication by content-defined chunk recipes.

A text without white space is cut where a rolling window of its own bytes says so, so
equal passages give equal chunks wherever they stand.  Each distinct chunk travels once,
is compared byte for byte with all chunks of its hash, and thereby earns an identifier;
texts are then equal when their ordered identifier lists are.  Long documents move only
as lists of 16 bytes a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACES, checkpointed, skew_join, small, unused

LEAST, USUAL, MOST = 256, 1024, 8192  # bytes of a chunk; USUAL is a power of two
_CONTINUATION = bytes(range(0x80, 0xC0))
_GEAR = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``: set by the last 16 bytes, LEAST to MOST apart; none for no bytes."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # h[i] becomes the sum over 16 bytes of gear << age
        h[step:] += h[:-step] << np.uint32(step)
    cuts = np.flatnonzero((h >> np.uint32(16)) & np.uint32(USUAL - 1) == 0) + 1
    ends, last = [], 0
    for cut in [*cuts.tolist(), n]:
        while cut - last > MOST:
            last += MOST
            ends.append(last)
        if cut - last >= LEAST and cut < n:
            ends.append(last := cut)
    return ends if last == n else [*ends, n]


def _chunks(data: bytes) -> Iterator[bytes]:
    start = 0
    for end in chunk_ends(data):
        yield data[start:end]
        start = end


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        points, recipes, digests = [], [], []
        for raw in _texts(batch, "text"):
            data = raw.translate(None, SPACES)
            points.append(len(raw.translate(None, _CONTINUATION)))
            recipes.append(b"".join(map(xxhash.xxh3_128_digest, _chunks(data))))
            digests.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(points, pa.int64()), pa.array(recipes, pa.binary()), pa.array(digests)],
            ["doc_id", "n_points", "recipe", "text_sha256"],
        )


def _distinct_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        found = {c for raw in _texts(batch, "text") for c in _chunks(raw.translate(None, SPACES))}
        content = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(map(xxhash.xxh3_128_digest, content), pa.binary()), pa.array(content, pa.binary())], ["chunk", "content"]
        )


def chunk_conflicts(docs: DataFrame) -> DataFrame:
    """Hashes (chunk) shared by chunks of unequal bytes: those that identify nothing. Usually none."""
    found = docs.select("text").mapInArrow(_distinct_chunks, "chunk binary, content binary")
    return found.groupBy("chunk").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low <> high").select("chunk")


def recipes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, n_points, recipe (verified identifiers in order), text_sha256.

    A text with an unverifiable chunk gets its whole SHA-256 for a recipe, as do all its equals.
    """
    listed = checkpointed(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_recipes, "doc_id long, n_points long, recipe binary, text_sha256 string")
        .withColumn("row_id", F.monotonically_increasing_id())
    )
    conflicts = checkpointed(chunk_conflicts(docs.select(F.col("text").cast("string").alias("text"))))
    if conflicts.isEmpty():
        return listed
    chunks = listed.where(F.length("recipe") > 0).select("row_id", F.explode(F.expr("transform(sequence(1, length(recipe), 16), i -> substring(recipe, i, 16))")).alias("chunk"))
    unsure = skew_join(chunks, conflicts.withColumn("hit", F.lit(1)), ["chunk"], "inner").select("row_id").distinct().withColumn("unsure", F.lit(True))
    return listed.join(unsure, "row_id", "left").withColumn("recipe", F.when(F.col("unsure"), F.encode(F.concat(F.lit("w"), "text_sha256"), "utf-8")).otherwise(F.col("recipe"))).drop("unsure")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]; null counts
    as empty.  The row with the most code points in its original text stays, then the
    smallest doc_id (null last); of fully repeated rows one stays.  Very long texts are
    compared whole, chunk by chunk; other columns are ignored; an empty table gives no rows.
    """
    listed = recipes(docs)
    best = F.min(F.struct((-F.col("n_points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
    groups = listed.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).where("group_size > 1")
    groups = groups.select("recipe", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"))
    return skew_join(listed, groups, ["recipe"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: those ``exact_duplicates`` keeps.

    Of rows that repeat doc_id and text, one stays.  Null texts count as empty; columns of
    any name stay as they are; very long texts are compared whole; an empty table gives no rows.
    """
    repeated, digest, stays = (unused(n, docs) for n in ("_repeated", "_digest", "_stays"))
    decided = checkpointed(exact_duplicates(docs))
    ids = decided.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("kept").cast("int")).alias("stay"))
    dropped = ids.where("stay < rows").select("doc_id", (F.col("rows") > 1).alias(repeated))
    joined = skew_join(docs, dropped, ["doc_id"], "left")
    clean = joined.where(F.col(repeated).isNull()).drop(repeated)
    if ids.where("stay < rows and rows > 1").isEmpty():
        return clean
    # Rows that share a doc_id: which of them stays is told by their normalised texts.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    again = joined.where(F.col(repeated)).withColumn(digest, F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", ""), 256))
    kept = decided.where("kept").select("doc_id", F.col("text_sha256").alias(digest)).distinct().withColumn(stays, F.lit(True))
    again = skew_join(again, kept, ["doc_id", digest], "inner")
    best = F.max_by(F.struct(*docs.columns), F.struct(F.length(text), text))
    return clean.unionByName(again.groupBy("doc_id", digest).agg(best.alias(stays)).select(f"{stays}.*"))
