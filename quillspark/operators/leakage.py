"""Leakage of reference rows into candidates: equal keys, near hashes, reworded texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.exchange import skew_join
from quillspark.operators.grouping import near_hashes, similar_across


def audit(candidates: DataFrame, references: DataFrame, keys: list[str], radius: int = 5, least: float = 0.9, most: int = 20, bits: int = 64) -> DataFrame:
    """candidate, reference, kind of the rows (id, the ``keys``, hash, tokens) that leak.

    A kind is the name of an equal key, "near_hash" (within ``radius`` bits) or
    "similar_tokens" (Jaccard similarity of ``least`` or more but unequal, the ``most``
    nearest candidates of a reference).  Of references that share a key, the least id stands
    for all, so that no key pairs all with all; null keys are equal to none.
    """
    found = []
    for key in keys:
        # Digests meet, not the keys, which may be whole texts.
        digested = lambda df: df.where(F.col(key).isNotNull()).select("id", F.unhex(F.sha2(F.col(key).cast("string"), 256)).alias("digest"))  # noqa: B023, E731
        first = digested(references).groupBy("digest").agg(F.min("id").alias("reference"))
        met = skew_join(digested(candidates).withColumnRenamed("id", "candidate"), first, ["digest"], "inner")
        found.append(met.select("candidate", "reference", F.lit(key).alias("kind")))
    hashed = lambda df: df.where(F.col("hash").isNotNull()).select("id", "hash")
    near = near_hashes(hashed(candidates), hashed(references), radius, bits)
    found.append(near.select(F.col("a").alias("candidate"), F.col("b").alias("reference"), F.lit("near_hash").alias("kind")))
    worded = lambda df: df.select("id", F.col("tokens").alias("s"))
    similar = similar_across(worded(references), worded(candidates), least, most)
    found.append(similar.select(F.col("b").alias("candidate"), F.col("a").alias("reference"), F.lit("similar_tokens").alias("kind")))
    return reduce(DataFrame.unionByName, found)


def clean(candidates: DataFrame, leaks: DataFrame) -> DataFrame:
    """Candidates that no leak names."""
    return skew_join(candidates, leaks.select(F.col("candidate").alias("id")).distinct(), ["id"], "left_anti")
