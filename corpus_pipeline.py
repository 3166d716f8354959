"""A corpus pipeline: toxicity, exact copies, near copies, source mixing, packing.

STAGES are functions (spark, docs, sf_dir) -> DataFrame; each works on all rows that the
one before kept, and all but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import checkpointed
from quillspark.llm.exact_dedup import keep_one
from quillspark.llm.fair_mixing import apply_mix
from quillspark.llm.noisy_channel_toxicity import drop_toxic
from quillspark.llm.simhash_dedup import keep_one_of_each
from quillspark.llm.slack_packing import pack


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those predicted toxic, as ``drop_toxic`` says for nulls, long texts and empty tables."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts (``keep_one``)."""
    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, and all without words (``keep_one_of_each``)."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them; those without words are in no mix (``apply_mix``)."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each text; null texts are empty and one id long (``pack``)."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL cannot tokenize, decode or compare fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; each stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
