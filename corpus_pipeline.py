"""Training-corpus pipeline over documents: quality rules, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result to the shared
folder and reads it back as the next one's documents.  The last stage returns the shard table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronowarn.llm.decontaminate import drop_contaminated
from chronowarn.llm.mixing import apply_mix
from chronowarn.llm.near_dedup import keep_one
from chronowarn.llm.quality_rules import keep_sound
from chronowarn.llm.sharding import byte_shards
from chronowarn.llm.shared import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep."""
    return keep_sound(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8."""
    return keep_one(docs, shingle=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, thinned toward the target weights of expected domain tokens."""
    return apply_mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), reject=True)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document, in 40 shards of near-equal bytes."""
    return byte_shards(docs, 40).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: the robust estimates, latent search and classifier have no SQL form; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
