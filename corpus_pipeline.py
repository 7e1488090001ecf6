"""The corpus pipeline: documents through five operators, each stage written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, kd_shards, langid, mixing, ngram_join
from ridgeline.llm.common import saved, table, without


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: texts without a letter, and those no language explains better than all others together, go."""
    return langid.keep_identified(docs, langid.learn(docs.filter(~langid.held_out())), least=0.5)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return ngram_join.keep_first(docs, ngram_join.similar_rows(docs, k=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.contaminated_rows(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, saved(found.select(F.col("key").alias("__key")).distinct()))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the balanced mix of sources takes it."""
    return mixing.apply_mix(docs, mixing.cube_mix(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, 0 to 39, of nearly equal bytes."""
    return kd_shards.with_shard(docs, 40)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

#: The stages learn, search and sample; SQL can't express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
