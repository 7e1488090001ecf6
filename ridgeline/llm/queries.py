"""The corpus operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, html_extract, importance, langid, license_scan, line_quality, negatives, ngram_join, packing, suffix_levels, url_filter
from ridgeline.llm.common import table
from ridgeline.llm.kd_shards import kd_shards
from ridgeline.llm.mixing import cube_mix


def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix(table(spark, sf_dir, "documents")).drop("source", "key")


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_naive_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_prefix_orders_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_minhash_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


def op8_min_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(table(spark, sf_dir, "documents"), 40)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op10_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_levels.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "spans")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key", "n_words")


def op12_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), by_word=True).drop("key", "copy")


def op13_coordinate_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), "vec_id % 100 = 0")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_cube_mixing, op2_link_trust, op3_naive_bayes_langid, op4_template_decontamination, op5_prefix_orders_join, op6_minhash_license_scan, op7_line_quality, op8_min_cut_extraction, op9_kd_sharding, op10_suffix_levels, op11_importance_resampling, op12_exact_complement_packing, op13_coordinate_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op6_minhash_license_scan": license_scan.sql(), "op7_line_quality": line_quality.SQL, "op11_importance_resampling": importance.SQL, "op13_coordinate_negatives": negatives.SQL}
