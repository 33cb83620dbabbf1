"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality

    return quality(table(spark, sf_dir, "documents"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import checked_surrogates, key_of

    return checked_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark), "n_entities")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import repeated_units

    return repeated_units(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import licences

    return licences(table(spark, sf_dir, "documents")).drop("matches")


def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import packed_pieces

    return packed_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_gam import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import benchmark_matches

    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_golay import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_outliers, op2_pii_surrogates, op3_token_counts, op4_line_dedup, op5_license_scan, op6_curve_packing, op7_quality_gam, op8_edit_decontamination, op9_suffix_dedup, op10_simhash_golay, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import license_scan, line_dedup

    return {"op4_line_dedup": line_dedup.oracle(), "op5_license_scan": license_scan.oracle()}
