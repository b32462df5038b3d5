"""The ten operators as queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chronoweave.llm import bpe

    return bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, nulls=None)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm import license_scan

    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm import html_extract

    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm import line_dedup

    return line_dedup.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm import ann

    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm import quality_cnn

    return quality_cnn.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm import toxicity

    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm import setsketch

    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm import mixing

    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.llm import vector_dedup

    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from chronoweave.llm import oracle

    return oracle.all_sql()
