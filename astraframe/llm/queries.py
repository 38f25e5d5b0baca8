"""The queries of this subpackage: name to (spark, sf_dir) -> DataFrame, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOKENIZER = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no media column: the bytes of each whole text are one, as 8-bit samples."""
    from .chroma import align

    docs = documents(spark, sf_dir)
    return align(docs.select("doc_id", docs["text"].cast("binary").alias("media")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(documents(spark, sf_dir), texts=False)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(documents(spark, sf_dir)).drop("factors")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), words=4)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(documents(spark, sf_dir), tokenizer_path())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_chroma_fingerprints, op2_line_dedup, op3_pii, op4_quality_rules, op5_mixing, op6_secret_scan, op7_substring_dedup, op8_near_dedup, op9_token_counts, op10_packing)}
