"""The thin queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_projected_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.projected_knn import nearest

    table = _table(spark, sf_dir, "embeddings")
    return nearest(table, table["vec_id"] % 100 == 0, k=10)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.common import shared_path
    from sightline.llm.warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"), shared_path(spark, "archives"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new cache for each call: what one call returns doesn't hang on another."""
    from sightline.llm.common import shared_path
    from sightline.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), shared_path(spark, "token-cache"), limit=2048)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.common import shared_path
    from sightline.llm.lm_scoring import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), shared_path(spark, "lm"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.common import shared_path
    from sightline.llm.token_binary import encode_to_files, read_files

    return read_files(encode_to_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), shared_path(spark, "token-blocks"), end_id=2))


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.bag_minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sightline.llm.byte_bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.host_quality import judge

    return judge(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.toxicity import detect

    return detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_projected_knn, op2_warc, op3_token_counts, op4_lm_scoring, op5_token_binary, op6_bag_minhash, op7_byte_bpe, op8_host_quality, op9_mixing, op10_toxicity)}

from sightline.llm.oracles import ORACLE  # noqa: E402, F401
