"""From raw documents to token ids: toxic and poor documents go, one of each group of near copies stays, sources are mixed to
target weights, and what is left is encoded.

All stages: an empty table gives no rows, columns of any name pass through, and a null or blank text is one without words: toxicity keeps it, quality
rejects it, near_dedup keeps each such row, mixing keeps it once and byte_bpe gives it no ids (blanks their own). Null sources are one source, null ids are ids like others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import common
from sightline.llm.bag_minhash import keep_one
from sightline.llm.byte_bpe import round_trip
from sightline.llm.host_quality import keep_documents
from sightline.llm.mixing import mixed_documents
from sightline.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the classifier learns from docs and the labels of sf_dir outside the held-out fold. Repeated rows
    all stay or go; without labels of toxic documents all stay."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose source does, go. Repeated rows each count for their source, and all stay or go."""
    return keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of the least doc_id stays, null ids last, and of its repeated rows one. A document of any length is compared whole."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, up to three times; repeated rows are documents of their own, ties of size are told apart by hash."""
    return mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, repeated or not."""
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, memo=MEMO)


#: Pre-tokens that a worker remembers during a task of byte_bpe: it has held the earlier stages, and an executor has little memory left.
MEMO = 60_000

STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: Training a classifier and minhash are not SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
