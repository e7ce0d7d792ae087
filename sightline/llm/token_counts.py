"""Token counts through a digest cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import common
from sightline.llm.encoders import encoder, file_digest

CACHE_SCHEMA = "tokenizer string, content string, n_tokens long"


def content_digest(text: Column, collapse_space: bool = True) -> Column:
    """Digest of the content as the tokenizer sees it. Runs of ASCII white space count as one blank where the tokenizer drops them anyway."""
    return F.sha2(F.regexp_replace(text, common.SPACE + "+", " ") if collapse_space else text, 256)


def read_cache(spark, path: str | None) -> DataFrame | None:
    if path is None:
        return None
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs(doc_id, text).

    The stored counts at cache_path (a Parquet table: tokenizer digest, content digest, n_tokens) are joined by digest; only the
    distinct contents that are missing there are encoded, whole, and appended. A null text counts as empty (0 tokens); repeated
    rows and null ids each keep their row; an empty table gives no rows; other columns are ignored. Copies of one content meet
    in one row before the shuffle of texts, so a large group of copies costs one encoding. A content that two runs have stored
    at once counts once.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer_path)
    collapse = not tokenizer_path.endswith(".model") and encoder(tokenizer_path).by_chunk
    text = common.text_of(docs)
    keyed = docs.select(docs["doc_id"].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(text, collapse).alias("content"))
    contents = docs.select(content_digest(text, collapse).alias("content"), text.alias("text"))

    stored = read_cache(spark, cache_path)
    if stored is not None:
        contents = contents.join(stored.where(F.col("tokenizer") == version).select("content"), "content", "left_anti")
    order = Window.partitionBy("content").orderBy(F.length("text"), "text")
    misses = contents.withColumn("copy", F.row_number().over(order)).where("copy = 1").select("content", "text")

    def make():
        count = encoder(tokenizer_path).count

        def each(batch):
            contents, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in common.slices(texts):
                yield {"tokenizer": [version] * (b - a), "content": contents[a:b], "n_tokens": count(texts[a:b])}

        return each

    common.arrow_map(misses, make, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
