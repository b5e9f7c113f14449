"""Token counts through a digest cache.

The cache is a table keyed by the digest of a content and the digest of the
tokenizer file.  A run joins its texts' digests to the stored counts, encodes
one text of each digest that misses, and appends those counts to the cache.

Normalised content: null becomes the empty text and nothing else changes,
because the vocabulary keeps every byte and any other normalisation would
change counts.  Rows with equal texts share one count; repeated rows and null
ids keep their rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, prepare, shared_path
from .tokenizing import coder

CACHE_SCHEMA = "tokenizer_digest string, content_digest binary, n_bytes bigint, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: sha-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _count(path: str):
    def run(batches):
        import pyarrow as pa
        c = coder(path)
        for b in batches:
            n = [len(ids) // 4 for ids in c.encode(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("content_digest"), b.column("n_bytes"), pa.array(n, pa.int64())],
                                             names=["content_digest", "n_bytes", "n_tokens"])
    return run


def cached_counts(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs``; ``cache_path``
    grows by the contents that it did not hold."""
    spark = prepare(docs.sparkSession)
    version = tokenizer_digest(tokenizer_path)
    texts = id_text(docs).withColumn("content_digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    keys = texts.select("doc_id", "content_digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    known = (spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
                  .where(F.col("tokenizer_digest") == version).select("content_digest"))
    # one row of each missing content, chosen on the narrow columns: copies
    # meet in the map-side aggregate, never with their texts
    chosen = (keys.groupBy("content_digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("m"))
                  .join(known.distinct(), "content_digest", "left_anti")
                  .select(F.col("content_digest").alias("chosen_digest"), F.col("m.doc_id").alias("chosen_id")))
    # distinct ids spread evenly, so texts are shuffled without a hot key; the
    # narrow side is the one held in memory
    missing = texts.join(chosen.hint("shuffle_hash"),
                         F.col("doc_id").eqNullSafe(F.col("chosen_id"))
                         & (F.col("content_digest") == F.col("chosen_digest")), "left_semi")
    counted = (missing.select("content_digest", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
                      .mapInArrow(_count(tokenizer_path), "content_digest binary, n_bytes bigint, n_tokens bigint"))
    (counted.select(F.lit(version).alias("tokenizer_digest"), "content_digest", "n_bytes", "n_tokens")
            .write.mode("append").parquet(cache_path))
    # repeated rows with one id and text may have been encoded twice
    counts = (spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
                   .where(F.col("tokenizer_digest") == version)
                   .groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens")))
    return keys.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens")


def count_query(spark, docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """Counts of all documents, from a cache that starts empty."""
    counts = cached_counts(docs, tokenizer_path, shared_path(spark, "token-count-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
