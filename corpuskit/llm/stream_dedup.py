"""Exact deduplication as a stateful stream (DataFrame functions only).

Texts are equal when they are identical without blanks (blank, \\t \\n \\v \\f \\r).
Each row is reduced once to its digest, stable identifier and content locator;
this narrow feed is read as a stream and aggregated by digest into a state
that never expires and lives on the executors' disks (RocksDB), checkpointed
to the shared folder.  State per digest: the row that stays (most code points
in the original text, then smallest id), its locator and the number of rows.
A stream that continues later finds the state where it stood.

A digest with more than one row is a hit; the normalised bytes of its rows are
fetched by identifier and compared in full.  Rows whose bytes differ under one
digest are grouped by their bytes instead.

Null text counts as empty; empty texts are equal to each other.  A null id
counts as larger than any other.  Of repeated rows with one id, one is kept
(``row`` tells which).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, prepare, shared_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: All state stores of an executor share this much memory; the rest is on disk.
STATE_CONF = {PROVIDER: ROCKSDB,
              "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
              "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
              # many small stores: do not set disk aside for logs in advance
              "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}

FEED = "row bigint, doc_id bigint, digest binary, n_chars int, locator string"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANK_CHARS, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def write_feed(docs: DataFrame, path: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Append ``docs`` to the feed folder, one narrow row per document."""
    (docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest(normalised(F.col("text"))).alias("digest"),
                 F.length(F.coalesce(F.col("text"), F.lit(""))).alias("n_chars"), F.input_file_name().alias("locator"))
         .write.mode("append").parquet(path))


def run_stream(spark, feed_path: str, state_path: str, checkpoint: str, files_per_trigger: int | None = None) -> None:
    """Take everything new in the feed into the state and write the groups that
    changed to ``state_path`` (one folder a micro-batch, so a repeated batch
    overwrites its own)."""
    old = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(FEED)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        best = F.struct("n_chars", (-F.col("doc_id")).alias("neg_id"), (-F.col("row")).alias("neg_row"), "locator")
        state = reader.parquet(feed_path).groupBy("digest").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n"))

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{state_path}/batch={number}")

        query = (state.writeStream.outputMode("update").foreachBatch(save)
                      .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


STATE = ("digest binary, best struct<n_chars:int,neg_id:bigint,neg_row:bigint,locator:string>, n bigint, batch int")


def current_state(spark, state_path: str) -> DataFrame:
    """The last state of each digest."""
    changes = spark.read.schema(STATE).parquet(state_path)
    return (changes.groupBy("digest").agg(F.max(F.struct("batch", "best", "n")).alias("s"))
                   .select("digest", (-F.col("s.best.neg_id")).alias("keep_id"), (-F.col("s.best.neg_row")).alias("keep_row"),
                           F.col("s.best.locator").alias("keep_locator"), F.col("s.n").alias("group_size")))


def _hit_texts(docs: DataFrame, rows: DataFrame, digest) -> DataFrame:
    """Id, digest and normalised text of the rows whose digest was hit."""
    hits = rows.where("group_size > 1").select(F.col("doc_id").alias("hit_id")).distinct()
    # ids are spread evenly, whatever the sizes of the groups; the narrow side
    # is the one held in memory, so texts are not sorted
    found = docs.select("doc_id", "text").join(hits.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
    norm = found.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), normalised(F.col("text")).alias("norm"))
    return norm.withColumn("digest", digest(F.col("norm")))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_trigger: int | None = None) -> DataFrame:
    """``row, doc_id, digest, keep_id, keep_locator, group_size, kept`` of every row of ``docs``."""
    spark = prepare(docs.sparkSession)
    feed, state, checkpoint = (shared_path(spark, f"dedup-{x}") for x in ("feed", "state", "checkpoint"))
    write_feed(docs, feed, digest)
    spark.createDataFrame([], STATE).drop("batch").write.parquet(f"{state}/batch=-1")
    run_stream(spark, feed, state, checkpoint, files_per_trigger)
    rows = spark.read.schema(FEED).parquet(feed).join(current_state(spark, state), "digest")
    rows = rows.select("row", "doc_id", "n_chars", "digest", "keep_id", "keep_row", "keep_locator", "group_size")
    # full bytes of the hits: copies meet map-side in the partial aggregate
    texts = _hit_texts(docs, rows, digest)
    contents = texts.groupBy("digest", "norm").agg(F.lit(1).alias("one"))
    collided = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest")
    path = shared_path(spark, "dedup-collided")
    collided.write.parquet(path)
    collided = spark.read.schema("digest binary").parquet(path)
    if not collided.isEmpty():
        rows = _split_collided(rows, texts, collided)
    return rows.select("row", "doc_id", "digest", "keep_id", "keep_locator", "group_size",
                       (F.col("row") == F.col("keep_row")).alias("kept"))


def _split_collided(rows: DataFrame, texts: DataFrame, collided: DataFrame) -> DataFrame:
    """Rows of collided digests, grouped by their bytes."""
    norm = texts.join(collided, "digest", "left_semi").select("doc_id", "digest", "norm").distinct()
    bad = rows.join(collided, "digest", "left_semi").select("row", "doc_id", "n_chars", "digest")
    bad = bad.join(norm.withColumnRenamed("doc_id", "text_id").withColumnRenamed("digest", "text_digest"),
                   F.col("doc_id").eqNullSafe(F.col("text_id")) & (F.col("digest") == F.col("text_digest")))
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg_id"), (-F.col("row")).alias("neg_row")))
    groups = bad.groupBy("digest", "norm").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    split = (bad.select("row", "doc_id", "n_chars", "digest", "norm").join(groups, ["digest", "norm"])
                .select("row", "doc_id", "n_chars", "digest", (-F.col("best.neg_id")).alias("keep_id"),
                        (-F.col("best.neg_row")).alias("keep_row"), F.lit(None).cast("string").alias("keep_locator"), "group_size"))
    return rows.join(collided, "digest", "left_anti").unionByName(split)


def dedup_table(docs: DataFrame) -> DataFrame:
    """One row per document: who stays for it, how many are equal, whether it stays."""
    return deduplicate(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    kept = deduplicate(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest"))
    keyed = docs.withColumn("_digest", sha256(normalised(F.col("text"))))
    out = keyed.join(kept.distinct().hint("shuffle_hash"),
                     F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_digest")), "left_semi")
    ids = docs.select(F.count(F.lit(1)).alias("n"), F.countDistinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("d")).first()
    if ids["n"] > ids["d"]:  # repeated rows of one id
        out = out.dropDuplicates(["doc_id", "_digest"])
    return out.drop("_digest")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
