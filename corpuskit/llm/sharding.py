"""Sharding by weighted rendezvous hashing (DataFrame functions only).

Every shard draws a number for a record's key, -ln(u) / weight with u from the
md5 of ``key:shard``, and the lowest draw takes the record.  Draws of the old
shards do not change when one is added, so the new shard only takes records
into itself: its weight's share of them.

Law ``key``: the id and the shards decide.  Rows with one id (repeated rows)
share a shard; a null id is hashed as the empty text; a null text has no
bytes.  ``slot`` numbers a shard's rows from 0 in id order (null first), found
from a range-partitioned sort, so no shard's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

#: Hex digits of the md5 that make a draw (52 bits, exact in a double).
DIGITS = 13


def draw(key: Column, shard: int, weight: float = 1.0) -> Column:
    h = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}")).cast("binary"))
    u = (F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16 ** DIGITS))
    return -F.log(u) / F.lit(float(weight))


def shard_of(key: Column, weights: list[float]) -> Column:
    """Struct (draw, shard) of the winning shard; equal draws go to the lower number."""
    draws = [F.struct(draw(key, i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return draws[0] if len(draws) == 1 else F.least(*draws)


def assign(df: DataFrame, key: str, weights: list[float], grown_weight: float = 1.0) -> DataFrame:
    """``df`` with ``shard`` and, with one shard more, ``grown_shard``."""
    n = len(weights)
    best = df.withColumn("_best", shard_of(F.col(key), weights))
    extra = F.struct(draw(F.col(key), n, grown_weight).alias("draw"), F.lit(n).alias("shard"))
    return (best.withColumn("shard", F.col("_best.shard"))
                .withColumn("grown_shard", F.least(F.col("_best"), extra)["shard"]).drop("_best"))


def with_slots(df: DataFrame, shard: str, key: str) -> DataFrame:
    """Adds ``slot``: the position within the shard, in key order."""
    ordered = stored(df.orderBy(shard, key).withColumn("_part", F.spark_partition_id())
                       .withColumn("_at", F.monotonically_increasing_id()), "slots")
    runs = ordered.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per shard and per sorted partition
    runs = runs.select(shard, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (ordered.join(F.broadcast(runs), [shard, "_part"])
                   .withColumn("slot", F.col("_base") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_base"))


def shard_documents(docs: DataFrame, weights: list[float]) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return with_slots(assign(rows, "doc_id", weights), "shard", "doc_id").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, weights: list[float], path: str) -> None:
    """Write ``docs`` as one folder per shard; a shard of any size is written by
    many tasks."""
    assign(docs, "doc_id", weights).drop("grown_shard").write.partitionBy("shard").parquet(path)


def oracle_sql(n: int) -> str:
    def draw_sql(i: int) -> str:
        return f"-ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{i}'), 1, {DIGITS}))::bigint + 0.5) / {16 ** DIGITS}.0)"
    draws = ", ".join(draw_sql(i) for i in range(n))
    return f"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) r(i))),
d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, [{draws}] AS s, {draw_sql(n)} AS extra FROM documents),
c AS (
  SELECT doc_id, (length(h) // 2 + 8)::bigint AS size, list_position(s, list_min(s)) - 1 AS shard,
         CASE WHEN extra < list_min(s) THEN {n} ELSE list_position(s, list_min(s)) - 1 END AS grown_shard,
         xor(list_reduce([4294967295::bigint] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint),
                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::bigint) AS text_crc32
  FROM d, crc_table)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::int AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard::int AS grown_shard
FROM c
"""
