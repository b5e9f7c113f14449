"""Corpus union, interleave, reproducible split, shuffle and batching.

Randomness is a seeded md5 draw of the row key, so a split or a shuffle is
the same in every job, for any partitioning, and equal to the DuckDB oracle.
Ranks come from ``global_rank`` (range-partitioned sort, per-partition
offsets), never from a window over all rows.

A row's place among all rows is its identity, not the caller's key: null and
repeated keys lose and multiply nothing.  Rows of one key are ordered by a hash
of their other columns; rows that are equal in all columns are interchangeable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.hashing import hash_key
from ..functions.joins import bounded_broadcast
from ..functions.ranking import global_rank, rank_within


def concat_corpora(parts: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of corpora with the same columns, tagged by ``origin``;
    duplicates are kept."""
    tagged = [df.withColumn("origin", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def interleave(df: DataFrame, source_col: str, order_cols) -> DataFrame:
    """Round-robin over sources (rank r of every source, then r+1, ...),
    stopping when the smallest source is used up.  Adds ``rank`` (within the
    source) and ``position`` (in the interleaved order, from 0)."""
    ranked = rank_within(df, [source_col], order_cols)
    sizes = df.groupBy(source_col).count().agg(F.min("count").alias("smallest"), F.count(F.lit(1)).alias("n")).first()
    n_sources, smallest = sizes["n"], sizes["smallest"]
    kept = ranked.where(F.col("rank") <= F.lit(smallest))
    src_rank = global_rank(df.select(F.col(source_col).alias("_source")).distinct(), ["_source"], "_src")
    sources, _ = bounded_broadcast(src_rank)
    return (kept.join(sources, F.col(source_col).eqNullSafe(F.col("_source")))
                .withColumn("position", ((F.col("rank") - 1) * n_sources + F.col("_src") - 1).cast("bigint"))
                .drop("_src", "_source"))


def _others(df: DataFrame, key_cols):
    """A hash of the columns beside the key."""
    rest = [c for c, kind in df.dtypes if c not in key_cols and "map<" not in kind and kind != "variant"]
    return F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")


def split_key(key_cols, seed: int = P.SPLIT_SEED):
    return F.md5(hash_key(F.lit(seed), *[F.col(c) for c in key_cols]))


def train_test_split(df: DataFrame, key_cols, train_size: float = P.TRAIN_SIZE, seed: int = P.SPLIT_SEED) -> DataFrame:
    """Exact ``floor(train_size * n)`` rows go to ``train``, the rest to
    ``test``; membership depends only on the seed and the row keys, so the
    training and the evaluation job agree."""
    key_cols = list(key_cols)
    # one sort of the whole rows: nothing to join back, and materialised
    keyed = df.withColumns({"_k": F.unhex(split_key(key_cols, seed)), "_o": _others(df, key_cols)})
    ranked = global_rank(keyed, ["_k", *key_cols, "_o"], "_r", drop=["_k", "_o"])
    n_train = int(train_size * ranked.count())
    return (ranked.withColumn("split", F.when(F.col("_r") <= n_train, F.lit("train")).otherwise(F.lit("test")))
                  .withColumn("row_idx", F.when(F.col("_r") <= n_train, F.col("_r") - 1)
                              .otherwise(F.col("_r") - n_train - 1).cast("bigint"))
                  .drop("_r"))


def shuffle_order(df: DataFrame, key_cols, epoch: int = 0, seed: int = P.SPLIT_SEED) -> DataFrame:
    """U4: a seeded permutation per epoch; adds ``position`` from 0."""
    key_cols = list(key_cols)
    k = F.md5(hash_key(F.lit(seed), F.lit(epoch), *[F.col(c) for c in key_cols]))
    ranked = global_rank(df.withColumns({"_k": k, "_o": _others(df, key_cols)}), ["_k", *key_cols, "_o"], "_r")
    return (ranked.withColumn("epoch", F.lit(epoch))
                  .withColumn("position", (F.col("_r") - 1).cast("bigint")).drop("_k", "_o", "_r"))


def assign_batches(df: DataFrame, index_col: str = "row_idx", batch_size: int = P.EVAL_BATCH_SIZE) -> DataFrame:
    """Consecutive slices of ``batch_size`` rows; the last may be short."""
    return df.withColumn("batch", F.floor(F.col(index_col) / batch_size).cast("bigint"))
