"""Joins whose strategy is chosen by a checked size, with a skew-safe fallback.

* ``bounded_broadcast``: broadcast a side only after counting its rows and
  estimating its bytes (a partial aggregate per partition; give it a stored table).
* ``lookup_join``: join a large occurrence table to a table that is unique on
  its key (one row per distinct word).  Bounded tables are broadcast; larger
  ones are shuffle-joined with *hot keys salted*: keys holding at least
  1/``HOT_KEY_SHARE`` of all occurrences (so at most that many keys) are
  spread over ``salts`` tasks on the big side, and their single table row is
  copied to each of those salts.
* ``lookup_arrays``: replace the entries of an array column by their values in a
  table.  The rows stay whole: blocks of rows meet the table with their distinct
  entries only, so no row per entry is shuffled, sorted or put together again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

# A side is broadcast only below this many rows and bytes (checked, not guessed).
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 128 << 20
# What a row costs beside its strings and arrays.
ROW_BYTES = 32
# Keys with at least 1/HOT_KEY_SHARE of the occurrences are salted.
HOT_KEY_SHARE = 1000
DEFAULT_SALTS = 64
# Rows of a block in ``lookup_arrays``: 2^15.
BLOCK_BITS = 15


def _row_bytes(df: DataFrame):
    """Estimated bytes of a row: strings by length, arrays by their entries."""
    total = F.lit(ROW_BYTES)
    for name, kind in df.dtypes:
        if kind == "string":
            total = total + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind == "array<string>":
            total = total + F.coalesce(F.octet_length(F.array_join(name, "")) + 16 * F.size(name), F.lit(0))
        elif kind.startswith("array"):
            total = total + 16 * F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))
    return total.cast("bigint")


def fits_broadcast(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    n, size = df.select(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``(F.broadcast(df), True)`` if ``df`` is proven small, else ``(df, False)``."""
    if fits_broadcast(df, max_rows):
        return F.broadcast(df), True
    return df, False


def lookup_join(big: DataFrame, table: DataFrame, key: str, how: str = "left",
                freq: DataFrame | None = None, salt_cols=None, salts: int = DEFAULT_SALTS,
                max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` to ``table`` (unique on ``key``).

    ``freq`` is a ``(key, f)`` pre-aggregate of ``big`` used to find hot keys;
    ``salt_cols`` are columns of ``big`` hashed to pick a salt."""
    small, is_bc = bounded_broadcast(table, max_broadcast_rows)
    if is_bc:
        return big.join(small, key, how)
    salt_cols = salt_cols or [c for c in big.columns if c != key]
    if not salt_cols:
        # nothing but the key to take a salt from: every key's rows are equal
        salt_cols = [F.monotonically_increasing_id()]
    if freq is None:
        freq = big.groupBy(key).agg(F.count(F.lit(1)).alias("f"))
    total = freq.select(F.sum("f")).scalar()
    # at most HOT_KEY_SHARE rows: bounded, so the broadcast is safe
    hot = F.broadcast(freq.where(F.col("f") * HOT_KEY_SHARE >= total)
                          .select(key, F.lit(True).alias("_hot")))
    b = (big.join(hot, key, "left")
            .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt_cols), F.lit(salts)))
                        .otherwise(F.lit(0)).cast("int"))
            .drop("_hot"))
    t = (table.join(hot, key, "left")
              .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                             .otherwise(F.array(F.lit(0)))))
              .drop("_hot"))
    return b.join(t, [key, "_salt"], how).drop("_salt")


def _gather(values: pa.Array, at: np.ndarray, n: np.ndarray) -> pa.Array:
    """Lists of ``n`` entries each: ``values`` at ``at``; entries that are lists are joined."""
    if pa.types.is_list(values.type):
        size = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(size) - size
        own = size[at]
        ends = np.concatenate([[0], np.cumsum(own)])
        at = np.repeat(first[at] - ends[:-1], own) + np.arange(ends[-1])
        values, cuts = values.flatten(), ends[np.concatenate([[0], np.cumsum(n)])]
    else:
        cuts = np.concatenate([[0], np.cumsum(n)])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values.take(pa.array(at)))


def lookup_arrays(rows: DataFrame, col: str, table: DataFrame, key: str, value: str, missing=None) -> DataFrame:
    """``rows`` with the entries of ``col`` replaced by their ``value`` in ``table``
    (unique on ``key``), ``missing`` where it has none; values that are arrays are joined.

    ``col`` is an array, or a string of entries parted by one blank each.  ``_row``
    numbers the stored rows (``monotonically_increasing_id``, dropped here): 2^``BLOCK_BITS`` in a
    row make a block, whose distinct entries meet the table and come back to
    it.  An entry stands once in a block, so no key is hot."""
    text = dict(rows.dtypes)[col] == "string"
    entries = F.split(col, " ") if text else F.col(col)
    block = F.shiftright("_row", BLOCK_BITS).alias("_block")
    # a block lies in one partition: its set is made before the shuffle, and stays dealt by block
    sets = rows.select(block, F.explode(entries).alias(key)).groupBy("_block").agg(F.collect_set(key).alias("_set"))
    used = sets.select("_block", F.explode("_set").alias(key))
    small, _ = bounded_broadcast(table.select(key, value).where(F.col(value).isNotNull()))
    found = used.join(small, key).select("_block", key, value)
    others = [f for f in rows.schema.fields if f.name not in (col, "_row")]
    kind = table.schema[value].dataType
    out = StructType([*others, StructField(col, kind if kind.typeName() == "array" else ArrayType(kind))])

    def run(mine: pa.Table, found: pa.Table) -> pa.Table:
        x = mine.column(col).combine_chunks()
        if text:
            lists = pc.split_pattern(pc.fill_null(x, ""), " ")
            n = np.where(pc.equal(pc.fill_null(x, ""), "").to_numpy(zero_copy_only=False), 0,
                         pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            flat = flat.filter(pc.not_equal(flat, ""))
        else:
            n = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
            flat = x.flatten()
        values = found.column(value).combine_chunks()
        at = pc.fill_null(pc.index_in(flat, value_set=found.column(key).combine_chunks()), len(values))
        values = pa.concat_arrays([values, pa.array([missing], values.type)])
        columns = [mine.column(f.name) for f in others]
        return pa.Table.from_arrays([*columns, _gather(values, at.to_numpy(zero_copy_only=False).astype(np.int64), n)], names=out.names)

    mine = rows.withColumn("_block", block).drop("_row")
    return mine.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(run, out)
