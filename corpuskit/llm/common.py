"""Shared pieces of the training-data operators: input columns, tables in the
shared folder, and vectorised word hashes over Arrow string buffers."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: Rows and bytes of one Arrow batch handed to Python; keeps a worker's memory flat.
BATCH_ROWS = "2000"
BATCH_BYTES = str(16 << 20)

#: Bytes that separate words: blank and \\t \\n \\v \\f \\r.
BLANK_BYTES = bytes([32, 9, 10, 11, 12, 13])
BLANK_CHARS = " \t\n\x0b\x0c\r"

_MULT = np.uint64(0x9E3779B97F4A7C15)


def prepare(spark: SparkSession) -> SparkSession:
    """Shared folder, the package on the executors, and Arrow batch sizes."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and whole ``text`` (null: empty); all other columns go, so
    their names cannot clash with an operator's own."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_digest(col: str = "text") -> Column:
    """64-bit digest of a text (null: of the empty text); with the id it names a row,
    as rows may share an id or have none."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def keyed_text(docs: DataFrame) -> DataFrame:
    """As ``id_text``, with the text's ``digest``."""
    return id_text(docs).withColumn("digest", text_digest())


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lineage
    cut that survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- words of many texts at once ------------------------------------------------

def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: A value per byte, the same in every process; A-Z share those of a-z.
_BYTE_VALUES = _table(20240229)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWER]

#: Not a blank: the words ``[^\\x20\\x09-\\x0D]+``.
NON_BLANK = np.ones(256, bool)
NON_BLANK[list(BLANK_BYTES)] = False
#: Letters, digits and all non-ASCII bytes: words without their punctuation.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 1024), _MULT, np.uint64)
            p[0] = 1
            _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit reaches every output bit)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 byte offsets of an Arrow string column without nulls."""
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    off = off.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def _fold(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of ``values`` that begin at ``starts``."""
    lens = np.diff(np.append(starts, len(values)))
    pos = np.arange(len(values)) - np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        values = values * _power_table(int(pos.max()) + 1)[pos]
        return mix(np.add.reduceat(values, starts) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def cut_words(data: np.ndarray, off: np.ndarray, member: np.ndarray = NON_BLANK):
    """The bytes of all words of the texts, where each word starts among them,
    and the index of each text's first word (n + 1 entries)."""
    inside = member[data]
    begin = inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        cut = off[:-1][off[:-1] < len(data)]
        begin[cut] = inside[cut]
    starts = np.flatnonzero(begin)
    return data[inside], np.flatnonzero(begin[inside]), np.searchsorted(starts, off)


def hash_words(data: np.ndarray, off: np.ndarray, member: np.ndarray = NON_BLANK, lower: bool = True):
    """``(hashes, first)``: 64-bit hashes of all words (``lower``: A-Z as a-z) and
    the index of each text's first word (n + 1 entries)."""
    chars, starts, first = cut_words(data, off, member)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    return _fold((_LOWER_VALUES if lower else _BYTE_VALUES)[chars], starts), first


def hash_beginnings(data: np.ndarray, off: np.ndarray, n_bytes: int, member: np.ndarray = NON_BLANK):
    """As ``hash_words``, of the first ``n_bytes`` bytes of the words."""
    chars, starts, first = cut_words(data, off, member)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lens = np.diff(np.append(starts, len(chars)))
    keep = np.arange(len(chars)) - np.repeat(starts, lens) < n_bytes
    return _fold(_LOWER_VALUES[chars[keep]], (np.cumsum(keep) - 1)[starts]), first


def hash_endings(data: np.ndarray, off: np.ndarray, n_bytes: int, member: np.ndarray = NON_BLANK):
    """As ``hash_words``, of the last ``n_bytes`` bytes of the words."""
    chars, starts, first = cut_words(data, off, member)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lens = np.diff(np.append(starts, len(chars)))
    keep = np.arange(len(chars)) >= np.repeat(starts + lens - n_bytes, lens)
    begin = np.cumsum(np.minimum(lens, n_bytes)) - np.minimum(lens, n_bytes)
    return _fold(_LOWER_VALUES[chars[keep]], begin), first


#: Classes of bytes: capital, small or non-ASCII letter, digit, else the byte itself.
_CLASSES = np.arange(256, dtype=np.uint8)
_CLASSES[65:91], _CLASSES[97:123], _CLASSES[128:], _CLASSES[48:58] = 1, 2, 2, 3


def hash_shapes(data: np.ndarray, off: np.ndarray):
    """As ``hash_words``, of the words' shapes: their byte classes, runs as one."""
    chars, starts, first = cut_words(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    c = _CLASSES[chars]
    keep = np.ones(len(c), bool)
    keep[1:] = c[1:] != c[:-1]
    keep[starts] = True
    return _fold(_BYTE_VALUES[c[keep]], (np.cumsum(keep) - 1)[starts]), first


def text_blocks(batches, columns, block_bytes: int = 1 << 20):
    """Slices of Arrow batches with at most ``block_bytes`` of text (or one
    text), as ``(slice, data, off)``; numpy temporaries stay some 40 x that."""
    for batch in batches:
        data, off = text_buffers(batch.column(columns))
        lo, n = 0, len(off) - 1
        while lo < n:
            hi = int(np.searchsorted(off, off[lo] + block_bytes, side="right")) - 1
            hi = min(max(hi, lo + 1), n)
            yield batch.slice(lo, hi - lo), data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            lo = hi
