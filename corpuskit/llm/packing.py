"""Best-fit packing of documents into sequences by hierarchical residual packing.

Texts become ids and an end id; only documents longer than a sequence are cut.
Pieces are dealt over leaves by a hash and each leaf packs its own best-fit
(longest first; smallest room that suffices).  Nearly full bins are done.  The
others go up a tree as items: each node takes the bins of ``FAN_IN`` nodes
below it and packs them best-fit again, until one node is left.  A node hands
up its ``CARRY`` emptiest bins at most and finishes the rest as they are (they
lose no piece): after best-fit at most one bin of a node is not over half
full, so further up few of them could meet a partner.  So each task holds a
bounded number of items whatever the size of the input.

Null text counts as empty and still gives one piece (its end id).  Repeated
rows are packed as often as they occur.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, prepare, stored
from .tokenizing import coder

#: Pieces of a leaf, on average.
LEAF_ITEMS = 20_000
FAN_IN = 8
#: A bin with less room than this is done.
SLACK = 4
CARRY = 2048

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _cut(path: str, end_id: int, room: int, with_ids: bool):
    def run(batches):
        import pyarrow as pa
        c = coder(path)
        end = np.array([end_id], np.uint32)
        for b in batches:
            rows, ids = [], []
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), c.encode(b.column("text").to_pylist())):
                x = np.concatenate([np.frombuffer(raw, "<u4"), end])
                for k, at in enumerate(range(0, len(x), room)):
                    part = x[at:at + room]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.astype("<u4").tobytes())))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            cols = list(zip(*rows)) if rows else [[]] * 5
            out = {n: pa.array(v, t) for n, v, t in zip(("doc_id", "piece", "start", "length", "ids_crc32"), cols,
                                                        (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))}
            if with_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)
    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, room: int, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``room`` ids, stored once, with a row id ``item``."""
    prepare(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    cut = id_text(docs).mapInArrow(_cut(tokenizer_path, end_id, room, with_ids), schema)
    return stored(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the used size of each bin.  Items go
    longest first into the fullest bin that still takes them."""
    bins, offsets, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fits = rooms >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                rooms &= ~(1 << r)
        else:
            b, r = len(used), room
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += s
        if r - s:
            open_bins[r - s].append(b)
            rooms |= 1 << (r - s)
    return bins, offsets, used


def _carried(used: np.ndarray, room: int) -> np.ndarray:
    """Which bins of a node go up the tree."""
    up = used <= room - SLACK
    if up.sum() > CARRY:
        order = np.argsort(used, kind="stable")[:CARRY]
        up = np.zeros(len(used), bool)
        up[order] = True
    return up


def _pack_node(room: int, level: int, item: str, size: str, node: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, item], ascending=[False, True], kind="stable")
        bins, offsets, used = best_fit(pdf[size].to_numpy(), room)
        used = np.array(used, np.int64)
        base = (level << 56) | (int(pdf[node].iloc[0]) << 24)
        up = _carried(used, room)
        return pdf.assign(bin=base + bins, offset=offsets, used=used[bins], up=up[bins])
    return run


def pack(items: DataFrame, room: int, size: str = "length", leaf_items: int = LEAF_ITEMS) -> DataFrame:
    """``items`` (unique ``item``, sizes 1 to ``room``) with ``sequence_id`` and
    ``offset``; each sequence is filled gaplessly from 0."""
    n = items.count()
    nodes = max(1, -(-n // leaf_items))
    leaf = F.pmod(F.xxhash64("item"), F.lit(nodes)).cast("bigint")
    placed_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    placed = stored(items.withColumn("node", leaf).groupBy("node").applyInPandas(
        _pack_node(room, 0, "item", size, "node"),
        placed_schema + ", node bigint, bin bigint, offset bigint, used bigint, up boolean"), "placed")
    # first: a leaf's bin; bin, base: where it is now
    open_bins = placed.where("up").groupBy("bin", "node", "used").agg(F.count(F.lit(1)).alias("n"))
    moves = []
    level = 0
    while nodes > 1:
        level, nodes = level + 1, -(-nodes // FAN_IN)
        merged = stored(open_bins.select(F.col("bin").alias("old"), "used", F.floor(F.col("node") / FAN_IN).alias("node"))
                        .withColumnRenamed("used", "size").groupBy("node").applyInPandas(
                            _pack_node(room, level, "old", "size", "node"),
                            "old bigint, size bigint, node bigint, bin bigint, offset bigint, used bigint, up boolean"), "merged")
        moves.append(merged.select("old", F.col("bin").alias("to"), F.col("offset").alias("by")))
        open_bins = merged.where("up").groupBy("bin", "node", "used").agg(F.count(F.lit(1)).alias("n"))
    out = placed.drop("node", "used", "up").withColumnRenamed("bin", "sequence_id")
    if moves:
        total = moves[-1]
        for m in reversed(moves[:-1]):  # compose the moves, the narrow tables first
            nxt = total.select(F.col("old").alias("mid"), F.col("to").alias("to2"), F.col("by").alias("by2"))
            first = (m.join(nxt, m["to"] == nxt["mid"], "left")
                      .select("old", F.coalesce("to2", "to").alias("to"),
                              (F.col("by") + F.coalesce("by2", F.lit(0))).alias("by")))
            total = first.unionByName(total)
        out = (out.join(total, out["sequence_id"] == total["old"], "left")
                  .withColumn("sequence_id", F.coalesce("to", "sequence_id"))
                  .withColumn("offset", F.col("offset") + F.coalesce("by", F.lit(0))).drop("old", "to", "by"))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, room: int = 2048,
                   with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset``."""
    pieces = token_pieces(docs, tokenizer_path, end_id, room, with_ids)
    return pack(pieces, room).drop("item")
