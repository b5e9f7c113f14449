"""Quality classifier: random-indexing word vectors pooled per document, then a
two-layer network with temperature-calibrated probabilities.

Words and word shapes are hashed into ``UNITS`` units.  Each unit has a fixed
sparse ternary index vector; its context vector is the sum of the index
vectors of its neighbours over the whole corpus (integer sums, so their order
does not matter).  That table has a fixed size: every task adds up its own,
the blocks of all tasks are added by a grouped aggregation, and the sum
(``UNITS`` x ``DIMS`` numbers) is all that reaches the driver.  A document is
the mean and the spread of its units' vectors, the likeness of neighbouring
words, and its length.

The network is fitted on at most ``TRAIN_ROWS`` labelled documents, the
smallest by a hash of their id, a fifth of which only fit the temperature.
Null and empty texts are scored as documents without words.  Without labels of
both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_shapes, hash_words, id_crc, id_text, keyed_text, prepare, stored, text_blocks, text_digest

UNITS = 1 << 13
DIMS = 64
NONZEROS = 2
WINDOW = 2
#: Rows of the context table that travel as one block.
BLOCK_UNITS = 256
#: Tasks' tables are first added up in so many lanes.
LANES = 64
#: Bound on the labelled documents that the network is fitted on.
TRAIN_ROWS = 20_000
HIDDEN = 32
FEATURES = 4 * DIMS + 3


def _index_vectors():
    rng = np.random.default_rng(7)
    return rng.integers(0, DIMS, (UNITS, NONZEROS)), rng.choice([-1.0, 1.0], (UNITS, NONZEROS))


def _units(data: np.ndarray, off: np.ndarray):
    """Unit numbers of words and of shapes, and the texts' first words."""
    half = np.uint64(UNITS // 2)
    words, first = hash_words(data, off, lower=False)
    shapes, _ = hash_shapes(data, off)
    return (words % half).astype(np.int64), (shapes % half + half).astype(np.int64), first


def _contexts(batches):
    import pyarrow as pa
    place, sign = _index_vectors()
    total = np.zeros(UNITS * DIMS)
    for _, data, off in text_blocks(batches, "text"):
        words, shapes, first = _units(data, off)
        text = np.repeat(np.arange(len(off) - 1), np.diff(first))
        for units in (words, shapes):
            for step in range(1, WINDOW + 1):
                same = text[step:] == text[:-step]
                left, right = units[:-step][same], units[step:][same]
                for a, b in ((left, right), (right, left)):
                    at = a[:, None] * DIMS + place[b]
                    total += np.bincount(at.ravel(), sign[b].ravel(), UNITS * DIMS)
    if total.any():
        blocks = total.astype("<i8").reshape(-1, BLOCK_UNITS * DIMS)
        lane = TaskContext.get().partitionId() % LANES
        yield pa.RecordBatch.from_pydict({"lane": pa.array([lane] * len(blocks), pa.int32()),
                                          "block": pa.array(range(len(blocks)), pa.int32()),
                                          "sums": pa.array([b.tobytes() for b in blocks], pa.binary())})


def _add_blocks(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BLOCK_UNITS * DIMS, np.int64)
    for pdf in pdfs:
        for b in pdf["sums"]:
            total += np.frombuffer(b, "<i8")
    yield pd.DataFrame({"block": [key[-1]], "sums": [total.astype("<i8").tobytes()]})


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit-length context vectors of all units, from all documents."""
    parts = id_text(docs).select("text").mapInArrow(_contexts, "lane int, block int, sums binary")
    lanes = parts.groupBy("lane", "block").applyInPandas(_add_blocks, "block int, sums binary")
    sums = lanes.groupBy("block").applyInPandas(_add_blocks, "block int, sums binary").collect()
    table = np.zeros((UNITS, DIMS))
    for r in sums:
        table[r["block"] * BLOCK_UNITS:(r["block"] + 1) * BLOCK_UNITS] = np.frombuffer(r["sums"], "<i8").reshape(-1, DIMS)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    return table.astype(np.float32)


def pooled(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Feature row of each text."""
    words, shapes, first = _units(data, off)
    n = np.diff(first)
    out = np.zeros((len(n), FEATURES), np.float32)
    full = n > 0
    if full.any():
        starts, count = first[:-1][full], n[full][:, None]
        for k, units in enumerate((words, shapes)):
            v = table[units]
            mean = np.add.reduceat(v, starts) / count
            square = np.add.reduceat(v * v, starts) / count
            out[full, 2 * k * DIMS:(2 * k + 1) * DIMS] = mean
            out[full, (2 * k + 1) * DIMS:(2 * k + 2) * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
            if k == 0 and len(v) > 1:  # how alike neighbours are, and how often they are equal
                text = np.repeat(np.arange(len(n)), n)
                same = text[1:] == text[:-1]
                alike = np.einsum("ij,ij->i", v[1:], v[:-1])
                pairs = np.maximum(n - 1, 1)
                out[:, -3] = np.bincount(text[1:][same], alike[same], len(n)) / pairs
                out[:, -2] = np.bincount(text[1:][same], (units[1:] == units[:-1])[same], len(n)) / pairs
    out[:, -1] = np.log1p(n) / 10
    return out


class Network:
    """Two layers, standardised inputs, a temperature on the logit."""

    def __init__(self, prior: float):
        p = min(max(prior, 1e-6), 1 - 1e-6)
        self.weights, self.bias, self.temperature = None, float(np.log(p / (1 - p))), 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.bias)
        mean, spread, w1, b1, w2, b2 = self.weights
        return np.maximum((x - mean) / spread @ w1 + b1, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, tune: np.ndarray, epochs: int = 30, rate: float = 2e-3) -> "Network":
        """``tune`` marks the rows that fit the temperature and nothing else."""
        if len(np.unique(y[~tune])) < 2:
            return self
        rng = np.random.default_rng(11)
        a, b = x[~tune].astype(np.float64), y[~tune]
        mean, spread = a.mean(0), a.std(0) + 1e-3
        a = (a - mean) / spread
        p = [rng.normal(0, 1 / np.sqrt(a.shape[1]), (a.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(a))
            for lo in range(0, len(a), 256):
                i = order[lo:lo + 256]
                h = np.maximum(a[i] @ p[0] + p[1], 0)
                z = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40)))
                d = (z - b[i]) / len(i)
                dh = d[:, None] * p[2] * (h > 0)
                grads = [a[i].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
                t += 1
                for q, g, mm, vv in zip(p, grads, m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    q -= rate * (mm / (1 - 0.9 ** t)) / (np.sqrt(vv / (1 - 0.999 ** t)) + 1e-8)
        self.weights = (mean, spread, *p)
        if tune.any():
            margin = np.where(y[tune] == 1, 1, -1) * self.logit(x[tune])
            grid = np.geomspace(0.25, 8, 61)
            self.temperature = float(min(grid, key=lambda s: np.mean(np.logaddexp(0, -margin / s))))
        return self


def _pool(shared):
    def run(batches):
        import pyarrow as pa
        for rows, data, off in text_blocks(batches, "text"):
            x = pooled(data, off, shared.value)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), rows.column("tune"),
                                              pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["doc_id", "label", "tune", "x"])
    return run


def fit(docs: DataFrame, labels: DataFrame, table: np.ndarray, max_rows: int = TRAIN_ROWS) -> Network:
    """The network for ``labels`` (``doc_id, label``), from a bounded sample: at most
    ``max_rows`` labelled ids and one text of each (of several the one with the
    smallest digest, taken before any row leaves its task)."""
    spark = docs.sparkSession
    sample = (labels.where("label is not null").dropDuplicates(["doc_id"])
                    .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
                    .select(F.col("doc_id").alias("label_id"), F.col("label").cast("double").alias("label")))
    # bounded by max_rows
    rows = id_text(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", text_digest()).alias("text"))
    rows = rows.select("doc_id", "label", (id_crc() % 5 == 1).alias("tune"), "text")
    shared = spark.sparkContext.broadcast(table)
    got = rows.mapInArrow(_pool(shared), "doc_id bigint, label double, tune boolean, x binary").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["label"] for r in got])
    if not len(y):
        return Network(0.5)
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    return Network(float(y.mean())).fit(x, y, np.array([r["tune"] for r in got]))


def _score(shared):
    def run(batches):
        import pyarrow as pa
        table, net = shared.value
        for rows, data, off in text_blocks(batches, "text"):
            keys = [k for k in rows.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keys), pa.array(net.score(pooled(data, off, table)), pa.float64())],
                                             names=[*keys, "score"])
    return run


def _scorer(docs: DataFrame, labels: DataFrame):
    """Table and network of ``docs``, broadcast.  Labels are learnt only where
    crc32(id as text) mod 5 is not 0."""
    spark = prepare(docs.sparkSession)
    table = context_vectors(docs)
    learn = labels.where(id_crc() % 5 != 0).select("doc_id", F.col("quality").alias("label"))
    return spark.sparkContext.broadcast((table, fit(docs, learn, table)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.  Labels
    are learnt only where crc32(id as text) mod 5 is not 0."""
    scored = id_text(docs).mapInArrow(_score(_scorer(docs, labels)), "doc_id bigint, score double")
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` whose quality score reaches the threshold, all columns kept.  Each
    row is judged by its own text, known by id and digest."""
    scored = keyed_text(docs).mapInArrow(_score(_scorer(docs, labels)), "doc_id bigint, digest bigint, score double")
    # copies of one row stay or go together, though their last bits may differ by batch
    rejected = (stored(scored, "quality").groupBy("doc_id", "digest").agg(F.max("score").alias("best")).where(F.col("best") < threshold)
                .select(F.col("doc_id").alias("_bad_id"), F.col("digest").alias("_bad_digest")))
    own = F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.col("_digest") == F.col("_bad_digest"))
    return docs.withColumn("_digest", text_digest()).join(rejected.hint("shuffle_hash"), own, "left_anti").drop("_digest")
