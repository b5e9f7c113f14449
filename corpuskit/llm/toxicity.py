"""Toxicity by a classifier chain of linear models.

The chain predicts the categories in order.  Each model is logistic over the
hashed words of a text and their first letters (words of letters, digits and
non-ASCII characters, A-Z lower-cased; presence, weighted by the words' log-odds in its training rows) and over the
probabilities of all earlier categories.  In training those probabilities are
out-of-fold (folds by a hash of the id), so a later model sees them as it
will on new texts.

``labels`` has one label, ``toxic``; the finer categories are a toxic document
that uses a word of the category's list, and the last category is ``toxic``
itself.  The models are fitted on at most ``TRAIN_ROWS`` labelled documents of
either label, the smallest by a hash of their id; a fifth of all ids (crc32 mod
5 is 0) is held out.  Scoring reads every whole text.  Null and empty texts
have no words and get the models' intercepts.  Without labels of both kinds a
category's probability is its share among the labels (0 without any).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, hash_beginnings, hash_words, id_crc, id_text, prepare, text_blocks, text_digest

BUCKETS = 1 << 17
TRAIN_ROWS = 5_000
FOLDS = 3
ITERATIONS = 60
#: Beginnings of words, in bytes, that count as features beside the words.
BEGINNINGS = (4, 5)
#: A word counts if its presence and the label are this far from independent
#: (chi-squared); with 10^5 words, chance reaches it for almost none.
LEAST_CHI2 = 40.0

#: Word lists of the finer categories, in chain order.
CATEGORIES = {
    "insult": ["idiot", "moron", "loser", "clown", "scum"],
    "contempt": ["stupid", "worthless", "pathetic", "disgusting", "trash"],
}


def _own(data: np.ndarray, off: np.ndarray):
    """Bucket of each whole word, and the texts' first words."""
    hashes, first = hash_words(data, off, LETTERS)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), first


def buckets(data: np.ndarray, off: np.ndarray):
    """Distinct buckets of each text's words and word beginnings, concatenated,
    and where each text's begin."""
    own, first = _own(data, off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first)).astype(np.int64) * BUCKETS
    keys = [text + own]
    for n in BEGINNINGS:
        h, _ = hash_beginnings(data, off, n, LETTERS)
        keys.append(text + ((h ^ np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return key % BUCKETS, np.searchsorted(key, np.arange(len(off)) * BUCKETS)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


class Linear:
    """Logistic model over word buckets and extra columns."""

    def __init__(self, share: float):
        p = min(max(share, 1e-6), 1 - 1e-6)
        self.words, self.extra, self.bias = None, None, float(np.log(p / (1 - p)))

    def logit(self, at: np.ndarray, first: np.ndarray, extra: np.ndarray) -> np.ndarray:
        if self.words is None:
            return np.full(len(first) - 1, self.bias)
        return _sums(self.words[at], first) + extra @ self.extra + self.bias

    def probability(self, at, first, extra) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(at, first, extra), -40, 40)))

    def fit(self, at: np.ndarray, first: np.ndarray, extra: np.ndarray, y: np.ndarray) -> "Linear":
        if len(np.unique(y)) < 2:
            return self
        text = np.repeat(np.arange(len(y)), np.diff(first))
        pos = np.bincount(at, y[text], BUCKETS)
        neg = np.bincount(at, 1 - y[text], BUCKETS)
        odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
        n, p1, seen_in = len(y), y.sum(), pos + neg
        spread = np.maximum(seen_in * (n - seen_in) * p1 * (n - p1), 1e-9)
        odds[n * (pos * (n - p1 - neg) - neg * (p1 - pos)) ** 2 / spread < LEAST_CHI2] = 0
        # only words that count take part in the rounds
        told = odds[at] != 0
        text, (seen, local) = text[told], np.unique(at[told], return_inverse=True)
        scale = odds[seen]
        # start at half the log-odds: words that are alike share the evidence
        params = [np.full(len(seen), 0.5), np.zeros(extra.shape[1]), np.array([self.bias])]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        value = scale[local]
        for t in range(1, ITERATIONS + 1):
            z = np.bincount(text, params[0][local] * value, n) + extra @ params[1] + params[2]
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
            grads = [np.bincount(local, d[text] * value, len(seen)) + 1e-4 * (params[0] - 0.5), extra.T @ d + 1e-4 * params[1], d.sum(keepdims=True)]
            for p, g, mm, vv in zip(params, grads, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= 0.05 * (mm / (1 - 0.9 ** t)) / (np.sqrt(vv / (1 - 0.999 ** t)) + 1e-8)
        self.words = np.zeros(BUCKETS)
        self.words[seen] = params[0] * scale
        self.extra, self.bias = params[1], float(params[2][0])
        return self


def _rows(at, first, rows):
    """The sparse rows ``rows`` of (at, first)."""
    parts = [at[first[r]:first[r + 1]] for r in rows]
    return np.concatenate(parts) if parts else at[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def fit_chain(at, first, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """One model per column of ``labels``; later ones see earlier probabilities."""
    n, k = labels.shape
    extra, chain = np.zeros((n, 0)), []
    for c in range(k):
        y = labels[:, c]
        out = np.full(n, y.mean() if n else 0.0)
        for f in np.unique(fold):
            test, train = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(train):
                model = Linear(float(y[train].mean())).fit(*_rows(at, first, train), extra[train], y[train])
                out[test] = model.probability(*_rows(at, first, test), extra[test])
        chain.append(Linear(float(y.mean()) if n else 0.0).fit(at, first, extra, y))
        extra = np.column_stack([extra, out])
    return chain


def chain_probabilities(chain: list[Linear], at, first) -> np.ndarray:
    extra = np.zeros((len(first) - 1, 0))
    for model in chain:
        extra = np.column_stack([extra, model.probability(at, first, extra)])
    return extra


def _features(batches):
    import pyarrow as pa
    for rows, data, off in text_blocks(batches, "text"):
        at, first = buckets(data, off)
        cells = [at[a:b].astype("<i4").tobytes() for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("doc_id", "label", "fold")] + [pa.array(cells, pa.binary())],
                                         names=["doc_id", "label", "fold", "at"])


def _list_buckets(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    off = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
    return np.unique(_own(np.frombuffer(b"".join(raw), np.uint8), off)[0])


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, list[str]], max_rows: int = TRAIN_ROWS) -> list[Linear]:
    """The chain for ``categories`` and then ``toxic``, from ``labels``
    (``doc_id, toxic``): at most ``max_rows`` ids of either label and one text of each
    (of several the one with the smallest digest)."""
    sample = None
    for value in (0, 1):
        part = (labels.where(F.col("toxic") == value).dropDuplicates(["doc_id"])
                      .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").alias("label_id"), F.lit(value).alias("label")))
        sample = part if sample is None else sample.unionByName(part)
    rows = id_text(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))  # bounded by 2 x max_rows
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", text_digest()).alias("text"))
    rows = rows.select("doc_id", "label", (F.floor(id_crc() / 5) % FOLDS).cast("int").alias("fold"), "text")
    got = rows.mapInArrow(_features, "doc_id bigint, label int, fold int, at binary").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["at"]))
    parts = [np.frombuffer(r["at"], "<i4").astype(np.int64) for r in got]
    at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    toxic = np.array([float(r["label"]) for r in got])
    columns = [toxic * np.array([np.isin(_list_buckets(ws), p).any() for p in parts], float) for ws in categories.values()]
    return fit_chain(at, first, np.column_stack([*columns, toxic]) if got else np.zeros((0, len(categories) + 1)),
                     np.array([r["fold"] for r in got], int))


def _score(shared, n: int):
    def run(batches):
        import pyarrow as pa
        for rows, data, off in text_blocks(batches, "text"):
            p = chain_probabilities(shared.value, *buckets(data, off))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id")] + [pa.array(p[:, k], pa.float64()) for k in range(n)],
                                             names=["doc_id"] + [f"p{k}" for k in range(n)])
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, categories: dict[str, list[str]] | None = None,
                    threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out``, a probability per category, ``toxic_score`` and
    ``predicted`` of every row of ``docs``."""
    spark = prepare(docs.sparkSession)
    categories = CATEGORIES if categories is None else categories
    chain = train(docs, labels.where(id_crc() % 5 != 0), categories)
    shared, n = spark.sparkContext.broadcast(chain), len(chain)
    scored = id_text(docs).mapInArrow(_score(shared, n), "doc_id bigint, " + ", ".join(f"p{k} double" for k in range(n)))
    names = [F.col(f"p{k}").alias(f"{c}_score") for k, c in enumerate([*categories, "toxic"])]
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), *names,
                         (F.col(f"p{n - 1}") >= threshold).cast("int").alias("predicted"))
