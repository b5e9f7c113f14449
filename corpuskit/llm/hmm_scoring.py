"""Language-model scoring with a hidden Markov model over word classes.

Tokens are the words between blanks (A-Z lower-cased) and one end per text.  A
word's class comes from its spelling (a hash of its first and last bytes), so
no table of words is needed to know it.  The model is
P(text) = P(classes) * prod P(word | class): an HMM makes the classes, and
P(word | class) = (count + 1) / (sum over the class's known words of
(count + 1) + 1), whose last 1 is the class's share for words never seen.

Counts of all words of all training texts are exact.  Texts are reduced once
to stored blocks of word numbers, each with the block's distinct words; the
distinct words travel packed, by hash, to where they are added up over all
blocks, and their totals travel back to the blocks that asked.  Baum-Welch
passes run over the stored blocks: each task adds up its expected counts
(texts cut into runs of ``RUN`` tokens), the tasks' sums are added in lanes,
and only the sums (fixed size) reach the driver.  Scoring is the exact scaled
forward recursion over whole texts, as products of the runs' transfer matrices.

Null and empty texts consist of the end alone.  Repeated rows are scored as
often as they occur.  Without training texts the class model is uniform.  An
empty table gives no rows.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_beginnings, hash_endings, hash_words, id_crc, id_text, prepare, stored, text_blocks

STATES = 8
CLASS_BITS = 12
CLASSES = 1 << CLASS_BITS
END = np.uint64(0)  # class 0 holds the end alone
ITERATIONS = 4
RUN = 64
BLOCK_TOKENS = 1 << 20
LANES = 64
MAX_PARTS = 1 << 16

BLOCKS = "block bigint, n_docs bigint, known binary, doc_id binary, train binary, length binary, words binary, counts binary, tokens binary"


def _word_numbers(data: np.ndarray, off: np.ndarray):
    """64-bit word numbers with the class in the top bits; an end after each text."""
    own, first = hash_words(data, off)
    head, _ = hash_beginnings(data, off, 3)
    tail, _ = hash_endings(data, off, 3)
    half = np.uint64(1 << (CLASS_BITS // 2))
    cls = np.maximum((head % half) * half + tail % half, np.uint64(1))
    words = (cls << np.uint64(64 - CLASS_BITS)) | (own >> np.uint64(CLASS_BITS))
    return np.insert(words, first[1:], END), np.diff(first) + 1


def _class(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def _make_blocks(batches):
    import pyarrow as pa
    pending, n = [], 0
    serial = TaskContext.get().partitionId() << 32

    def block():
        known, ids, train, length, tokens = (np.concatenate(x) for x in zip(*pending))
        words, index = np.unique(tokens, return_inverse=True)
        counts = np.bincount(index[np.repeat(train, length)], minlength=len(words))
        cells = [known.astype("u1"), ids.astype("<i8"), train.astype("u1"), length.astype("<i8"),
                 words.astype("<u8"), counts.astype("<i8"), index.astype("<u4")]
        names = ["known", "doc_id", "train", "length", "words", "counts", "tokens"]
        return pa.RecordBatch.from_pydict({"block": pa.array([serial], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64())}
                                          | {k: pa.array([c.tobytes()], pa.binary()) for k, c in zip(names, cells)})
    for rows, data, off in text_blocks(batches, "text"):
        tokens, length = _word_numbers(data, off)
        ids = rows.column("doc_id")
        pending.append((np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)), np.asarray(rows.column("train")), length, tokens))
        n += len(tokens)
        if n >= BLOCK_TOKENS:
            yield block()
            serial, pending, n = serial + 1, [], 0
    if pending:
        yield block()


def _array(cell, dtype):
    return np.frombuffer(cell, dtype)


def _ask(parts: int):
    """Per block and part: its distinct words and their counts there."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for block, words, counts in zip(*(b.column(c).to_pylist() for c in ("block", "words", "counts"))):
                words, counts = _array(words, "<u8"), _array(counts, "<i8")
                part = words % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                used = np.flatnonzero(np.diff(cut))
                slices = [order[cut[p]:cut[p + 1]] for p in used]
                yield pa.RecordBatch.from_pydict({"part": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int64()),
                                                  "words": pa.array([words[s].tobytes() for s in slices], pa.binary()),
                                                  "counts": pa.array([counts[s].tobytes() for s in slices], pa.binary())})
    return run


TOTALS = "part int, block bigint, totals binary, n_tokens bigint, n_words bigint, mass binary"


def _add_up(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Totals of a part's words over all blocks, sent back per block; the row
    without a block has the part's sums."""
    pdf = pd.concat(list(pdfs))
    cells = [_array(w, "<u8") for w in pdf["words"]]
    words, index = np.unique(np.concatenate(cells), return_inverse=True)
    total = np.bincount(index, np.concatenate([_array(c, "<i8") for c in pdf["counts"]])).astype("<i8")
    seen = total > 0
    mass = np.bincount(_class(words[seen]), total[seen] + 1.0, CLASSES)
    out, at = [], 0
    for block, cell in zip(pdf["block"], cells):
        out.append((key[0], block, total[index[at:at + len(cell)]].tobytes(), 0, 0, b""))
        at += len(cell)
    out.append((key[0], -1, b"", int(total.sum()), int(seen.sum()), mass.astype("<f8").tobytes()))
    yield pd.DataFrame(out, columns=["part", "block", "totals", "n_tokens", "n_words", "mass"])


def _runs(length: np.ndarray):
    """The runs of texts of these lengths, longest first: first token, length,
    text, number within the text."""
    per = -(-length // RUN)
    text = np.repeat(np.arange(len(length)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(np.cumsum(length) - length, per) + number * RUN
    size = np.minimum(np.repeat(length, per) - number * RUN, RUN)
    order = np.argsort(-size, kind="stable")
    return begin[order], size[order], text[order], number[order]


class Model:
    """Start, transition and emission probabilities of the hidden states."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, share: np.ndarray) -> "Model":
        emit = share * (1 + 0.5 * np.random.default_rng(5).random((STATES, CLASSES)))
        move = np.full((STATES, STATES), 0.1 / STATES) + np.eye(STATES) * 0.9
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))

    def expected(self, cls: np.ndarray, length: np.ndarray):
        """Expected counts of starts, moves and emissions (scaled forward-backward)."""
        begin, size, _, _ = _runs(length)
        steps = int(size[0]) if len(size) else 0
        active = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps + 1)]  # runs longer than t
        table = np.ascontiguousarray(self.emit.T)
        alpha, seen, scale = [], [], []
        for t in range(steps):
            n = active[t]
            o = cls[begin[:n] + t]
            e = table[o]
            a = (self.start if t == 0 else alpha[-1][:n] @ self.move) * e
            s = a.sum(1)
            alpha.append(a / s[:, None])
            seen.append(o)
            scale.append(s)
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
        beta = np.ones((0, STATES))
        for t in range(steps - 1, -1, -1):
            full = np.ones((active[t], STATES))
            if t + 1 < steps:
                n = active[t + 1]
                right = beta * table[seen[t + 1]] / scale[t + 1][:, None]
                full[:n] = right @ self.move.T
                move += alpha[t][:n].T @ right
            beta = full
            gamma = alpha[t] * beta
            for k in range(STATES):
                emit[k] += np.bincount(seen[t], gamma[:, k], CLASSES)
            if t == 0:
                start = gamma.sum(0)
        return start, move * self.move, emit

    def updated(self, start, move, emit, share: np.ndarray) -> "Model":
        """Maximised, with a little prior so that no class is impossible."""
        if not start.sum():
            return self
        start, move, emit = start + 0.1, move + 0.1, emit + 10.0 * share + 1e-6
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def log10(self, cls: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of each text's classes."""
        begin, size, text, number = _runs(length)
        table = np.ascontiguousarray(self.emit.T)
        product = np.broadcast_to(np.eye(STATES), (len(size), STATES, STATES)).copy()
        logs = np.zeros(len(size))
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))
            p = product[:n]
            moved = (p.reshape(-1, STATES) @ self.move).reshape(n, STATES, STATES)
            if t == 0:  # a text's first token follows the start, not a move
                first = number[:n] == 0
                moved[first] = p[first]
            moved *= table[cls[begin[:n] + t]][:, None, :]
            if t % 4 == 3 or t < 1:
                s = moved.sum((1, 2))
                moved /= s[:, None, None]
                logs[:n] += np.log10(s)
            product[:n] = moved
        out = np.zeros(len(length))
        state = np.tile(self.start, (len(length), 1))
        order = np.lexsort((text, number))
        cut = np.searchsorted(number[order], np.arange(int(number.max()) + 2 if len(number) else 1))
        for k in range(len(cut) - 1):
            i = order[cut[k]:cut[k + 1]]
            v = np.einsum("nk,nkl->nl", state[text[i]], product[i])
            s = v.sum(1)
            state[text[i]] = v / s[:, None]
            out[text[i]] += np.log10(s) + logs[i]
        return out


def _expect(shared):
    def run(batches):
        import pyarrow as pa
        model, total = shared.value, None
        for b in batches:
            for train, length, words, tokens in zip(*(b.column(c).to_pylist() for c in ("train", "length", "words", "tokens"))):
                train, length = _array(train, "u1").astype(bool), _array(length, "<i8")
                cls = _class(_array(words, "<u8"))[_array(tokens, "<u4")][np.repeat(train, length)]
                got = np.concatenate([x.ravel() for x in model.expected(cls, length[train])])
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_pydict({"lane": pa.array([TaskContext.get().partitionId() % LANES], pa.int32()),
                                              "sums": pa.array([total.astype("<f8").tobytes()], pa.binary())})
    return run


def _add_lane(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = 0.0
    for pdf in pdfs:
        for cell in pdf["sums"]:
            total = total + _array(cell, "<f8")
    yield pd.DataFrame({"lane": [key[0]], "sums": [total.tobytes()]})


def train(blocks: DataFrame, share: np.ndarray, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over the stored blocks; ``share``: the classes' shares of the counts."""
    model, context = Model.initial(share), blocks.sparkSession.sparkContext
    for _ in range(iterations):
        shared = context.broadcast(model)
        sums = (blocks.select("train", "length", "words", "tokens").mapInArrow(_expect(shared), "lane int, sums binary")
                      .groupBy("lane").applyInPandas(_add_lane, "lane int, sums binary").collect())
        total = sum((_array(r["sums"], "<f8") for r in sorted(sums, key=lambda r: r["lane"])),
                    np.zeros(STATES + STATES * STATES + STATES * CLASSES))
        start, move, emit = np.split(total, [STATES, STATES + STATES * STATES])
        model = model.updated(start, move.reshape(STATES, STATES), emit.reshape(STATES, CLASSES), share)
        shared.unpersist()
    return model


SCORES = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
          "base_score double, score double")


def _score(shared, parts: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        model, mass, n_tokens, n_words = shared.value
        out = []
        for row in left.itertuples():
            words = _array(row.words, "<u8")
            order = np.argsort(words % np.uint64(parts), kind="stable")
            count = np.zeros(len(words))
            count[order] = np.concatenate([_array(c, "<i8") for c in right.sort_values("part")["totals"]])
            cls, length, tokens = _class(words), _array(row.length, "<i8"), _array(row.tokens, "<u4")
            first = np.cumsum(length) - length
            add = lambda x: np.add.reduceat(x[tokens], first)
            base = add(np.log10((count + 1) / (n_tokens + n_words + 1)))
            within = add(np.log10((count + 1) / (mass[cls] + 1)))
            known = _array(row.known, "u1").astype(bool)
            out.append(pd.DataFrame({
                "doc_id": pd.array(_array(row.doc_id, "<i8"), dtype="Int64").copy(), "held_out": ~_array(row.train, "u1").astype(bool),
                "n_tokens": length, "n_known": add((count > 0).astype(np.int64)), "train_tokens": n_tokens,
                "base_score": base, "score": within + model.log10(cls[tokens], length)}))
            out[-1].loc[~known, "doc_id"] = pd.NA
        return pd.concat(out)
    return run


def score_documents(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """Base and model log10 probability of every text of ``docs``; texts whose
    crc32(id as text) mod 7 is 2 are held out of training."""
    spark = prepare(docs.sparkSession)
    rows = id_text(docs).withColumn("train", id_crc() % 7 != 2)
    blocks = stored(rows.mapInArrow(_make_blocks, BLOCKS), "word-blocks")
    n_blocks = blocks.count()
    if not n_blocks:
        return spark.createDataFrame([], SCORES)
    parts = min(max(n_blocks, 16), MAX_PARTS)
    asked = blocks.select("block", "words", "counts").mapInArrow(_ask(parts), "part int, block bigint, words binary, counts binary")
    totals = stored(asked.groupBy("part").applyInPandas(_add_up, TOTALS), "word-totals")
    sums = totals.where("block = -1")
    n_tokens, n_words = sums.select(F.sum("n_tokens"), F.sum("n_words")).first()
    lanes = (sums.select((F.col("part") % LANES).alias("lane"), F.col("mass").alias("sums"))
                 .groupBy("lane").applyInPandas(_add_lane, "lane int, sums binary").collect())
    mass = sum((_array(r["sums"], "<f8") for r in sorted(lanes, key=lambda r: r["lane"])), np.zeros(CLASSES))
    share = (mass + 1) / (mass + 1).sum()
    model = train(blocks, share, iterations)
    shared = spark.sparkContext.broadcast((model, mass, n_tokens, n_words))
    answers = totals.where("block >= 0").select("block", "part", "totals")
    return (blocks.drop("n_docs", "counts").groupBy("block").cogroup(answers.groupBy("block"))
                  .applyInPandas(_score(shared, parts), SCORES))
