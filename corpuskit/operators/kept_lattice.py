"""The lattices of a training run, built once and kept from round to round (V3, V5).

Pieces are numbered once.  ``lattice`` stores one row per distinct word with its
edges as parallel arrays of start, end and piece number; the scores of a round
are a dense array by number that goes to the tasks as a Spark broadcast.  It
has one double per piece of the first model, at most ``seed_size`` and the
distinct characters, however many words there are (``MAX_PIECES`` is checked).

A pass then needs no substrings, no join and no grouping by word: every task
sweeps its words and adds up per piece before anything is shuffled.  A piece
that a round has dropped has no score (NaN): its edges are passed over, and
those of one character become unknown edges.  ``thin`` rewrites the stored
lattice without them.

Words are swept in blocks of similar length, so that a very long word makes a
table of its own and not a row of a wide one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lattice_kernels import Edges, best_edges, posteriors, two_best_edges
from ..functions.ranking import global_rank
from ..session import forget, stored
from .lattice import MAX_PIECE_LENGTH, UNK_PENALTY, by_word

#: Pieces of a model: a dense array of so many doubles is 128 MB.
MAX_PIECES = 1 << 24
#: Cells (words times longest word) that a sweep holds at a time.
BLOCK_CELLS = 1 << 22

LATTICE = "f bigint, n int, own int, s array<int>, e array<int>, k array<int>"


def number_pieces(pieces: DataFrame) -> DataFrame:
    """``(piece, lp, k)``, ``k`` from 0 in the order of the pieces, stored."""
    ranked = global_rank(pieces.select("piece", "lp"), ["piece"], "_r")
    out = stored(ranked.select("piece", "lp", (F.col("_r") - 1).cast("int").alias("k")))
    forget(ranked)
    if out.count() > MAX_PIECES:
        raise ValueError(f"a model has at most {MAX_PIECES} pieces; take a smaller seed_size")
    return out


class Finder:
    """The pieces of a model by number, for finding them in words: per length their
    code points by a hash that no two of them share, so a hit needs one comparison.
    Bounded by ``MAX_PIECES``, however many words there are."""

    def __init__(self, numbers: np.ndarray, pieces: list[str]):
        self.base, self.tables = 1_000_003, {}
        once = dict(zip(pieces, numbers.tolist()))
        pieces, numbers = list(once), np.array(list(once.values()), np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        for n in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == n)
            points = _points([pieces[i] for i in rows]).reshape(len(rows), n)
            self.tables[int(n)] = (numbers[rows], points)
        while not self._hash():
            self.base += 2

    def _hash(self) -> bool:
        for n, (k, points) in self.tables.items():
            h = np.zeros(len(k), np.uint64)
            for i in range(n):
                h = self._next(h, points[:, i])
            order = np.argsort(h, kind="stable")
            if (np.diff(h[order]) == 0).any():
                return False
            self.tables[n] = (k[order], points[order], h[order])
        return True

    def _next(self, h: np.ndarray, point: np.ndarray) -> np.ndarray:
        return h * np.uint64(self.base) + point.astype(np.uint64) + np.uint64(1)

    def edges(self, words: list[str], max_len: int):
        """Edges per word, then end, start and number of all edges, by word, end and start."""
        n = np.array([len(w) for w in words], np.int64)
        points, word = _points(words), np.repeat(np.arange(len(n)), n)
        start = np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)
        at, h, out = np.arange(len(points)), np.zeros(len(points), np.uint64), []
        for length in range(1, max_len + 1):
            inside = start[at] + length <= n[word[at]]
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = self._next(h, points[at + length - 1])
            k = self._numbers(length, h, at, points)
            hit = np.arange(len(at)) if length == 1 else np.flatnonzero(k >= 0)
            out.append((word[at[hit]], start[at[hit]] + length, start[at[hit]], k[hit]))
        w, e, s, k = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((s, e, w))
        return np.bincount(w, minlength=len(n)), e[order], s[order], k[order]

    def _numbers(self, length: int, h: np.ndarray, at: np.ndarray, points: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if length in self.tables:
            k, known, hashes = self.tables[length]
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[place] == h)
            hit = hit[(known[place[hit]] == points[at[hit][:, None] + np.arange(length)]).all(axis=1)]
            out[hit] = k[place[hit]]
        return out


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)


def finder(numbered: DataFrame, max_len: int = MAX_PIECE_LENGTH) -> Finder:
    table = numbered.where(F.length("piece") <= max_len).select("k", "piece").toArrow()
    return Finder(table.column("k").to_numpy().astype(np.int64), table.column("piece").to_pylist())


def send_finder(numbered: DataFrame, max_len: int = MAX_PIECE_LENGTH):
    """The pieces as a Spark broadcast, for more than one ``lattice``."""
    return numbered.sparkSession.sparkContext.broadcast(finder(numbered, max_len))


def _holding(df: DataFrame, shared) -> DataFrame:
    df._shared = shared
    return df


def release(df: DataFrame) -> None:
    """Delete what a pass had sent to the tasks, in the memory and on the disks; ``df`` has been computed."""
    df._shared.destroy()


def _edge_batch(find: Finder, texts: list[str], max_len: int) -> pa.RecordBatch:
    size, e, s, k = find.edges(texts, max_len)
    cut = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    lists = [pa.ListArray.from_arrays(cut, pa.array(v, pa.int32())) for v in (s, e, k)]
    return pa.RecordBatch.from_arrays([pa.array([len(w) for w in texts], pa.int32()), *lists], names=["n", "s", "e", "k"])


def lattice(words: DataFrame, numbered: DataFrame, max_len: int = MAX_PIECE_LENGTH, shared=None) -> DataFrame:
    """One row per row of ``words`` (``w, f, own``): its edges by end and start.  A
    character that is no piece is an edge without a number (-1).  A task finds its
    words' edges itself: no row per substring is made, joined or grouped.
    ``shared``: the pieces as ``send_finder`` sent them."""
    shared = shared or send_finder(numbered, max_len)

    def run(batches):
        for batch in batches:
            edges = _edge_batch(shared.value, batch.column("w").to_pylist(), max_len)
            yield pa.RecordBatch.from_arrays([batch.column("f"), edges.column("n"), batch.column("own"),
                                              *[edges.column(c) for c in "sek"]], names=["f", "n", "own", "s", "e", "k"])
    some = words.where("w != ''").select("w", F.col("f").cast("bigint").alias("f"), F.col("own").cast("int").alias("own"))
    return by_word(some).mapInArrow(run, LATTICE)


BEST = "w string, ids array<int>, tokens array<string>, score double"


def best_pieces(words: DataFrame, pieces: DataFrame, unk_id: int, unk: str = "<unk>",
                max_len: int = MAX_PIECE_LENGTH) -> DataFrame:
    """E1 + E3: ``(w, ids, tokens, score)`` of each word's best segmentation by ``pieces``
    (``piece, lp, id``); adjacent unknown characters are one ``unk``, the score counts each."""
    if pieces.count() > MAX_PIECES:
        raise ValueError(f"a model has at most {MAX_PIECES} pieces")
    table = pieces.select("piece", F.col("lp").cast("double").alias("lp"), F.col("id").cast("int").alias("id")).toArrow().combine_chunks()
    texts = table.column("piece").to_pylist()
    lp = np.array([np.nan if v is None else v for v in table.column("lp").to_pylist()], np.float64)
    # the unknown entry comes last, where the number -1 points
    ids = np.array([*table.column("id").to_pylist(), unk_id], np.int32)
    shared = words.sparkSession.sparkContext.broadcast(
        (Finder(np.arange(len(texts)), texts), _Scores(lp), ids, pa.array([*texts, unk], pa.string())))

    def run(batches):
        find, scores, ids, tokens = shared.value
        for batch in batches:
            for rows, x, k in _blocks(_edge_batch(find, batch.column("w").to_pylist(), max_len), scores):
                at, size = best_edges(x)
                first = np.cumsum(size) - size
                score, piece, inner = np.add.reduceat(x.lp[at], first), k[at], np.ones(len(at), bool)
                inner[first] = False
                stay = np.ones(len(at), bool)
                stay[1:] = ~((piece[1:] < 0) & (piece[:-1] < 0) & inner[1:])
                cut = pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(stay.astype(np.int64), first))]), pa.int32())
                piece = np.where(piece < 0, len(ids) - 1, piece)[stay]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("w").take(pa.array(rows)), pa.ListArray.from_arrays(cut, pa.array(ids[piece])),
                     pa.ListArray.from_arrays(cut, tokens.take(pa.array(piece))), pa.array(score, pa.float64())],
                    names=["w", "ids", "tokens", "score"])
    return by_word(words.select("w").where("w != ''")).mapInArrow(run, BEST)


def word_lattice(words: DataFrame, numbered: DataFrame, shared=None) -> DataFrame:
    return lattice(words.withColumn("own", F.lit(-1)), numbered, shared=shared)


def piece_lattice(numbered: DataFrame, shared=None) -> DataFrame:
    """The lattices of the pieces themselves, ``own`` their number."""
    longer = numbered.where(F.length("piece") > 1)
    return lattice(longer.select(F.col("piece").alias("w"), F.lit(1).alias("f"), F.col("k").alias("own")), numbered, shared=shared)


def dense(model: DataFrame, size: int, value: str = "lp") -> np.ndarray:
    """The values of ``model`` (``k`` and ``value``) as an array by number; NaN where
    it has none.  Bounded by ``MAX_PIECES``."""
    out = np.full(size, np.nan)
    table = model.select("k", F.col(value).cast("double").alias("v")).toArrow()
    out[table.column("k").to_numpy()] = table.column("v").to_numpy()
    return out


def passed(model: DataFrame, size: int, value: str) -> np.ndarray:
    """``dense`` of what a pass gives, and ``release``."""
    out = dense(model, size, value)
    release(model)
    return out


class _Scores:
    """What a pass sends to the tasks."""

    def __init__(self, lp: np.ndarray):
        self.lp = lp
        low = np.nanmin(lp) if np.isfinite(lp).any() else 0.0
        self.unk = low - UNK_PENALTY


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _live(batch: pa.RecordBatch, lp: np.ndarray):
    """Word, start, end, number (-1: unknown) of the edges that still count."""
    size = pc.list_value_length(batch.column("k")).to_numpy(zero_copy_only=False)
    word = np.repeat(np.arange(len(size)), size)
    s, e, k = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in "sek")
    gone = np.ones(len(k), bool)
    gone[k >= 0] = np.isnan(lp[k[k >= 0]])
    stay = ~gone | (e - s == 1)
    return word[stay], s[stay], e[stay], np.where(gone, -1, k)[stay]


def _blocks(batch: pa.RecordBatch, scores: _Scores):
    """``(rows, lattice, numbers)`` for blocks of words of similar length."""
    n = _column(batch, "n").astype(np.int64)
    word, s, e, k = _live(batch, scores.lp)
    score = np.full(len(k), scores.unk)
    score[k >= 0] = scores.lp[k[k >= 0]]
    size = np.bincount(word, minlength=len(n))
    first = np.cumsum(size) - size
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        # lengths ascend: the block's last word is its widest
        cells = (np.arange(len(order) - at) + 1) * (n[order[at:]] + 1)
        rows = order[at:at + max(1, int(np.searchsorted(cells, BLOCK_CELLS, "right")))]
        at += len(rows)
        own = size[rows]
        pick = np.repeat(first[rows] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        yield rows, Edges.flat(own, s[pick], e[pick], score[pick], n[rows]), k[pick]


def _sums(total: np.ndarray):
    """Non-zero entries of a task's sums, in batches."""
    hit = np.flatnonzero(total)
    for at in range(0, len(hit), 50_000):
        part = hit[at:at + 50_000]
        yield pa.RecordBatch.from_pydict({"k": pa.array(part, pa.int32()), "c": pa.array(total[part], pa.float64())})


def _add_up(lat: DataFrame, lp: np.ndarray, weights) -> DataFrame:
    """``(k, c)``: sums per piece of ``weights(lattice, f)`` over all edges."""
    shared = lat.sparkSession.sparkContext.broadcast(_Scores(lp))

    def run(batches):
        total = np.zeros(len(shared.value.lp))
        for batch in batches:
            f = _column(batch, "f").astype(np.float64)
            for rows, x, k in _blocks(batch, shared.value):
                c = weights(x, f[rows])
                known = (k >= 0) & (c != 0)
                np.add.at(total, k[known], c[known])
        yield from _sums(total)
    return _holding(lat.mapInArrow(run, "k int, c double").groupBy("k").agg(F.sum("c").alias("c")), shared)


def _on_best_path(x: Edges, f: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x.lp))
    at, size = best_edges(x)
    c[at] = np.repeat(f, size)
    return c


def expected_counts(lat: DataFrame, lp: np.ndarray) -> DataFrame:
    """V3: expected count of every piece over all segmentations of all words."""
    return _add_up(lat, lp, posteriors)


def viterbi_counts(lat: DataFrame, lp: np.ndarray) -> DataFrame:
    """Occurrences of every piece in the best segmentations of all words."""
    return _add_up(lat, lp, _on_best_path)


def losses(pieces_lat: DataFrame, lp: np.ndarray, vf: np.ndarray, n_words: float) -> DataFrame:
    """V5: ``(k, loss)`` of every piece that best segmentations use (``vf``) and that is its
    own best segmentation: what the likelihood loses if its best other
    segmentation takes its place."""
    shared = pieces_lat.sparkSession.sparkContext.broadcast((_Scores(lp), vf, np.log(np.nansum(vf)) if np.nansum(vf) else 0.0))

    def run(batches):
        scores, vf, log_total = shared.value
        total = np.nansum(vf)
        for batch in batches:
            mine = _column(batch, "own")
            used = np.isfinite(scores.lp[mine]) & (vf[mine] > 0)
            batch = batch.filter(pa.array(used))
            mine, out = mine[used], []
            for rows, x, k in _blocks(batch, scores):
                (_, parts), (second, size) = two_best_edges(x)
                own = (parts == 1) & (size > 0)
                other, size = k[second[np.repeat(own, size)]], size[own]
                if not len(size):
                    continue
                piece = mine[rows[own]]
                f = vf[piece]
                taken = np.where(other >= 0, np.nan_to_num(vf[other]), 0.0) + np.repeat(f, size)
                after = np.add.reduceat(np.log(taken), np.cumsum(size) - size) - size * np.log(total + f * (size - 1))
                out.append((piece, f / n_words * (np.log(f) - log_total - after)))
            piece, loss = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int32), np.zeros(0))
            yield pa.RecordBatch.from_pydict({"k": pa.array(piece, pa.int32()), "loss": pa.array(loss, pa.float64())})
    return _holding(pieces_lat.mapInArrow(run, "k int, loss double"), shared)


def thin(lat: DataFrame, lp: np.ndarray) -> DataFrame:
    """``lat`` without the edges of dropped pieces, nor the lattices of such pieces."""
    shared = lat.sparkSession.sparkContext.broadcast(lp)

    def run(batches):
        lp = shared.value
        for batch in batches:
            own = _column(batch, "own")
            batch = batch.filter(pa.array((own < 0) | np.isfinite(lp[own]) if len(lp) else own < 0))
            word, *edges = _live(batch, lp)
            cut = pa.array(np.searchsorted(word, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(v, pa.int32())) for v in edges]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("f", "n", "own")] + lists, names=["f", "n", "own", "s", "e", "k"])
    return _holding(lat.mapInArrow(run, LATTICE), shared)
