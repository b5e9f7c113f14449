"""Unigram subword vocabulary: seeds, EM, pruning, final ids, Viterbi.

The reference calls a library trainer; here every step is a Spark job over
the *distinct-word* table ``(w, f)`` (Kudo 2018, "Subword Regularization"):

* V2 seeds: the substrings (at most 16 characters) of every word, counted
  with the word's frequency by ``groupBy(piece)``, length after length where
  their parts were seen twice; characters always kept, longer substrings if
  seen twice; score ``freq * length``; top ``seed_size``.
* V3 E-step: forward-backward on each word's lattice, which is built once
  (``kept_lattice``) -> expected counts, summed per task, then by ``groupBy``.
* V4 M-step: drop expected counts below 0.5, ``lp = digamma(c) - digamma(sum c)``.
* V5 prune: Viterbi frequencies, the best alternative segmentation of each
  piece, and the loss of removing it; keep the top ``max(1.1 x target,
  0.75 x current)``.
* V6 vocabulary: specials 0-4, then pieces by ``(lp desc, piece)``.

The driver only loops over rounds; each round is one plan, cut by a
checkpoint in the shared checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.joins import lookup_join
from ..functions.numeric import digamma, digamma_array
from ..functions.ranking import global_rank, top_k
from ..session import cut_lineage, forget, stored
from . import kept_lattice as K
from .lattice import MAX_PIECE_LENGTH, UNK_PENALTY, by_word, collect_edges, lattice_edges, with_viterbi

# --- fixed values: defaults of the Unigram trainer ----------------------------
SEED_SIZE = 1_000_000
SHRINKING_FACTOR = 0.75
N_SUB_ITERATIONS = 2
EXPECTED_FREQUENCY_THRESHOLD = 0.5
DESIRED_SIZE_FACTOR = 1.1

#: Lengths at which the counting of seeds stops to drop what is rare.
SEED_STEPS = (8,)


def _stretches(subs: DataFrame, frequent: DataFrame, length: int) -> DataFrame:
    """``(w, f, a, b)``: the longest stretches ``w[a:b]`` all of whose substrings of that
    length are ``frequent``, if longer than one of them."""
    found = lookup_join(subs.select("w", "f", "s", "piece"), frequent.select("piece"), "piece", "inner", salt_cols=["w", "s"])
    place = F.row_number().over(Window.partitionBy("w").orderBy("s"))
    return (found.select("w", "f", "s", (F.col("s") - place).alias("run"))
                 .groupBy("w", "f", "run").agg(F.min("s").alias("a"), (F.max("s") + length).alias("b"))
                 .where(F.col("b") - F.col("a") > length).select("w", "f", "a", "b"))


def counted_substrings(words: DataFrame, max_len: int = MAX_PIECE_LENGTH, steps=SEED_STEPS) -> DataFrame:
    """``(piece, freq)`` of all characters and of the substrings seen twice.

    Lengths grow by ``steps``.  A substring is seen at most as often as any part
    of it, so those longer than a step's ``n`` are looked for only in stretches of
    the words where every substring of length ``n`` was seen twice: exact, and
    what is rare is dropped before its longer forms reach a shuffle."""
    ends = [*sorted(n for n in steps if n < max_len), max_len]
    levels, low = [], 1
    stretches = words.select("w", "f", F.lit(0).alias("a"), F.length("w").alias("b"))
    for high in ends:
        subs = (by_word(stretches).where(f"b - a >= {low}")
                .select("*", F.explode(F.expr(f"sequence(a, b - {low})")).alias("s"))
                .select("w", "f", "s", F.explode(F.expr(f"sequence(s + {low}, least(b, s + {high}))")).alias("e"))
                .withColumn("piece", F.expr("substring(w, s + 1, e - s)")))
        levels.append(stored(subs.groupBy("piece").agg(F.sum("f").alias("freq"))
                                 .where((F.length("piece") == 1) | (F.col("freq") >= 2))))
        if high < max_len:
            longest = levels[-1].where(F.length("piece") == high)
            stretches = stored(_stretches(subs.where(f"e - s = {high}"), longest, high))
            low = high + 1
    return reduce(DataFrame.unionByName, levels)


def seed_pieces(words: DataFrame, seed_size: int = SEED_SIZE, max_len: int = MAX_PIECE_LENGTH) -> DataFrame:
    """V2: ``(piece, freq, score, lp)``; ``lp`` = ln(score / sum of scores)."""
    counted = (counted_substrings(words.select("w", "f").where("w != ''"), max_len)
               .withColumn("score", F.col("freq") * F.length("piece")))
    chars = counted.where(F.length("piece") == 1)
    longer = counted.where(F.length("piece") > 1)
    n_chars = chars.count()
    room = max(seed_size - n_chars, 0)
    top = top_k(longer, "score", ["piece"], room)
    seeds = chars.unionByName(top)
    total = seeds.select(F.sum("score")).scalar()
    return seeds.withColumn("lp", F.log(F.col("score")) - F.log(total))


def base_pieces(words: DataFrame, base: DataFrame) -> DataFrame:
    """V7: ``(piece, lp)`` of a base vocabulary and of every character of the words."""
    given = base.where(~F.col("special") & (F.col("token") != "")).groupBy(F.col("token").alias("piece")).agg(F.max("lp").alias("lp"))
    low = given.select(F.min("lp") - F.lit(UNK_PENALTY)).scalar()
    letters = words.select(F.explode(F.array_distinct(F.split("w", ""))).alias("piece")).where(F.col("piece") != "").distinct()
    missing = letters.join(given, "piece", "left_anti").withColumn("lp", F.coalesce(low, F.lit(-UNK_PENALTY)))
    return given.unionByName(missing)


def unk_score(pieces: DataFrame) -> Column:
    """Score of an unknown character: the lowest piece score minus 10."""
    return pieces.select(F.min("lp") - F.lit(UNK_PENALTY)).scalar()


def word_lattices(words: DataFrame, pieces: DataFrame, keys=("w", "f")) -> DataFrame:
    """One row per word with its sorted lattice ``edges`` and length ``n``."""
    keys = list(keys)
    e = lattice_edges(words.select(*keys), pieces, unk_score(pieces))
    return collect_edges(e, keys).withColumn("n", F.length("w"))


def e_step(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """V3: expected count ``c`` per piece over all segmentations of all words."""
    numbered = K.number_pieces(pieces)
    lp = K.dense(numbered, numbered.count())
    counts = K.expected_counts(K.word_lattice(words, numbered), lp)
    return counts.join(numbered.select("k", "piece"), "k").select("piece", "c")


def m_step(counts: DataFrame | np.ndarray, threshold: float = EXPECTED_FREQUENCY_THRESHOLD) -> DataFrame | np.ndarray:
    """V4: ``(piece, c, lp)`` with ``lp = digamma(c) - digamma(sum c)``.  The counts, a pass
    over all words, feed the sum and the rows: computed once.  Dense counts by number, as a
    training holds them, give the dense ``lp``."""
    if isinstance(counts, np.ndarray):
        c = np.where(counts >= threshold, counts, np.nan)
        return digamma_array(c) - digamma_array(np.nansum(c)) if np.isfinite(c).any() else c
    kept = cut_lineage(counts).where(F.col("c") >= threshold)
    norm = kept.agg(F.sum("c").alias("t")).select(digamma(F.col("t"))).scalar()
    return kept.withColumn("lp", digamma(F.col("c")) - norm)


def viterbi_words(words: DataFrame, pieces: DataFrame, keys=("w", "f")) -> DataFrame:
    """Best segmentation of each word: ``best.score``, ``best.path``."""
    return with_viterbi(word_lattices(words, pieces, keys))


def _single(numbered: DataFrame, size: int) -> np.ndarray:
    """Which numbers are those of single characters."""
    return np.isfinite(K.dense(numbered.where(F.length("piece") == 1).withColumn("one", F.lit(1)), size, "one"))


def _keep(single: np.ndarray, lp: np.ndarray, vf: np.ndarray, pieces_lat: DataFrame, n_words: float, desired_size: int,
          shrinking_factor: float) -> np.ndarray:
    """Which pieces a pruning keeps, by number.  Every loss is known by number, as the scores are."""
    pruned_size = max(desired_size, int(shrinking_factor * np.isfinite(lp).sum()))
    keep = single & np.isfinite(lp)
    loss = K.passed(K.losses(pieces_lat, lp, vf, n_words), len(lp), "loss")
    found = np.flatnonzero(~np.isnan(loss))
    # numbers follow the pieces' order, so ties go to the first piece
    best = found[np.argsort(-loss[found], kind="stable")]
    keep[best[:max(pruned_size - int(keep.sum()), 0)]] = True
    return keep


def prune(words: DataFrame, pieces: DataFrame, desired_size: int,
          shrinking_factor: float = SHRINKING_FACTOR) -> DataFrame:
    """V5: keep the pieces whose removal would cost the most likelihood.

    Single characters are always kept; a piece never used by a best
    segmentation is dropped; a piece whose own best segmentation is not
    itself is dropped; the rest are ranked by loss."""
    numbered = K.number_pieces(pieces)
    lp = K.dense(numbered, numbered.count())
    vf = K.passed(K.viterbi_counts(K.word_lattice(words, numbered), lp), len(lp), "c")
    n_words = words.agg(F.sum("f").cast("double")).first()[0] or 0.0
    keep = _keep(_single(numbered, len(lp)), lp, vf, K.piece_lattice(numbered), n_words, desired_size, shrinking_factor)
    kept = numbered.join(_table(numbered.sparkSession, np.where(keep, 0.0, np.nan)), "k", "left_semi").select("piece")
    return pieces.join(kept, "piece", "left_semi")


def finalize(pieces: DataFrame, vocab_size: int = P.VOCAB_SIZE, chars: DataFrame | None = None) -> DataFrame:
    """V6: ``(id, token, lp, special)``: the five specials as ids 0-4, then
    pieces by ``(lp desc, piece)``.  Required characters are always kept, even
    if they alone exceed ``vocab_size`` (a missing one gets the lowest score);
    the best other pieces fill the rest."""
    spark = pieces.sparkSession
    room = vocab_size - len(P.SPECIAL_TOKENS)
    p = pieces.select("piece", "lp")
    if chars is not None:
        low = p.select(F.min("lp") - F.lit(UNK_PENALTY)).scalar()
        required = (chars.select("piece").distinct().join(p, "piece", "left")
                         .withColumn("lp", F.coalesce(F.col("lp"), low.cast("double"), F.lit(-UNK_PENALTY))))
        others = p.join(chars.select("piece"), "piece", "left_anti")
        p = required.unionByName(top_k(others, "lp", ["piece"], room - required.count()))
    else:
        p = top_k(p, "lp", ["piece"], room)
    ranked = global_rank(p, [F.col("lp").desc(), F.col("piece")], "_r")
    body = ranked.select((F.col("_r") + len(P.SPECIAL_TOKENS) - 1).cast("int").alias("id"), F.col("piece").alias("token"),
                         "lp", F.lit(False).alias("special"))
    specials = spark.createDataFrame([(i, t, 0.0, True) for i, t in enumerate(P.SPECIAL_TOKENS)],
                                     "id int, token string, lp double, special boolean")
    return specials.unionByName(body)


def _table(spark, lp: np.ndarray) -> DataFrame:
    """``(k, lp)`` of the pieces that have a score."""
    k = np.flatnonzero(np.isfinite(lp))
    return spark.createDataFrame(pa.table({"k": pa.array(k, pa.int32()), "lp": pa.array(lp[k], pa.float64())}))


def _thinned(lat: DataFrame, lp: np.ndarray) -> DataFrame:
    """``K.thin`` stored in place of ``lat``."""
    less = K.thin(lat, lp)
    out = stored(less)
    K.release(less)
    forget(lat)
    return out


def train(words: DataFrame, vocab_size: int = P.VOCAB_SIZE, seed_size: int = SEED_SIZE,
          n_sub_iterations: int = N_SUB_ITERATIONS, shrinking_factor: float = SHRINKING_FACTOR,
          log=None, base: DataFrame | None = None) -> DataFrame:
    """V1-V6 end to end on a ``(w, f)`` table; returns the vocabulary table.
    ``base`` (V7): a vocabulary table, such as a tokenizer file's, whose pieces and
    scores are the first model in place of counted seeds; characters of the
    words that it lacks are added at its lowest score less the unknown penalty.
    Rounds go on until the size is reached, or no piece is left to remove (the
    characters, which are all kept, may be more than the vocabulary)."""
    words = stored(words.select("w", "f"))
    if base is None:
        counted = seed_pieces(words, seed_size)
        seeds = stored(counted)
        forget(counted)
    else:
        seeds = stored(base_pieces(words, base))
    chars = seeds.where(F.length("piece") == 1).select("piece")
    desired = int(vocab_size * DESIRED_SIZE_FACTOR)
    n_words = words.agg(F.sum("f").cast("double")).first()[0] or 0.0
    numbered = K.number_pieces(seeds)
    lp = K.dense(numbered, numbered.count())
    single = _single(numbered, len(lp))
    find = K.send_finder(numbered)
    lat = stored(K.word_lattice(words, numbered, find))
    pieces_lat = None
    rnd = 0
    while True:
        for _ in range(n_sub_iterations):
            lp = m_step(K.passed(K.expected_counts(lat, lp), len(lp), "c"))
        size = int(np.isfinite(lp).sum())
        if log:
            log(f"round {rnd}: {size} pieces")
        if size <= desired:
            break
        if pieces_lat is None:
            pieces_lat = stored(K.piece_lattice(numbered, find))
        vf = K.passed(K.viterbi_counts(lat, lp), len(lp), "c")
        lp = np.where(_keep(single, lp, vf, pieces_lat, n_words, desired, shrinking_factor), lp, np.nan)
        if np.isfinite(lp).sum() >= size:
            break
        lat, pieces_lat = _thinned(lat, lp), _thinned(pieces_lat, lp)
        rnd += 1
    find.destroy()
    forget(lat, *([] if pieces_lat is None else [pieces_lat]))
    pieces = numbered.select("piece", "k").join(_table(numbered.sparkSession, lp), "k").select("piece", "lp")
    vocab = cut_lineage(finalize(pieces, vocab_size, chars))
    forget(words, seeds, numbered)
    return vocab


def encode_words(words: DataFrame, vocab: DataFrame, col: str = "w") -> DataFrame:
    """E1 + E3: ``(w, ids, tokens, score)`` per distinct word; unknown
    characters become ``<unk>`` and adjacent unknowns fuse into one, with the
    vocabulary's own id of ``<unk>`` (``UNK_ID`` where it has none)."""
    vocab = cut_lineage(vocab)
    unk = vocab.where(F.col("special") & (F.col("token") == "<unk>")).agg(F.min("id")).first()[0]
    pieces = vocab.where(~F.col("special")).select(F.col("token").alias("piece"), "lp", "id")
    best = K.best_pieces(words.select(F.col(col).alias("w")), pieces, P.UNK_ID if unk is None else unk)
    return best.select(F.col("w").alias(col), "ids", "tokens", "score")
