"""The lattice that training keeps: dropped pieces, thinning, words of any length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import kept_lattice as K
from corpuskit.operators import unigram
from test_unigram_encode import PIECES, WORDS, _pieces, _words


def _counts(df):
    return {r.k: r.c for r in df.collect()}


def _set_up(spark):
    numbered = K.number_pieces(_pieces(spark))
    number = {r.piece: r.k for r in numbered.collect()}
    return numbered, number, K.dense(numbered, len(number))


def test_numbers_follow_the_pieces(spark):
    _, number, lp = _set_up(spark)
    assert sorted(number, key=number.get) == sorted(PIECES)
    assert [PIECES[p] for p in sorted(PIECES)] == lp.tolist()


def test_dropped_pieces_are_as_if_never_there(spark):
    numbered, number, lp = _set_up(spark)
    words = spark.createDataFrame([*WORDS.items(), ("bbbb", 2)], "w string, f bigint")
    for gone in (["abc", "cab"], ["a"], ["b", "bc"]):
        left = lp.copy()
        left[[number[p] for p in gone]] = np.nan
        lat = K.word_lattice(words, numbered).cache()
        anew = unigram.e_step(words, numbered.where(~F.col("piece").isin(gone)).select("piece", "lp"))
        want = {number[r.piece]: r.c for r in anew.collect()}
        for kept in (lat, K.thin(lat, left)):
            assert _counts(K.expected_counts(kept, left)) == pytest.approx(want)
            assert _counts(K.viterbi_counts(kept, left)).keys() <= want.keys()


def test_thinned_pieces_give_the_same_losses(spark):
    numbered, number, lp = _set_up(spark)
    lp[number["cab"]] = np.nan
    vf = np.where(np.isnan(lp), np.nan, 3.0)
    lat = K.piece_lattice(numbered)
    loss = lambda x: {r.k: r.loss for r in K.losses(x, lp, vf, 10.0).collect()}
    assert loss(K.thin(lat, lp)) == pytest.approx(loss(lat)) and number["cab"] not in loss(lat)


def test_a_very_long_word_among_short_ones(spark, monkeypatch):
    numbered, number, lp = _set_up(spark)
    words = spark.createDataFrame([*WORDS.items(), ("ab" * 3000, 1)], "w string, f bigint")
    got = _counts(K.viterbi_counts(K.word_lattice(words, numbered), lp))
    short = _counts(K.viterbi_counts(K.word_lattice(_words(spark), numbered), lp))
    assert got[number["ab"]] == short.get(number["ab"], 0) + 3000


def test_no_words(spark):
    none = spark.createDataFrame([], "w string, f bigint")
    assert unigram.e_step(none, _pieces(spark)).count() == 0
    assert unigram.seed_pieces(none).count() == 0


def test_a_model_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(K, "MAX_PIECES", 3)
    with pytest.raises(ValueError, match="seed_size"):
        K.number_pieces(_pieces(spark))


def test_a_task_finds_every_edge_itself(spark):
    """No row per substring is joined or grouped."""
    pieces = ["a", "é", "aé", "éa", "𝒳a", "aéa", "a" * 16, "a" * 17]
    words = ["aéa𝒳a", "a" * 20, "q", "é"]
    size, e, s, k = K.Finder(np.arange(len(pieces)), pieces).edges(words, 16)
    want = [(w, j, i, pieces.index(t[i:j]) if t[i:j] in pieces else -1) for w, t in enumerate(words)
            for j in range(1, len(t) + 1) for i in range(max(0, j - 16), j) if t[i:j] in pieces or j - i == 1]
    assert [*zip(np.repeat(np.arange(len(words)), size), e, s, k)] == want
    numbered, _, _ = _set_up(spark)
    assert "Aggregate" not in K.word_lattice(_words(spark), numbered)._jdf.queryExecution().executedPlan().toString()


def test_pieces_that_share_a_hash_get_another_base():
    find = K.Finder(np.arange(2), ["ab", "cd"])
    find.base = 0  # by this one, pieces with the same last character share a hash
    find.tables = {2: (np.arange(2), K._points(["ab", "cb"]).reshape(2, 2))}
    assert not find._hash()
