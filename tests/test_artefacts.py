"""Committed versions of a tokeniser, tokenizer files, training on from one."""

import json
import os

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from corpuskit.operators import unigram
from corpuskit.sources import artefacts

PIECES = [("<unk>", 0.0), ("a", -2.0), ("b", -2.5), ("c", -3.0), ("ab", -2.2), ("bc", -2.9), ("cab", -4.0), ("\"ü", -4.5)]


def tables(spark, token):
    vocab = spark.createDataFrame([(5, token, -1.0, False)], "id int, token string, lp double, special boolean")
    words = spark.createDataFrame([(token, len(token))], "word string, length bigint")
    return artefacts.TokeniserTables(vocab, words, words, ["e"])


def test_a_save_that_breaks_off_leaves_the_old_version(spark, tmp_path, monkeypatch):
    d = str(tmp_path / "tok")
    with pytest.raises(Exception):
        artefacts.load_tokeniser(spark, d)
    artefacts.save_tokeniser(tables(spark, "old"), d)
    broken = tables(spark, "new")
    broken.dictionary = broken.dictionary.withColumn("length", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception):
        artefacts.save_tokeniser(broken, d)           # the vocabulary was written, the dictionary was not
    back = artefacts.load_tokeniser(spark, d)
    assert [r.token for r in back.vocab.collect()] == ["old"] == [r.word for r in back.dictionary.collect()]
    # a reader of the old version goes on with it while a new one is committed
    artefacts.save_tokeniser(tables(spark, "new"), d)
    assert [r.token for r in back.vocab.collect()] == ["old"]
    again = artefacts.load_tokeniser(spark, d)
    assert [r.token for r in again.vocab.collect()] == ["new"] == [r.word for r in again.small_dictionary.collect()]


def tokenizer_file(tmp_path):
    t = Tokenizer(models.Unigram(PIECES, unk_id=0, byte_fallback=False))
    t.add_special_tokens(["<mask>"])
    path = str(tmp_path / "base.json")
    t.save(path)
    return t, path


def test_tokenizer_file_gives_the_library_ids(spark, tmp_path):
    t, path = tokenizer_file(tmp_path)
    vocab = artefacts.read_tokenizer_file(spark, path)
    got = {r.token: (r.id, r.lp, r.special) for r in vocab.collect()}
    assert got == {**{p: (i, lp, p == "<unk>") for i, (p, lp) in enumerate(PIECES)}, "<mask>": (len(PIECES), 0.0, True)}
    words = ["abc", "cab", "abcab", "bca", "cabcab", "aabbcc", "b\"üa", "a\"b", "zza"]
    enc = unigram.encode_words(spark.createDataFrame([(w,) for w in words], "w string"), vocab)
    ids = {r.w: list(r.ids) for r in enc.collect()}
    assert ids == {w: t.encode(w).ids for w in words}


def test_other_models_raise(spark, tmp_path):
    path = tmp_path / "bpe.json"
    path.write_text(json.dumps({"model": {"type": "BPE", "vocab": [["a", 0]]}, "added_tokens": []}))
    with pytest.raises(Exception, match="not a Unigram"):
        artefacts.read_tokenizer_file(spark, str(path)).collect()


def test_training_goes_on_from_a_base(spark, tmp_path):
    _, path = tokenizer_file(tmp_path)
    base = artefacts.read_tokenizer_file(spark, path)
    words = spark.createDataFrame([("abc", 5), ("cab", 3), ("abd", 2)], "w string, f bigint")
    first = {r.piece: r.lp for r in unigram.base_pieces(words, base).collect()}
    assert first["cab"] == -4.0 and first["d"] == -4.5 - unigram.UNK_PENALTY and "<unk>" not in first and "<mask>" not in first
    vocab = {r.token: r.lp for r in unigram.train(words, vocab_size=30, base=base).where("not special").collect()}
    assert {"a", "b", "c", "d", "ab"} <= set(vocab) <= set(first)
    assert vocab["ab"] > vocab["d"]
