"""Arrays looked up by blocks of rows; joins by nothing but a key."""

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import joins
from corpuskit.operators import compound, encode


def _rows(spark, data, kind):
    return spark.createDataFrame(data, f"name string, x {kind}").repartition(3).withColumn("_row", F.monotonically_increasing_id()).localCheckpoint()


@pytest.mark.parametrize("bits,limit", [(15, joins.BROADCAST_ROWS), (0, 0), (1, 0)])
def test_arrays_are_looked_up_whole(spark, monkeypatch, bits, limit):
    monkeypatch.setattr(joins, "BLOCK_BITS", bits)
    monkeypatch.setattr(joins.bounded_broadcast, "__defaults__", (limit,))
    words = spark.createDataFrame([("a", [5]), ("b", [6, 7]), ("c", []), ("d", None)], "w string, ids array<int>")
    data = [(None, "a b a"), ("k", ""), ("k", None), ("k", "zz b"), ("m", "c"), ("m", "d c a")]
    got = joins.lookup_arrays(_rows(spark, data, "string"), "x", words, "w", "ids", missing=[3]).collect()
    want = [(None, [5, 6, 7, 5]), ("k", []), ("k", []), ("k", [3, 6, 7]), ("m", []), ("m", [3, 5])]
    assert sorted(got, key=str) == sorted(want, key=str) or sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_entries_without_a_value_stay_as_null(spark):
    vocab = spark.createDataFrame([(1, "<s>"), (9, "kat")], "id int, token string")
    got = joins.lookup_arrays(_rows(spark, [("a", [1, 9, 8]), ("b", [])], "array<int>"), "x", vocab, "id", "token").collect()
    assert {r.name: r.x for r in got} == {"a": ["<s>", "kat", None], "b": []}


def test_encoding_shuffles_no_row_per_token(spark):
    """A word that is in every sentence is one row a block."""
    sents = spark.createDataFrame([(i, "den den den kat") for i in range(3000)], "k int, sent string")
    ids = spark.createDataFrame([("den", [7]), ("kat", [8, 9])], "w string, ids array<int>")
    out = encode.encode_sentences(sents, ids, ["k"])
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert [tuple(r.ids) for r in out.select("ids").distinct().collect()] == [(7, 7, 7, 8, 9)] and out.count() == 3000


def test_decoding_reads_rows_of_one_key_by_position(spark):
    vocab = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, token string")
    df = spark.createDataFrame([(None, [1, 2]), (None, [3]), (4, [2, 1]), (5, [])], "k int, ids array<int>")
    got = {r.k: r.tokens for r in encode.decode(df, vocab, ["k"]).collect()}
    assert got == {None: ["a", "c", "b"], 4: ["b", "a"]}


def test_a_table_past_the_broadcast_limit_meets_rows_that_are_only_keys(spark, monkeypatch):
    """F8: there was no column to take a salt from, and the join failed."""
    monkeypatch.setattr(joins.lookup_join, "__defaults__", (*joins.lookup_join.__defaults__[:-1], 0))
    vocab = spark.createDataFrame([(5, "kat"), (6, "hund")], "id int, token string")
    wanted = spark.createDataFrame([("kat",), ("ko",), ("kat",)], "token string")
    assert {tuple(r) for r in encode.vocab_lookup(vocab, wanted).collect()} == {("kat", 5), ("ko", 3)}
    dicts = spark.createDataFrame([("kat", "small", 3)], "word string, kind string, length int")
    got = compound.word_lookup(spark.createDataFrame([("kat",), ("ko",)], "w string"), dicts).collect()
    assert {tuple(r) for r in got} == {("kat", True, False), ("ko", False, False)}


def test_a_mask_draws_once_a_position(spark):
    """the draw was computed for every comparison with it."""
    from corpuskit.operators import mlm
    df = spark.createDataFrame([(1, list(range(200)))], "k int, input_ids array<int>")
    out = mlm.mask(df, ["k"], 1000)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 2
    want = [i for i in range(5, 200) if int(__import__("hashlib").md5(f"4242:0:1:{i}".encode()).hexdigest()[:6], 16) < mlm.SELECT_T]
    assert [i for i, v in enumerate(out.first().labels) if v != -100] == want


def test_perplexity_of_counted_words(spark):
    """one row per word and language stands for its occurrences."""
    from corpuskit.operators import evaluate
    rows = spark.createDataFrame([("da", -2.0, 1), ("da", -2.0, 1), ("da", -5.0, 3), ("da", None, None)], "lang string, score double, n_pieces int")
    counted = spark.createDataFrame([("da", -2.0, 1, 2), ("da", -5.0, 3, 1), ("da", None, None, 1)],
                                    "lang string, score double, n_pieces int, f bigint")
    assert evaluate.corpus_perplexity(rows).collect() == evaluate.corpus_perplexity(counted, weight="f").collect()
