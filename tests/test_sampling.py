"""U1-U5 properties: exact sizes, disjoint and complete, same for any partitioning."""

from pyspark.sql import functions as F

from corpuskit.operators import sampling


def test_split_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"))
    a = sampling.train_test_split(df, ["doc_id"])
    b = sampling.train_test_split(df.repartition(13), ["doc_id"])
    sa = {r.doc_id: r.split for r in a.collect()}
    sb = {r.doc_id: r.split for r in b.collect()}
    assert sa == sb
    assert sum(1 for v in sa.values() if v == "train") == 990
    assert len(sa) == 1000


def test_interleave_round_robin(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(3)], "src string, i long")
    out = sampling.interleave(df, "src", ["i"]).orderBy("position").collect()
    assert [(r.src, r.i) for r in out] == [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("a", 2), ("b", 2)]


def test_shuffle_is_permutation(spark):
    df = spark.range(200).select(F.col("id").alias("k"))
    out = sampling.shuffle_order(df, ["k"], epoch=3).collect()
    assert sorted(r.position for r in out) == list(range(200))
    assert [r.k for r in sorted(out, key=lambda r: r.position)] != list(range(200))


def test_batches(spark):
    df = spark.range(20).select(F.col("id").alias("row_idx"))
    b = [r.batch for r in sampling.assign_batches(df).orderBy("row_idx").collect()]
    assert b == [0] * 8 + [1] * 8 + [2] * 4


def odd(spark):
    """Null keys, repeated rows, and other rows under a repeated key."""
    rows = [(None, "a b", "x"), (None, "c", "x"), (None, "a b", "x"), (1, "a b", "x"), (1, "a b", "x"), (1, "d e f", "y"), (2, "", None), (3, None, "y")]
    return rows, spark.createDataFrame(rows, "k long, sent string, src string")


def test_split_and_shuffle_keep_all_rows(spark):
    from collections import Counter
    rows, df = odd(spark)
    for parts in (1, 3):
        got = sampling.train_test_split(df.repartition(parts), ["k"], train_size=0.5).collect()
        assert Counter((r.k, r.sent, r.src) for r in got) == Counter(rows)
        for name in ("train", "test"):
            assert sorted(r.row_idx for r in got if r.split == name) == [0, 1, 2, 3]
        got = sampling.shuffle_order(df.repartition(parts), ["k"], epoch=2).collect()
        assert Counter((r.k, r.sent, r.src) for r in got) == Counter(rows) and sorted(r.position for r in got) == list(range(8))
    places = [sorted((r.position, str(r.k), str(r.sent)) for r in sampling.shuffle_order(df.repartition(p), ["k"]).collect()) for p in (1, 4)]
    assert places[0] == places[1]


def test_interleave_has_a_null_source(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 2), ("a", 3), ("b", 7), ("b", 7)], "src string, i long")
    got = sampling.interleave(df, "src", ["i"]).orderBy("position").collect()
    assert [(r.position, r.src, r.i) for r in got] == [(0, None, 1), (1, "a", 1), (2, "b", 7), (3, None, 2), (4, "a", 2), (5, "b", 7)]


def test_encoding_keeps_equal_rows_apart(spark):
    from corpuskit.operators import encode
    rows, df = odd(spark)
    words = spark.createDataFrame([("a", [5]), ("b", [6]), ("c", [7])], "w string, ids array<int>")
    got = encode.encode_sentences(df, words, ["k"], "sent", carry=["src"]).collect()
    unk = encode.P.UNK_ID
    known = {"a": 5, "b": 6, "c": 7}
    want = [(k, [known.get(w, unk) for w in (s or "").split()], src) for k, s, src in rows]
    assert sorted(map(str, [(r.k, r.ids, r.src) for r in got])) == sorted(map(str, want))
