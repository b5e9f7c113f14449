"""Brute force on small fixtures and goldens."""

import itertools
import math

from pyspark.sql import functions as F

from corpuskit.functions import numeric
from corpuskit.functions import patterns as P
from corpuskit.operators import encode, evaluate, mlm, unigram

PIECES = {"a": -2.0, "b": -2.5, "c": -3.0, "ab": -2.2, "bc": -2.9, "abc": -5.5, "ca": -3.3, "cab": -4.0}
WORDS = {"abc": 3, "cab": 2, "abcab": 1, "bca": 4, "aabbcc": 1, "cabcab": 2}


def segmentations(w):
    if not w:
        yield []
        return
    for k in range(1, len(w) + 1):
        if w[:k] in PIECES:
            for rest in segmentations(w[k:]):
                yield [w[:k]] + rest


def _pieces(spark):
    return spark.createDataFrame(list(PIECES.items()), "piece string, lp double")


def _words(spark):
    return spark.createDataFrame(list(WORDS.items()), "w string, f bigint")


def test_viterbi_is_best_segmentation(spark):
    got = {r.w: (r.best.score, [x.piece for x in r.best.path])
           for r in unigram.viterbi_words(_words(spark), _pieces(spark)).collect()}
    for w in WORDS:
        best = max(segmentations(w), key=lambda s: sum(PIECES[p] for p in s))
        score = sum(PIECES[p] for p in best)
        assert math.isclose(got[w][0], score, abs_tol=1e-9)
        assert math.isclose(sum(PIECES[p] for p in got[w][1]), score, abs_tol=1e-9)


def test_estep_matches_enumeration(spark):
    got = {r.piece: r.c for r in unigram.e_step(_words(spark), _pieces(spark)).collect()}
    expected = {}
    for w, f in WORDS.items():
        segs = list(segmentations(w))
        z = sum(math.exp(sum(PIECES[p] for p in s)) for s in segs)
        for s in segs:
            pr = math.exp(sum(PIECES[p] for p in s)) / z
            for p in s:
                expected[p] = expected.get(p, 0.0) + f * pr
    assert set(got) == set(expected)
    for p in expected:
        assert math.isclose(got[p], expected[p], rel_tol=1e-9)


def test_digamma_values(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (10.0,)], "x double")
    vals = [r.d for r in df.select(numeric.digamma(F.col("x")).alias("d")).collect()]
    for v, ref in zip(vals, (-1.9635100260214235, -0.5772156649015329, 2.251752589066721)):
        assert abs(v - ref) < 1e-6


def test_mstep_and_finalize(spark):
    counts = spark.createDataFrame([("a", 10.0), ("b", 5.0), ("ab", 0.4)], "piece string, c double")
    m = {r.piece: r.lp for r in unigram.m_step(counts).collect()}
    assert set(m) == {"a", "b"} and m["a"] > m["b"]
    vocab = unigram.finalize(unigram.m_step(counts).select("piece", "lp"), 7).orderBy("id").collect()
    assert [r.token for r in vocab] == P.SPECIAL_TOKENS + ["a", "b"]


def test_training_reaches_target(spark):
    words = spark.createDataFrame([(w, f) for w, f in WORDS.items()] + [("abcabc", 5), ("bcabca", 3)], "w string, f bigint")
    vocab = unigram.train(words, vocab_size=9, seed_size=50)
    rows = vocab.collect()
    assert len(rows) <= 9 + 3  # target plus required characters
    assert sorted(r.id for r in rows) == list(range(len(rows)))
    assert {"a", "b", "c"} <= {r.token for r in rows}


def test_encode_unknown_fuses(spark):
    vocab = unigram.finalize(_pieces(spark), 50)
    w = spark.createDataFrame([("abxyc",)], "w string")
    r = unigram.encode_words(w, vocab).first()
    assert r.tokens == ["ab", "<unk>", "c"] and r.ids[1] == P.UNK_ID


def test_wrap_truncate_pad_golden(spark):
    df = spark.createDataFrame([([7, 8, 9, 10],)], "ids array<int>")
    wrapped = encode.add_specials(F.col("ids"), 5)
    r = df.select(encode.pad_to(wrapped, 6).alias("x"), encode.attention_mask(wrapped, 6).alias("m")).first()
    assert r.x == [1, 7, 8, 9, 2, 0] and r.m == [1, 1, 1, 1, 1, 0]


def test_mask_properties(spark):
    rows = [(i, list(range(1, 200))) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, input_ids array<int>")
    out = mlm.mask(df.withColumnRenamed("input_ids", "orig").withColumn("input_ids", F.col("orig")), ["k"], 1000).collect()
    selected = 0
    total = 0
    for r in out:
        for o, new, lab in zip(r.orig, r.input_ids, r.labels):
            total += 1
            if lab == P.IGNORE_INDEX:
                assert new == o
            else:
                selected += 1
                assert lab == o and o > 4
    assert 0.12 < selected / total < 0.18
    again = mlm.mask(df.repartition(7), ["k"], 1000).orderBy("k").collect()
    first = mlm.mask(df, ["k"], 1000).orderBy("k").collect()
    assert [r.labels for r in again] == [r.labels for r in first]


def _gap(loss):
    """Two logits whose loss for label 0 is ``loss``."""
    return [0.0, math.log(math.exp(loss) - 1.0)]


def test_perplexity_golden(spark):
    # 20 sequences, batches of 8: means 1 and 2, third (short) batch mean 3
    rows = [(100 + 3 * i, 0, 0, _gap(1.0 if i < 8 else 2.0 if i < 16 else 3.0)) for i in range(20)]
    df = spark.createDataFrame(rows, "seq_id long, pos int, label int, logits array<float>")
    r = evaluate.mlm_metrics(df).first()
    assert abs(r.perplexity - math.exp((1 + 2 + 3) / 2)) < 1e-4
    assert r.accuracy == 0.0 and r.n_seqs == 20


def test_batches_are_of_sequences(spark):
    # 16 sequences of 75 positions with one constant loss: its exponential
    rows = [(s, p, 0, _gap(1.3133)) for s in range(16) for p in range(75)]
    df = spark.createDataFrame(rows, "seq_id long, pos int, label int, logits array<float>")
    r = evaluate.mlm_metrics(df).first()
    assert abs(r.perplexity - 3.718) < 1e-3 and (r.n_seqs, r.n_scored) == (16, 1200)


def test_vocabulary_keeps_all_required_characters(spark):
    chars = spark.createDataFrame([(chr(0x4E00 + i),) for i in range(30)], "piece string")
    pieces = chars.withColumn("lp", F.lit(-3.0)).unionByName(_pieces(spark))
    vocab = {r.token for r in unigram.finalize(pieces, 12, chars).collect()}
    assert {chr(0x4E00 + i) for i in range(30)} <= vocab and len(vocab) == 35


def test_two_best_paths_match_enumeration():
    import random
    import numpy as np
    from corpuskit.functions.lattice_kernels import Edges, best_paths, two_best_paths
    rng = random.Random(8)
    words, plain = [], []
    for _ in range(60):
        n = rng.randint(1, 6)
        edges = sorted((e, s, -rng.random() * (1 if rng.random() < 0.8 else 0) - 0.5) for s in range(n) for e in range(s + 1, n + 1) if e == s + 1 or rng.random() < 0.6)
        words.append((n, edges))

        def paths(at, edges=edges, n=n):
            return [[]] if at == n else [[i, *p] for i, (e, s, _) in enumerate(edges) if s == at for p in paths(e)]
        plain.append(sorted(((sum(edges[i][2] for i in p), p) for p in paths(0)), reverse=True))
    x = Edges(*([[t[k] for t in edges] for _, edges in words] for k in (1, 0, 2)), [n for n, _ in words])
    for (n, edges), first, (a, b), every in zip(words, best_paths(x), two_best_paths(x), plain):
        value = lambda p: sum(edges[i][2] for i in p)  # noqa: E731,B023
        assert a.tolist() == first.tolist() and np.isclose(value(a), every[0][0])
        if len(every) == 1:
            assert not len(b)
        else:
            assert a.tolist() != b.tolist() and np.isclose(value(b), every[1][0])
            assert [edges[i][1] for i in b] == [0, *[edges[i][0] for i in b[:-1]]] and edges[b[-1]][0] == n


def test_prune_keeps_the_costliest_pieces(spark):
    words = _words(spark)

    def best(w, without=None):
        return max((s for s in segmentations(w) if without is None or s != [without]), key=lambda s: sum(PIECES[p] for p in s))
    vf = {}
    for w, f in WORDS.items():
        for p in best(w):
            vf[p] = vf.get(p, 0.0) + f
    total, n = sum(vf.values()), sum(WORDS.values())
    loss = {}
    for p in PIECES:
        if len(p) > 1 and p in vf and best(p) == [p]:
            alt = best(p, p)
            after = total + vf[p] * (len(alt) - 1)
            loss[p] = vf[p] / n * (math.log(vf[p] / total) - sum(math.log((vf.get(a, 0.0) + vf[p]) / after) for a in alt))
    for size in (4, 5, 6):
        want = {"a", "b", "c", *sorted(loss, key=lambda p: (-loss[p], p))[:size - 3]}
        assert {r.piece for r in unigram.prune(words, _pieces(spark), size, 0.0).collect()} == want


def test_top_k_matches_a_sort(spark):
    import random
    from corpuskit.functions.ranking import top_k
    rng = random.Random(3)
    rows = [(i, rng.choice([0.0, 1.0, -1.0, rng.gauss(0, 100), rng.gauss(0, 1e-6), 5.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, s double")
    for k in (0, 1, 57, 200, 399, 400, 500):
        want = {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}
        assert {r.i for r in top_k(df, "s", ["i"], k).collect()} == want


def test_sentence_without_tokens_keeps_its_row(spark):
    sents = spark.createDataFrame([(1, "\u00a0 \u00a0"), (2, "a b")], "k long, sent string")
    ids = spark.createDataFrame([("a", [7]), ("b", [8])], "w string, ids array<int>")
    got = {r.k: r.ids for r in encode.encode_sentences(sents, ids, ["k"]).collect()}
    assert got == {1: [], 2: [7, 8]}


def test_compatibility_characters_find_their_word(spark):
    sents = spark.createDataFrame([(1, "ﬁsch №5")], "k long, sent string")
    ids = spark.createDataFrame([("fisch", [7]), ("no5", [8])], "w string, ids array<int>")
    assert encode.encode_sentences(sents, ids, ["k"]).first().ids == [7, 8]


def test_salted_lookup_equals_the_broadcast_one(spark):
    from corpuskit.functions.joins import lookup_join
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"w{i}") for i in range(600)], "i long, w string")
    table = spark.createDataFrame([("hot", 1), ("w3", 2), ("w9", 3)], "w string, v int")
    rows = lambda df: sorted((r.i, r.w, r.v) for r in df.collect())
    salted = lookup_join(big, table, "w", "left", max_broadcast_rows=0)
    assert "_salt" in salted._jdf.queryExecution().analyzed().toString()
    assert rows(salted) == rows(lookup_join(big, table, "w", "left"))


def test_decode_roundtrip(spark):
    vocab = spark.createDataFrame([(0, "<pad>"), (5, "kat"), (6, "hund")], "id int, token string")
    df = spark.createDataFrame([(1, [5, 6, 0])], "k long, ids array<int>")
    assert encode.decode(df, vocab, ["k"]).first().tokens == ["kat", "hund", "<pad>"]
