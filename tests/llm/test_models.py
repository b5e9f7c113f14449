"""Operators 2, 5 and 8: exact parts by brute force, the rest by held-out accuracy."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from conftest_llm import crc, words
from corpuskit.llm import hmm_scoring, quality, toxicity
from corpuskit.llm.common import hash_beginnings, hash_endings, hash_words, text_buffers

SF = "/root/testdata/sf0.01"


def buffers(texts):
    import pyarrow as pa
    return text_buffers(pa.array(texts, pa.string()))


def test_word_hashes_tell_words_apart():
    texts = ["", "Ab ab  cd\tAB", "x", " \n", "é é\x85a ab", "cd"]
    hashes, first = hash_words(*buffers(texts))
    flat = [w for t in texts for w in words(t)]
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    assert len({(w, int(h)) for w, h in zip(flat, hashes)}) == len(set(flat)) == len(set(hashes.tolist()))
    head, _ = hash_beginnings(*buffers(["abcd abce xbcd ab"]), 3)
    tail, _ = hash_endings(*buffers(["abcd abce xbcd cd"]), 3)
    assert head[0] == head[1] != head[2] and tail[0] == tail[2] != tail[1]


def test_context_vectors_are_neighbour_sums(spark, table):
    docs = [(1, "a b c"), (2, "b c a a")]
    got = quality.context_vectors(table(docs))
    place, sign = quality._index_vectors()
    want = np.zeros((quality.UNITS, quality.DIMS))
    for _, t in docs:
        own, shapes, _ = quality._units(*buffers([t]))
        for units in (own, shapes):
            for i, j in itertools.permutations(range(len(units)), 2):
                if abs(i - j) <= quality.WINDOW:
                    np.add.at(want[units[i]], place[units[j]], sign[units[j]])
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, want, atol=1e-6)


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in held]) > 0.9


def test_quality_odd_rows_and_no_labels(spark, table, odd_rows):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.quality_scores(table(odd_rows), labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows) and {r.score for r in got} == {0.5}
    assert quality.quality_scores(table([]), labels).count() == 0


def test_good_documents_judges_each_row_by_its_own_text(spark, table):
    rng = np.random.default_rng(3)
    good = lambda: " ".join(rng.choice(["the", "river", "flows", "past", "green", "hills"], 30))
    bad = lambda: " ".join(rng.choice(["$$$", "!!!", "click99", "###", "@@x", "%%7"], 30))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    keep = [(None, good()), (None, good()), (1000, good())]
    drop = [(None, bad()), (None, bad()), (1000, bad())]
    out = quality.good_documents(table(rows + keep + drop), labels)
    got = {(r.doc_id, r.text) for r in out.where("doc_id is null or doc_id = 1000").collect()}
    assert got == set(keep) and out.columns == table([]).columns


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet("/root/testdata/sf0.1/" + t + ".parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    hit = [p for p, t in held if t == 1]
    assert np.mean(hit) > 0.8 and np.mean([p for p, t in held if t == 0]) < 0.02


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(1)
    n = 600
    sign = rng.integers(0, 2, n)
    at, first = np.zeros(n, np.int64) + 5 + sign, np.arange(n + 1)
    labels = np.column_stack([sign, sign]).astype(float)
    chain = toxicity.fit_chain(at, first, labels, rng.integers(0, 3, n))
    assert len(chain) == 2 and len(chain[0].extra) == 0 and len(chain[1].extra) == 1 and chain[1].extra[0] > 0
    p = toxicity.chain_probabilities(chain, at, first)
    assert ((p[:, 1] > 0.5) == (sign == 1)).all()


def test_toxicity_odd_rows(spark, table, odd_rows):
    labels = spark.createDataFrame([(4, 1), (8, 0)], "doc_id bigint, toxic int")
    got = toxicity.toxicity_scores(table(odd_rows), labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows)
    assert toxicity.toxicity_scores(table([]), labels).count() == 0


def test_hmm_likelihood_and_counts_by_enumeration():
    rng = np.random.default_rng(2)
    k, c = hmm_scoring.STATES, hmm_scoring.CLASSES
    model = hmm_scoring.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k))
    cls, length = np.array([3, 9, 9, 4, 0, 7]), np.array([4, 1, 1])
    at, total, starts, emit = 0, [], np.zeros(k), np.zeros((k, c))
    for n in length:
        x, p, posterior = cls[at:at + n], 0.0, []
        for path in itertools.product(range(k), repeat=int(n)):
            q = model.start[path[0]] * np.prod([model.move[a, b] for a, b in zip(path, path[1:])]) * np.prod([model.emit[s, o] for s, o in zip(path, x)])
            p += q
            posterior.append((path, q))
        for path, q in posterior:
            starts[path[0]] += q / p
            for s, o in zip(path, x):
                emit[s, o] += q / p
        total.append(math.log10(p))
        at += n
    assert np.allclose(model.log10(cls, length), total)
    got = model.expected(cls, length)
    assert np.allclose(got[0], starts) and np.allclose(got[2], emit) and math.isclose(got[1].sum(), (length - 1).sum())


def test_long_texts_equal_the_plain_recursion():
    rng = np.random.default_rng(3)
    k, c = hmm_scoring.STATES, hmm_scoring.CLASSES
    model = hmm_scoring.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k))
    length = np.array([500, 64, 65, 1])
    cls = rng.integers(0, c, length.sum())
    want, at = [], 0
    for n in length:
        a, s = model.start, 0.0
        for t, o in enumerate(cls[at:at + n]):
            a = (a if t == 0 else a @ model.move) * model.emit[:, o]
            s += math.log10(a.sum())
            a = a / a.sum()
        want.append(s)
        at += n
    assert np.allclose(model.log10(cls, length), want)


def base_brute(rows):
    count = Counter()
    for i, t in rows:
        if crc(i) % 7 != 2:
            count.update([*words(t), "\n"])
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        x = [*words(t), "\n"]
        out.append((i, len(x), sum(w in count for w in x), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), 6)))
    return Counter(out)


def test_base_scores_match_brute_force(spark, table, odd_rows, monkeypatch):
    monkeypatch.setattr(hmm_scoring, "BLOCK_TOKENS", 50)
    rows = odd_rows + [(i, f"some words number {i} and word{i % 5}") for i in range(100, 160)]
    got = hmm_scoring.score_documents(table(rows), iterations=2).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base_brute(rows)
    assert all(r.held_out == (crc(r.doc_id) % 7 == 2) and r.score < 0 for r in got)


def test_training_beats_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = hmm_scoring.score_documents(docs).where("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]


def test_hmm_empty_table(spark, table):
    assert hmm_scoring.score_documents(table([])).count() == 0


def test_samples_have_one_text_of_each_labelled_id(spark, table, monkeypatch):
    """A labelled id that occurs often fits one row, whatever order the rows come in."""
    rows = [(1, f"text {k % 7} of the one id told over and over") for k in range(300)] + [(2, "another text of another id")] * 40
    seen = []
    real = quality.Network.fit
    monkeypatch.setattr(quality.Network, "fit", lambda self, x, y, tune, **kw: seen.append((len(x), x.tobytes())) or real(self, x, y, tune, **kw))
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (1, 1, 1)], "doc_id bigint, label int, toxic int")
    for max_rows, want in ((1, 1), (10, 2)):
        for parts in (1, 5):
            docs = table(rows).repartition(parts)
            quality.fit(docs, labels, quality.context_vectors(docs), max_rows=max_rows)
        assert [n for n, _ in seen] == [want, want] and seen[0] == seen[1]
        seen.clear()
    kept = []
    chain = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda at, first, y, fold: kept.append(len(y)) or chain(at, first, y, fold))
    toxicity.train(table(rows), labels, {}, max_rows=1)
    assert kept == [2]
