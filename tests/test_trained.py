"""Queries on the trained vocabulary against a plain Viterbi, on the smallest data."""

import re

import pytest

from corpuskit.functions import patterns as P
from corpuskit.operators import unigram
from corpuskit.plans import catalog
from corpuskit.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocab(spark):
    return cut_lineage(unigram.train(catalog.training_words(spark, SF), vocab_size=12_000))


def best_score(word, lp):
    """Score of the best segmentation; every character is a piece."""
    best = [0.0] + [None] * len(word)
    for e in range(1, len(word) + 1):
        best[e] = max(best[s] + lp[word[s:e]] for s in range(max(0, e - 16), e) if word[s:e] in lp)
    return best[-1]


def test_encode_and_compare_with_the_trained_vocabulary(spark, vocab, monkeypatch):
    monkeypatch.setattr(catalog, "_trained_vocab", lambda s, d: vocab)
    rows = vocab.collect()
    token = {r.id: r.token for r in rows}
    lp = {r.token: r.lp for r in rows if not r.special}
    assert 1000 < len(rows) <= 12_000
    splits = {r.w: r.parts.split(" ") for r in catalog.QUERIES["compound_split"](spark, SF).collect()}
    sents = {tuple(r[:3]): r.sent for r in catalog.split_sentences_table(spark, SF).where("split = 'train'")
             .select(*catalog.SENT_KEY, "sent").collect()}
    words_of = {}
    for r in catalog.QUERIES["pretokenise"](spark, SF).collect():
        words_of.setdefault((r.doc_id, r.line_no, r.sent_no), []).append((r.tok_no, r.token))
    got = {tuple(r[:3]): [int(x) for x in r.input_ids.split(",")] for r in catalog.QUERIES["encode_trained"](spark, SF).collect()}
    assert got.keys() == sents.keys()
    checked = 0
    for key, ids in got.items():
        words = [w for _, w in sorted(words_of.get(key, []))]
        ids = ids[1:ids.index(P.EOS_ID)]
        if len(ids) >= 126 or re.search(P.SPECIAL_TOKEN, sents[key]):
            continue
        pieces = [token[i] for i in ids]
        assert "".join(pieces) == "".join(words)
        want = sum(best_score(p, lp) for w in words for p in splits.get(w, [w]))
        assert abs(sum(lp[p] for p in pieces) - want) < 1e-6
        checked += 1
    assert checked > len(got) // 2
    per = {r.lang: r for r in catalog.QUERIES["tokeniser_compare_trained"](spark, SF).collect()}
    stats = {r.lang: r for r in catalog.QUERIES["tokeniser_compare"](spark, SF).collect()}
    assert per.keys() == stats.keys()
    for lang, r in per.items():
        assert r.n_pretokens == stats[lang].n_pretokens <= r.n_unigram_tokens and 0 < r.share_whole < 1
        assert 0 < r.n_piece_types <= len(rows)
    trained = {r.lang: r for r in catalog.QUERIES["trained_perplexity"](spark, SF).collect()}
    words = {}
    for r in catalog.sentence_tokens(spark, SF).select("lang", "token").collect():
        words.setdefault(r.lang, []).append(r.token)
    for lang, r in trained.items():
        assert r.n_words == len(words[lang]) and r.n_pieces >= r.n_words and r.perplexity > 1
