"""Operator 13 against brute force."""

import random
import re
from collections import Counter

import pytest

from corpuskit.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, phrase string, w1 string, n int, rank int"


def brute(rows, order=3, least=10, cover=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, order + 1):
                f.update((lang, tuple(w[i:i + size])) for i in range(len(w) - size + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    found = []
    for (lang, p), a in cand.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q)))
               for (g, q), b in cand.items()):
            continue
        score, k = min((10 ** 6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, rank = [], Counter()
    for lang, score, a, p, left, right in sorted(found):
        rank[lang] += 1
        if top is None or rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return out


def mined(spark, rows, **kw):
    docs = spark.createDataFrame([(1, t, g, "clash", "clash", 1, 1) for t, g in rows], SCHEMA)
    return sorted(tuple(r) for r in phrases.collocations(docs, bits=kw.pop("bits", 16), **kw).collect())


def texts(seed, n, words="a b c d e ff É ß A, b. C;".split()):
    rng = random.Random(seed)
    return [("".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", "\n"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None])) for _ in range(n)]


ODD = [(None, "en"), ("", None), (" \t\n", "en"), ("x" * 50_000, "en"), (" ".join(f"t{i}" for i in range(5_000)), "fr"),
       ("一 二 三 " * 20, "zh"), ("\x1c  y\x00 " * 15, "zh"), ("new york city " * 12, "en")] + [("new york city", "")] * 11


@pytest.mark.parametrize("bits", [9, 16])
def test_phrases_match_brute_force(spark, bits):
    rows = ODD + texts(1, 150)
    assert mined(spark, rows, bits=bits) == sorted(brute(rows))


def test_other_orders_and_limits(spark):
    rows = texts(2, 200, "a b c d".split())
    assert mined(spark, rows, order=4, least=6, cover=30, top=None) == sorted(brute(rows, 4, 6, 30, None))
    assert mined(spark, rows, order=2, least=3, top=4) == sorted(brute(rows, 2, 3, 50, 4))


def test_many_cells_are_summed_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FLUSH", 50)
    monkeypatch.setattr(phrases, "FAN", 2)
    rows = texts(5, 120)
    assert mined(spark, rows, bits=12) == sorted(brute(rows))


def test_empty_and_tiny_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [("a", "en")], order=4, least=1) == []
    assert mined(spark, [("a b", "en")], order=4, least=1) == brute([("a b", "en")], order=4, least=1)


def test_scores_beyond_64_bits(spark):
    # 10^6 a a passes 2^63 for a from 3,037,001 on
    from pyspark.sql import functions as F
    a = 4_000_000_000
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(a + 1).alias("l"), F.lit(a + 2).alias("r"))
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    got = row.select((whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)")).alias("x"), (whole("l") * whole("r")).alias("y")).select(F.expr("x div y")).first()[0]
    assert got == 10 ** 6 * a * a // ((a + 1) * (a + 2))
