"""Seeds by growing lengths are those of counting all substrings."""

import random
from collections import Counter

import pytest

from corpuskit.operators import unigram


def _all(words, max_len):
    count = Counter()
    for w, f in words:
        for s in range(len(w)):
            for e in range(s + 1, min(len(w), s + max_len) + 1):
                count[w[s:e]] += f
    return {p: n for p, n in count.items() if len(p) == 1 or n >= 2}


@pytest.mark.parametrize("max_len", [1, 2, 3, 7, 16])
def test_counts_equal_all_substrings(spark, max_len):
    rng = random.Random(max_len)
    words = sorted({"".join(rng.choice("aabcdé") for _ in range(rng.randint(1, 24))) for _ in range(80)} | {"a" * 40, "xyxyxyxyxyxyxyxyxyxy", "q"})
    words = [(w, rng.choice([1, 1, 1, 2, 5])) for w in words]
    table = spark.createDataFrame(words, "w string, f bigint")
    for steps in (unigram.SEED_STEPS, (2, 4, 8), (1, 3)):
        got = unigram.counted_substrings(table, max_len, steps).collect()
        assert {r.piece: r.freq for r in got} == _all(words, max_len) and len(got) == len({r.piece for r in got})


def test_empty_words_have_no_pieces(spark):
    seeds = unigram.seed_pieces(spark.createDataFrame([("", 4), ("ab", 2)], "w string, f bigint"))
    assert {r.piece for r in seeds.collect()} == {"a", "b", "ab"}
