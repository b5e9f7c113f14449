"""C1-C5 goldens (FIXTURES section 3), brute force against the recursive
definition, and L9 longest-word rule."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import compound, lexicon

SMALL = ["haus", "tür", "garten", "zeit", "sonne", "blume", "arbeit", "königreich"]
FULL = ["schlüssel", "tag", "topf", "plan", "zeitplan", "besprechungsraum"]
FILLER = "abcdefghijklmnopqrst"

PADDED = {
    "sonnentag": "sonne n tag", "arbeitszeitsplan": "arbeit s zeit s plan", "blumentopf": "blume n topf",
    "zeitsplan": "zeit s plan", "königreichstag": "königreich s tag", "arbeitsbesprechungsraum": "arbeit s besprechungsraum",
}
UNSPLIT = ["haustür", "gartenhaus", "zeitplaner", "stag", "arbeits", "sonnen"]


def _dicts(spark, small, full):
    def table(words, kind):
        df = spark.createDataFrame([(w,) for w in words], "word string").withColumn("length", F.length("word").cast("bigint"))
        return lexicon.drop_longest(df).withColumn("kind", F.lit(kind))
    return table(small, "small").unionByName(table(full, "full"))


def _split(spark, words, small, full, interfixes=("e", "n", "s")):
    w = spark.createDataFrame([(x,) for x in words], "w string")
    out = compound.compound_splits(w, _dicts(spark, small, full), list(interfixes))
    return {r.w: " ".join(r.parts) for r in out.collect()}


def test_golden_padded(spark):
    got = _split(spark, list(PADDED) + UNSPLIT, SMALL + [FILLER], FULL + [FILLER])
    assert got == PADDED


def test_golden_short(spark):
    # without filler words the longest word of either list is the one dropped
    got = _split(spark, list(PADDED) + UNSPLIT, SMALL, FULL)
    expected = {k: v for k, v in PADDED.items() if k not in ("königreichstag", "arbeitsbesprechungsraum")}
    assert got == expected


def enumerated_split(w, small, full, interfixes):
    """The best of all cut lists: every subset of the positions that hold an
    interfix is tried; heads must be small words and the rest a full word; the
    least cut list wins, an end mark counting as larger than any cut."""
    at = [p for p, c in enumerate(w) if c in interfixes]
    valid = []
    for k in range(1, len(at) + 1):
        for cuts in itertools.combinations(at, k):
            starts = [0, *(p + 1 for p in cuts)]
            heads = [w[a:b] for a, b in zip(starts, cuts)]
            if all(h in small for h in heads) and w[starts[-1]:] in full:
                valid.append((*cuts, len(w) + 1))
    if not valid:
        return None
    cuts = min(valid)[:-1]
    starts = [0, *(p + 1 for p in cuts)]
    parts = [x for a, b in zip(starts, cuts) for x in (w[a:b], w[b])]
    return " ".join([*parts, w[starts[-1]:]])


def test_brute_force_random(spark):
    rng = random.Random(7)
    alphabet = "aens"
    small = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3))) for _ in range(12)})
    full = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(12)})
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(3, 12))) for _ in range(400)})
    got = _split(spark, words, small, full)
    # the lists as the splitter sees them (longest tier dropped)
    ms, mf = max(map(len, small)), max(map(len, full))
    s_eff = {w for w in small if len(w) < ms and len(w) >= 1}
    f_eff = {w for w in full if len(w) < mf}
    for w in words:
        assert got.get(w) == enumerated_split(w, s_eff, f_eff, "ens"), w
    # parts join back to the word
    for w, parts in got.items():
        assert parts.replace(" ", "") == w


def test_two_letter_interfix_rejected():
    with pytest.raises(ValueError):
        compound.check_interfixes(["e", "er"])


def test_lists_past_the_broadcast_limit(spark):
    rng = random.Random(11)
    letters = lambda k: "".join(rng.choice("aens") for _ in range(k))
    small, full = sorted({letters(rng.randint(1, 3)) for _ in range(40)}), sorted({letters(rng.randint(1, 4)) for _ in range(60)})
    # one head in most words: a hot substring
    words = spark.createDataFrame([(w,) for w in sorted({"ans" + letters(rng.randint(2, 8)) for _ in range(300)} | {letters(7) for _ in range(100)})], "w string")
    dicts = _dicts(spark, small, full)
    rows = lambda limit: sorted((r.w, r.parts) for r in compound.compound_splits(words, dicts, max_broadcast_rows=limit).collect())
    assert rows(0) == rows(1000) and len(rows(0)) > 20


def test_edges_only_for_words_that_can_split(spark):
    words = spark.createDataFrame([("sonnentag",), ("xsonnentag",), ("sonnen",), ("tag",)], "w string")
    edges = compound.split_edges(words, _dicts(spark, SMALL, FULL)).collect()
    # "xsonnentag" has an edge inside, but none at its beginning
    assert {r.w for r in edges} == {"sonnentag"}
