"""The pipeline's stages on one small corpus, each against its operator's rule."""

import public_tokenizers
import pytest

import corpus_pipeline
from conftest_llm import shingles, shingles_lower

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from corpuskit.llm.common import stored
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join",
                                                      "benchmark decontamination", "best-fit packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_keeps_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = ids(stages[1])
    good = [i for i, q in labels.items() if q == 1]
    assert kept < ids(stages[0]) and sum(i in kept for i in good) > 0.97 * len(good)


def test_one_of_each_equal_group(stages):
    norm = lambda t: "".join((t or "").split(" ")).translate({i: None for i in range(9, 14)})
    assert sorted(norm(r.text) for r in stages[2].collect()) == sorted({norm(r.text) for r in stages[1].collect()})


def test_no_similar_pair_is_left(stages):
    sets = [shingles(r.text) for r in stages[3].collect()]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert not a or 100 * len(a & b) < 75 * len(a | b)


def test_no_benchmark_item_is_left(spark, stages):
    items = [shingles_lower(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = lambda t: any(100 * len(i & s) >= 75 * len(i) for i in items if i for s in [shingles_lower(t)])
    assert ids(stages[4]) == {r.doc_id for r in stages[3].collect() if not hit(r.text)}


def test_packing_holds_the_rest(stages):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect()}
    got = {}
    for r in stages[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_run_equals_the_stages(spark, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[5])
