"""Registered queries against their DuckDB oracle on the smallest data."""

import pytest

from corpuskit.plans.oracle import ORACLE as LIBRARY

from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = sorted(LIBRARY)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, SF, con)
    assert res["ok"], res


def test_every_query_registered_and_runs_schema(spark):
    import __spark_entry__ as entry
    qs = entry.queries()
    assert set(entry.oracle_sql()) <= set(qs)
    df = entry.entry(spark)
    assert df.columns == ["lang", "n_sentences", "n_tokens", "n_types"]


def test_kernels_run_from_another_folder(tmp_path):
    """Workers must find the package wherever the driver was started."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from corpuskit.session import get_spark
spark = get_spark("local[2]", shuffle_partitions=2)
sys.path.remove({root!r})
from corpuskit.operators import unigram
pieces = spark.createDataFrame([("a", -1.0), ("b", -2.0)], "piece string, lp double")
words = spark.createDataFrame([("abba", 1)], "w string, f bigint")
print("PIECES", len(unigram.viterbi_words(words, pieces).first().best.path))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "PIECES 4" in got.stdout, got.stderr[-2000:]
