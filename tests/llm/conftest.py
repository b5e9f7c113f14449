"""Small fixtures shared by the tests of the training-data operators."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def table(spark):
    """Documents with columns that clash with the operators' own names."""
    def make(rows):
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        for name in ("shard", "slot", "row", "cls", "n", "tokens", "digest", "start", "score", "label", "kept"):
            df = df.withColumn(name, F.lit("clash"))
        return df
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, copies and repeated rows."""
    base = " ".join(f"word{i % 97} Stop{i % 13}." for i in range(60))
    return [(1, None), (2, ""), (3, " \t\n"), (4, base), (5, base), (6, base.replace(" ", "\n")), (6, base.replace(" ", "\n")),
            (7, base + " tail"), (8, "one two"), (9, "ONE two"), (None, "no id at all here or there"), (None, "no id at all here or there"),
            (10, "x" * 50_000), (11, " ".join(f"t{i}" for i in range(20_000))), (12, "ünï cödé ß 中文 <|endoftext|> end")]
