"""The M-step on dense counts, and how many jobs and tables a training makes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.functions.numeric import digamma_array
from corpuskit.operators import unigram
from corpuskit.session import ensure_checkpoint_dir


def _tables(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(root) if x.startswith("table-")}


def test_dense_m_step_equals_the_table(spark):
    c = np.array([0.2, np.nan, 0.5, 3.25, 7.0, 1e6])
    counts = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(c) if not np.isnan(v)], "piece string, c double")
    want = {r.piece: r.lp for r in unigram.m_step(counts).collect()}
    got = unigram.m_step(c)
    assert {str(i): v for i, v in enumerate(got) if not np.isnan(v)} == pytest.approx(want, rel=1e-14)
    assert digamma_array(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-9)
    assert np.isnan(unigram.m_step(np.array([0.1, np.nan]))).all()


def test_a_round_of_training_is_few_jobs(spark):
    """a round of two EM steps and a pruning made dozens of jobs, whatever the size."""
    letters = "abcdefgh"
    words = spark.createDataFrame([("".join(letters[(i * j + j) % 8] for j in range(1, 3 + i % 9)), 2 + i % 5) for i in range(300)],
                                  "w string, f bigint").groupBy("w").agg(F.sum("f").alias("f"))
    sc, before, rounds = spark.sparkContext, _tables(spark), []
    jobs = lambda: len(sc.statusTracker().getJobIdsForGroup("training"))
    sc.setJobGroup("training", "training")
    try:
        vocab = unigram.train(words, vocab_size=40, log=lambda _: rounds.append(jobs()))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(rounds) >= 3 and max(np.diff(rounds)) <= 16, rounds
    assert vocab.count() == 40
    # its lattices, seeds and words are gone, only what ranks the vocabulary may stay
    assert len(_tables(spark) - before) <= 3
