"""Evaluation metrics (Q1-Q5).

Predictions are rows ``(seq_id, pos, label, logits array<float>)``; labels -100
are ignored.  Per-row loss and argmax are array functions; batch means and
the corpus totals are partial + final aggregates, so nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.ranking import global_rank


def log_sum_exp(x: Column) -> Column:
    m = F.array_max(x).cast("double")
    return m + F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - m)))


def argmax(x: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def row_metrics(preds: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Q1 per row: cross-entropy ``loss`` and ``correct``, for labels >= 0."""
    x = F.col(logits)
    return (preds.where(F.col(label) >= 0)
                 .withColumn("loss", log_sum_exp(x) - F.element_at(x, F.col(label) + 1).cast("double"))
                 .withColumn("correct", (argmax(x) == F.col(label)).cast("int")))


def mlm_metrics(preds: DataFrame, batch_size: int = P.EVAL_BATCH_SIZE, seq_id: str = "seq_id",
                logits: str = "logits", label: str = "label") -> DataFrame:
    """Q1-Q3 over rows ``(seq_id, pos, label, logits)``; one row with

    * ``perplexity``: exp(sum of batch mean losses / floor(sequences / batch)),
      the reference's form: a batch is ``batch_size`` consecutive *sequences*
      and its mean runs over all scored positions in them (a last short batch
      adds to the sum, not to the count; NULL below one full batch);
    * ``perplexity_exact``: exp(mean loss over all scored positions);
    * ``accuracy``: share of scored positions whose argmax is the label.

    Batches follow the dense rank of ``seq_id``, whatever its values are; a
    sequence without scored positions still takes its place."""
    per_seq = (row_metrics(preds, logits, label).groupBy(seq_id)
               .agg(F.sum("loss").alias("sl"), F.count(F.lit(1)).alias("nl"), F.sum("correct").alias("nc")))
    seqs = global_rank(preds.select(seq_id).distinct(), [seq_id], "_r")
    n_seqs = seqs.select(F.count(F.lit(1))).scalar()
    rows = seqs.join(per_seq, seq_id, "left").withColumn("batch", F.floor((F.col("_r") - 1) / batch_size))
    per_batch = rows.groupBy("batch").agg(F.sum("sl").alias("sl"), F.sum("nl").alias("nl"), F.sum("nc").alias("nc"))
    per_batch = per_batch.withColumn("bl", F.col("sl") / F.col("nl"))
    full = F.floor(n_seqs / batch_size)
    return per_batch.agg(
        F.sum("bl").alias("loss_sum"), (F.sum("sl") / F.sum("nl")).alias("mean_loss"),
        (F.sum("nc") / F.sum("nl")).alias("accuracy"), F.sum("nl").alias("n_scored"),
    ).select(F.lit(n_seqs).cast("bigint").alias("n_seqs"), F.col("n_scored").cast("bigint").alias("n_scored"),
             F.when(full > 0, F.exp(F.col("loss_sum") / full)).alias("perplexity"),
             F.exp("mean_loss").alias("perplexity_exact"), F.col("accuracy").cast("double").alias("accuracy"))


def corpus_perplexity(token_scores: DataFrame, group_cols=("lang",), weight: str | None = None) -> DataFrame:
    """Q5: per group, exp(-(sum of word log-probabilities) / pieces).  ``weight``: how many
    occurrences a row stands for (one without)."""
    f = F.lit(1) if weight is None else F.col(weight)
    return (token_scores.groupBy(*group_cols)
                        .agg(F.sum(F.col("score") * f).alias("logp"), F.sum(F.col("n_pieces") * f).alias("n_pieces"),
                             F.sum(f).cast("bigint").alias("n_words"))
                        .withColumn("perplexity", F.exp(-F.col("logp") / F.col("n_pieces"))))
