"""Masked-language-model data (M1-M3).

One md5 draw per (seed, epoch, sequence key, position) decides everything, so
masking is reproducible, independent of partitioning and equal in DuckDB:
a non-special position is selected with probability 0.15; of those 80 % become
``<mask>``, 10 % a random id (a second draw), 10 % stay.  ``labels`` hold the
original id at selected positions and -100 elsewhere.  ``epoch`` in the draw
gives dynamic masking (a new mask per epoch); epoch 0 is the static mask.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.hashing import draw, hash_key, threshold
from ..functions.patterns import DRAW_HEX_DIGITS

SELECT_T = threshold(P.MLM_PROBABILITY)
MASK_T = threshold(P.MLM_PROBABILITY * P.MLM_MASK_SHARE)
RANDOM_T = threshold(P.MLM_PROBABILITY * (P.MLM_MASK_SHARE + P.MLM_RANDOM_SHARE))


def mask(df: DataFrame, keys, vocab_size: int, ids: str = "input_ids", epoch: int | str = 0,
         seed: int = P.SPLIT_SEED) -> DataFrame:
    """M1/M2: replaces ``ids`` by the masked ids and adds ``labels``.  ``epoch`` is
    a number or the name of a column that holds it."""
    epoch = F.col(epoch) if isinstance(epoch, str) else epoch
    keys = [F.col(k) for k in keys]
    specials = F.array(*[F.lit(i) for i in range(len(P.SPECIAL_TOKENS))])

    # one md5 a position; six hex digits compare as the numbers do
    drawn = F.transform(ids, lambda x, i: F.substring(F.md5(hash_key(seed, epoch, *keys, i)), 1, DRAW_HEX_DIGITS))
    below = lambda d, t: d < F.lit(f"{t:0{DRAW_HEX_DIGITS}x}")

    def pick(d, i):
        x = F.get(ids, i)
        sel = below(d, SELECT_T) & ~F.array_contains(specials, x)
        rnd = (draw("r", seed, epoch, *keys, i) % vocab_size).cast("int")
        new = (F.when(~sel, x).when(below(d, MASK_T), F.lit(P.MASK_ID)).when(below(d, RANDOM_T), rnd).otherwise(x))
        return F.struct(new.alias("id"), F.when(sel, x).otherwise(F.lit(P.IGNORE_INDEX)).alias("label"))
    return (df.withColumn("_m", F.transform(drawn, pick))
              .withColumn(ids, F.transform("_m", lambda m: m["id"]))
              .withColumn("labels", F.transform("_m", lambda m: m["label"]))
              .drop("_m"))
