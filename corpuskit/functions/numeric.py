"""Column arithmetic Spark has no built-in for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def digamma(x: Column) -> Column:
    """Digamma for x > 0: shift x up to at least 7, then the asymptotic series."""
    shifted = F.aggregate(
        F.sequence(F.lit(0), F.lit(6)),
        F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("r")),
        lambda acc, _: F.when(
            acc["x"] < 7,
            F.struct((acc["x"] + 1).alias("x"), (acc["r"] - 1 / acc["x"]).alias("r")),
        ).otherwise(acc),
    )
    y = shifted["x"] - 0.5
    y2 = y * y
    return (shifted["r"] + F.log(y) + 1 / (24 * y2) - 7 / (960 * y2 * y2)
            + 31 / (8064 * y2 * y2 * y2) - 127 / (30720 * y2 * y2 * y2 * y2))


def digamma_array(x: np.ndarray) -> np.ndarray:
    """``digamma`` of an array, by the same steps; NaN stays."""
    x, r = np.array(x, np.float64), np.zeros(np.shape(x))
    for _ in range(7):
        low = x < 7
        r, x = np.where(low, r - 1 / x, r), np.where(low, x + 1, x)
    y = x - 0.5
    y2 = y * y
    return (r + np.log(y) + 1 / (24 * y2) - 7 / (960 * y2 * y2)
            + 31 / (8064 * y2 * y2 * y2) - 127 / (30720 * y2 * y2 * y2 * y2))
