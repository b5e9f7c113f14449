"""Deterministic pseudo-random draws from md5, the same in Spark and DuckDB.

A draw is ``int(first 6 hex digits of md5(key)) in [0, 2^24)``, where ``key`` is
the ``:``-joined string of its parts.  DuckDB writes the same value as
``('0x' || substr(md5(key), 1, 6))::int``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import DRAW_HEX_DIGITS, DRAW_RANGE


def hash_key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def draw(*parts) -> Column:
    """Integer draw in [0, 2^24) from md5 of the joined parts."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, DRAW_HEX_DIGITS), 16, 10).cast("bigint")


def threshold(p: float) -> int:
    """Draws below this value happen with probability ``p``."""
    return int(p * DRAW_RANGE)
