"""JSON lines sources; only the named field is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl_field(spark: SparkSession, paths, field: str = "text", mode: str = "FAILFAST") -> DataFrame:
    """One row per record with column ``field`` (other fields are never parsed
    into the schema).  ``FAILFAST`` raises on a malformed line, as
    ``json.loads`` does."""
    return spark.read.schema(f"`{field}` string").option("mode", mode).json(paths)


def json_field(c: Column, field: str) -> Column:
    """The field of a JSON object held in a string column."""
    return F.get_json_object(c, f"$.{field}")
