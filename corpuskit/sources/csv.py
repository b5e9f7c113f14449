"""S3: semicolon-separated dictionary file without header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DICTIONARY_SCHEMA = "base string, word string, type string"


def read_dictionary(spark: SparkSession, path, schema: str = DICTIONARY_SCHEMA) -> DataFrame:
    """Rows ``(base, word, type)``; fields may be quoted with ``"`` and quotes
    doubled inside; a row with a wrong number of fields raises.  Only an empty field is missing (trap T4: the words
    ``null``, ``nan`` and ``NA`` stay words)."""
    return (spark.read.option("sep", ";").option("header", "false").option("quote", '"')
            .option("escape", '"').option("mode", "FAILFAST").schema(schema).csv(path))
