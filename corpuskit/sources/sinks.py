"""Corpus and line sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_corpus(df: DataFrame, path: str, partition_by=("lang",), mode: str = "overwrite") -> None:
    """Parquet, partitioned by language so a language is a directory."""
    cols = [c for c in partition_by if c in df.columns]
    df.write.mode(mode).partitionBy(*cols).parquet(path)


def write_lines(df: DataFrame, path: str, col: str = "text", mode: str = "overwrite", compression: str | None = None) -> None:
    """One line per row, no quoting."""
    w = df.select(col).write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.text(path)
