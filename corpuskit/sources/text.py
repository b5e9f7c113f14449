"""Line-delimited text files, one row per line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths, lang: str | None = None, source: str | None = None) -> DataFrame:
    """``text`` per line plus provenance: ``source`` (literal or file path) and
    ``lang``.  Hadoop codecs read .gz/.bz2 transparently."""
    df = spark.read.text(paths).withColumnRenamed("value", "text")
    src = F.lit(source) if source is not None else F.col("_metadata.file_path")
    return df.select(src.alias("source"), F.lit(lang).cast("string").alias("lang"), "text")


def read_language_corpora(spark: SparkSession, sources: dict[str, dict[str, str]]) -> DataFrame:
    """Several text files per language, e.g.
    ``{"da": {"lexdk": path, "wiki": path}, "no": {"nb": path, "nn": path}}``,
    as one table (U1: the union keeps duplicates)."""
    frames = [read_lines(spark, path, lang=lang, source=name)
              for lang, by_name in sources.items() for name, path in by_name.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_keyed_lines(spark: SparkSession, paths, lang: str | None = None) -> DataFrame:
    """``doc_id, source, lang, line_no, text``: lines with keys that do not depend
    on how the files were split.  ``doc_id`` is a hash of the file's path and
    ``line_no`` the line's number in the file (from 0), found from the number
    of lines in each split (one row per split)."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_block"),
                                          F.col("value").alias("text"), F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("source", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("source", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (lines.join(splits, ["source", "_block"])
                 .select(F.xxhash64("source").alias("doc_id"), "source", F.lit(lang).cast("string").alias("lang"),
                         (F.col("_base") + F.col("_at") - F.col("_first")).cast("bigint").alias("line_no"), "text"))
