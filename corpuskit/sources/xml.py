"""Encyclopedia dump pages out of (compressed) XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


PAGE_SCHEMA = ("id bigint, ns int, title string, redirect struct<_title: string>, "
               "revision struct<text: struct<_VALUE: string>>")


def read_dump_pages(spark: SparkSession, path, row_tag: str = "page", articles_only: bool = False) -> DataFrame:
    """``(page_id, title, text)`` per page element; the body is the revision text
    (the value of the element, whatever its attributes).  The schema is given,
    so the dump is read once and the columns' types do not depend on it.
    ``articles_only``: without redirects and pages outside the main namespace (0;
    a page that names none counts as in it)."""
    df = spark.read.format("xml").option("rowTag", row_tag).schema(PAGE_SCHEMA).load(path)
    if articles_only:
        df = df.where((F.coalesce("ns", F.lit(0)) == 0) & F.col("redirect").isNull())
    return df.select(F.col("id").alias("page_id"), "title", F.col("revision.text._VALUE").alias("text"))
