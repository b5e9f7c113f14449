"""Sentence cleaning on a stream of text files.

The cleaning steps (P2-P6) and pre-tokenisation (K2) are stateless, so the
same DataFrame functions run unchanged on a ``readStream`` source; each
micro-batch is appended to Parquet with its progress in the checkpoint
folder (exactly-once file sink, restartable after executor or driver loss).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean


def stream_sentences(spark: SparkSession, input_dir: str, lang: str | None = None,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of kept sentences from new text files in ``input_dir``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(input_dir).select(F.col("_metadata.file_path").alias("source"),
                                          F.lit(lang).cast("string").alias("lang"),
                                          F.col("value").alias("text"))
    return clean.keep_sentences(clean.split_sentences(clean.clean_lines(lines)))


def start_sentence_sink(stream: DataFrame, output_dir: str, checkpoint_dir: str, once: bool = False):
    """Append the stream to Parquet; ``once`` processes what is there and stops."""
    w = (stream.writeStream.format("parquet").option("path", output_dir)
         .option("checkpointLocation", os.path.join(checkpoint_dir, "sentences")).outputMode("append"))
    w = w.trigger(availableNow=True) if once else w
    return w.start()
