"""Save and load a tokeniser as Parquet tables; read a tokeniser file.

A tokeniser directory holds one folder per saved version, each with ``vocab``
(id, token, lp, special), ``small_dictionary`` and ``dictionary`` (word,
length) and ``tokeniser_config`` (one row: interfixes), and ``manifest``: one
row per finished save, appended last, so readers see a whole version or the one
before.  Older versions stay; nothing is overwritten.  Saving never changes the
tables (trap T3) and loading never drops a length tier again (trap T1).

``read_tokenizer_file`` reads the JSON file of a ``tokenizers`` Unigram model
into the same ``vocab`` table (a base to encode with or to train on from).
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P


@dataclass
class TokeniserTables:
    vocab: DataFrame
    small_dictionary: DataFrame
    dictionary: DataFrame
    interfixes: list[str]

    def dictionaries(self) -> DataFrame:
        """Both lists as ``(word, length, kind)``, the form the splitter reads."""
        return (self.small_dictionary.select("word", "length", F.lit("small").alias("kind"))
                .unionByName(self.dictionary.select("word", "length", F.lit("full").alias("kind"))))


def save_tokeniser(tables: TokeniserTables, directory: str) -> str:
    """Write a new version and then commit it; returns the version's folder."""
    spark = tables.vocab.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    folder = os.path.join(directory, version)
    tables.vocab.write.parquet(os.path.join(folder, "vocab"))
    tables.small_dictionary.select("word", "length").write.parquet(os.path.join(folder, "small_dictionary"))
    tables.dictionary.select("word", "length").write.parquet(os.path.join(folder, "dictionary"))
    (spark.createDataFrame([(list(tables.interfixes),)], "interfixes array<string>")
          .write.parquet(os.path.join(folder, "tokeniser_config")))
    _commit(spark, directory, version)
    return folder


def _commit(spark: SparkSession, directory: str, version: str) -> None:
    (spark.createDataFrame([(version,)], "version string").select(F.current_timestamp().alias("saved_at"), "version")
          .coalesce(1).write.mode("append").parquet(os.path.join(directory, "manifest")))


def load_tokeniser(spark: SparkSession, directory: str) -> TokeniserTables:
    """The version committed last.  Raises (``AnalysisException``: path not
    found) if nothing was committed."""
    manifest = spark.read.schema("saved_at timestamp, version string").parquet(os.path.join(directory, "manifest"))
    last = manifest.agg(F.max_by("version", F.struct("saved_at", "version"))).first()[0]
    folder = os.path.join(directory, last)
    cfg = spark.read.parquet(os.path.join(folder, "tokeniser_config")).first()
    interfixes = list(cfg["interfixes"]) if cfg is not None else list(P.DEFAULT_INTERFIXES)
    return TokeniserTables(
        vocab=spark.read.parquet(os.path.join(folder, "vocab")),
        small_dictionary=spark.read.parquet(os.path.join(folder, "small_dictionary")),
        dictionary=spark.read.parquet(os.path.join(folder, "dictionary")),
        interfixes=interfixes,
    )


TOKENIZER_FILE = ("model struct<type: string, unk_id: int, vocab: array<array<string>>>, "
                  "added_tokens array<struct<id: int, content: string, special: boolean>>")


def read_tokenizer_file(spark: SparkSession, path: str) -> DataFrame:
    """``(id, token, lp, special)`` of a Unigram tokenizer file.  Its ids
    and scores are kept; added special tokens and the unknown entry are
    ``special``.  Another model type raises when the table is read."""
    doc = (spark.read.text(path, wholetext=True)
                .select(F.from_json("value", TOKENIZER_FILE, {"mode": "FAILFAST"}).alias("j")).select("j.*"))
    unigram = F.coalesce(F.col("model.type"), F.lit("")) == "Unigram"
    entries = F.when(unigram, F.col("model.vocab")).otherwise(
        F.raise_error(F.concat(F.lit("not a Unigram tokenizer: "), F.coalesce("model.type", F.lit("no type")))))
    added = F.filter(F.coalesce("added_tokens", F.array()), lambda t: t["special"])
    marked = doc.select(F.col("model.unk_id").alias("unk"), F.transform(added, lambda t: t["content"]).alias("names"),
                        F.posexplode(entries).alias("id", "entry"))
    body = marked.select("id", F.element_at("entry", 1).alias("token"), F.element_at("entry", 2).cast("double").alias("lp"),
                         (F.array_contains("names", F.element_at("entry", 1))
                          | F.coalesce(F.col("id") == F.col("unk"), F.lit(False))).alias("special"))
    # special tokens that the model's own list lacks have ids after it
    beyond = doc.select(F.size("model.vocab").alias("n"), F.inline(added)).where(F.col("id") >= F.col("n"))
    return body.unionByName(beyond.select("id", F.col("content").alias("token"), F.lit(0.0).alias("lp"), "special"))
