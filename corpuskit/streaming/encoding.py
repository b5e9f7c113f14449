"""Encoding a stream of sentences to ids.

Every micro-batch joins its distinct words to a stored table of word results,
encodes those that no earlier batch has met (compound split, then the best
segmentation), adds them to the table, and maps its sentences by the table's
rows for its own words.  Each distinct word is so encoded once in the life of
the stream, and the work of a batch grows with the batch; of the table it reads
the words' column and the rows that it needs.

A batch writes its words and its sentences to folders of its own number and
reads only words of smaller numbers: one that is run again after a crash
finds the table as it was the first time and replaces what it had written.
The table belongs to one vocabulary and one pair of word lists: their digest
is part of its path, so others start a table of their own.

Null sentences give a row with ``<s> </s>``, as do those without a pre-token.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import compound, encode, tokens
from ..session import cut_lineage

WORD_TABLE = "w string, ids array<int>"


def _digest(df: DataFrame) -> int:
    """Of the rows, whatever their order (null for none)."""
    return df.select(F.bit_xor(F.xxhash64(*sorted(df.columns)))).first()[0] or 0


class Encoder:
    """Encodes micro-batches of ``(keys..., col)`` against a growing word table.

    ``vocab``: a vocabulary table (V6).  ``dicts``: both word lists, for compound
    words (``None``: words are not split)."""

    def __init__(self, spark: SparkSession, vocab: DataFrame, keys, table_dir: str, output_dir: str,
                 dicts: DataFrame | None = None, col: str = "sent", max_length: int = P.DEFAULT_MAX_LENGTH):
        self.spark, self.vocab, self.dicts = spark, cut_lineage(vocab), dicts
        self.keys, self.col, self.max_length, self.output_dir = list(keys), col, max_length, output_dir
        name = f"{_digest(self.vocab):x}.{_digest(dicts) if dicts is not None else 0:x}"
        self.table_dir = os.path.join(table_dir, name)
        # an empty first batch, so that the table can always be read
        spark.createDataFrame([], WORD_TABLE).write.mode("overwrite").parquet(self._folder(self.table_dir, -1))

    @staticmethod
    def _folder(base: str, number: int) -> str:
        return os.path.join(base, f"batch={number}")

    def table(self, before: int | None = None) -> DataFrame:
        """``(w, ids, batch)`` of all batches, or of those ``before`` a number."""
        got = self.spark.read.schema(WORD_TABLE + ", batch long").parquet(self.table_dir)
        return got if before is None else got.where(F.col("batch") < before)

    def encoded(self) -> DataFrame:
        """``(keys..., input_ids, batch)`` of all batches."""
        return self.spark.read.parquet(self.output_dir)

    def __call__(self, batch: DataFrame, number: int) -> None:
        """One micro-batch (for ``foreachBatch``)."""
        sents = cut_lineage(batch.select(*self.keys, self.col))
        words = cut_lineage(tokens.word_freq(tokens.pretokenise(sents, self.col, keep=[])))
        known = self.table(number).select("w", "ids").join(words.select("w"), "w", "left_semi")
        new = cut_lineage(words.join(known.select("w"), "w", "left_anti").select("w"))
        splits = None if self.dicts is None else compound.compound_splits(new, self.dicts)
        ids = encode.word_ids_unigram(new, self.vocab, splits)
        ids.write.mode("overwrite").parquet(self._folder(self.table_dir, number))
        # the written rows, not a second computation of them
        now = self.spark.read.schema(WORD_TABLE).parquet(self._folder(self.table_dir, number))
        out = encode.encode_sentences(sents, known.unionByName(now), self.keys, self.col, freq=words)
        (out.select(*self.keys, encode.add_specials(F.col("ids"), self.max_length).alias("input_ids"))
            .write.mode("overwrite").parquet(self._folder(self.output_dir, number)))


def start_encoding(stream: DataFrame, encoder: Encoder, checkpoint_dir: str, once: bool = False):
    """Run the encoder on a stream of sentences; ``once`` works off what is there and stops."""
    w = stream.writeStream.foreachBatch(encoder).option("checkpointLocation", os.path.join(checkpoint_dir, "encoding"))
    w = w.trigger(availableNow=True) if once else w
    return w.start()
