"""End-to-end jobs: the reference's three entry points as Spark plans.

* ``build_corpus``   raw text -> cleaned sentences -> Parquet corpus (3.1)
* ``build_tokeniser`` corpus + dictionary -> word lists, compound splits,
                      Unigram vocabulary -> tokeniser tables (3.2)
* ``build_mlm_data``  corpus + tokeniser -> split, encoded, masked rows (3.3)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import clean, compound, encode, lexicon, mlm, sampling, tokens, unigram
from ..session import cut_lineage
from ..sources.artefacts import TokeniserTables

SENT_KEY = ["doc_id", "line_no", "sent_no"]


def build_corpus(documents: DataFrame) -> DataFrame:
    """Documents ``(doc_id, lang, text)``, or lines ``(doc_id, lang, line_no,
    text)`` of keyed files -> one row per kept sentence."""
    if "line_no" in documents.columns:
        s = clean.keep_sentences(clean.split_sentences(clean.clean_lines(documents)))
    else:
        s = clean.sentences(documents)
    return s.select("doc_id", "lang", F.col("line_no").cast("bigint").alias("line_no"),
                    F.col("sent_no").cast("bigint").alias("sent_no"), F.col("sent").alias("text"))


def build_tokeniser(corpus: DataFrame, dictionary: DataFrame, vocab_size: int = P.VOCAB_SIZE,
                    interfixes=P.DEFAULT_INTERFIXES, log=None) -> TokeniserTables:
    """The dictionary is ``(base, word, type)`` rows (S3)."""
    dicts = cut_lineage(lexicon.dictionaries(dictionary))
    words = cut_lineage(tokens.word_freq(tokens.pretokenise(corpus, "text", keep=["doc_id"])))
    splits = compound.compound_splits(words.select("w"), dicts, interfixes)
    parts = (words.join(splits.select("w", "parts"), "w", "left")
                  .select(F.explode(F.coalesce("parts", F.array("w"))).alias("w"), "f")
                  .groupBy("w").agg(F.sum("f").cast("bigint").alias("f")))
    vocab = unigram.train(parts, vocab_size=vocab_size, log=log)
    return TokeniserTables(vocab=vocab,
                           small_dictionary=dicts.where(F.col("kind") == "small").select("word", "length"),
                           dictionary=dicts.where(F.col("kind") == "full").select("word", "length"),
                           interfixes=list(interfixes))


def build_mlm_data(corpus: DataFrame, tok: TokeniserTables, max_length: int = 128, epoch: int = 0) -> DataFrame:
    """Split 99/1, encode, wrap, truncate, pad per batch, mask (train rows)."""
    sents = sampling.train_test_split(corpus.select(*SENT_KEY, "text"), SENT_KEY)
    words = cut_lineage(tokens.word_freq(tokens.pretokenise(sents, "text", keep=[])))
    splits = compound.compound_splits(words.select("w"), tok.dictionaries(), tok.interfixes)
    wid = cut_lineage(encode.word_ids_unigram(words, tok.vocab, splits))
    rows = encode.encode_sentences(sents.where(F.col("split") == "train"), wid, SENT_KEY, "text", freq=words,
                                   carry=["split", "row_idx"])
    train = encode.pad_batches(rows.withColumn("input_ids", encode.add_specials(F.col("ids"), max_length)).drop("ids"))
    return mlm.mask(train, SENT_KEY, tok.vocab.count(), epoch=epoch)
