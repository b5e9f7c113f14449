"""Encoding sentences to ids.

Every per-word computation (compound split, Viterbi) runs once per distinct
word; sentences stay whole and take the results by ``lookup_arrays``: a block of
sentences meets the word table with its distinct words, never with its occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.joins import lookup_arrays, lookup_join
from ..functions.ranking import global_rank
from ..session import forget, stored
from . import tokens as T
from .unigram import encode_words


def word_vocab(words: DataFrame) -> DataFrame:
    """A word-level vocabulary: specials 0-4, then every pre-token by
    ``(f desc, w)`` (used as a checkable stand-in for the subword model)."""
    spark = words.sparkSession
    ranked = global_rank(words.select("w", "f"), [F.col("f").desc(), F.col("w")], "_r")
    body = ranked.select((F.col("_r") + len(P.SPECIAL_TOKENS) - 1).cast("int").alias("id"), F.col("w").alias("token"),
                         F.lit(None).cast("double").alias("lp"), F.lit(False).alias("special"))
    specials = spark.createDataFrame([(i, t, None, True) for i, t in enumerate(P.SPECIAL_TOKENS)],
                                     "id int, token string, lp double, special boolean")
    return specials.unionByName(body)


def word_ids_from_vocab(vocab: DataFrame) -> DataFrame:
    """``(w, ids)`` for a word-level vocabulary."""
    return vocab.where(~F.col("special")).select(F.col("token").alias("w"), F.array("id").alias("ids"))


def word_ids_unigram(words: DataFrame, vocab: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """``(w, ids)``: each distinct (normalised) pre-token -> compound parts ->
    Viterbi ids of every part, concatenated."""
    base = words.select("w")
    parts = F.array("w")
    if splits is not None:
        base = base.join(splits.select("w", "parts"), "w", "left")
        parts = F.coalesce("parts", parts)
    sub = base.select("w", F.posexplode(parts).alias("j", "t"))
    enc = encode_words(sub.select(F.col("t").alias("w")).distinct(), vocab)
    return (sub.join(enc.select(F.col("w").alias("t"), "ids"), "t")
               .groupBy("w").agg(F.array_sort(F.collect_list(F.struct("j", "ids"))).alias("x"))
               .select("w", F.flatten(F.transform("x", lambda e: e["ids"])).alias("ids")))


def token_rows(sents: DataFrame, col: str = "sent", keep=()) -> DataFrame:
    """K2, stored: ``(keep..., _row, toks, plain)`` per sentence.  ``toks``: its pre-tokens
    with special tokens recognised, parted by blanks (none holds one); ``plain``: without, where that
    is another list.  ``_row`` is a row's own number, fixed as it is stored: null and repeated keys stay apart."""
    keep = list(keep)
    marked = F.coalesce(F.col(col).rlike(P.SPECIAL_TOKEN), F.lit(False))
    sents = sents.select(*keep, F.col(col).alias("_s"), F.when(marked, F.col(col)).alias("_p"))
    toks = T.normalise(T.normalise(sents, "_s", True), "_p")
    joined = lambda c, specials: F.array_join(T.token_array(F.col(c), specials), " ")
    return stored(toks.select(*keep, F.coalesce(joined("_s", True), F.lit("")).alias("toks"), joined("_p", False).alias("plain"))
                      .withColumn("_row", F.monotonically_increasing_id()))


def row_words(rows: DataFrame) -> DataFrame:
    """K3 of ``token_rows``: pre-token frequencies ``(w, f)``."""
    return T.word_freq(rows.select(F.explode(F.split(F.coalesce("plain", "toks"), " ")).alias("token")).where("token != ''"))


def encode_rows(rows: DataFrame, word_ids: DataFrame, keep=()) -> DataFrame:
    """E2 (+E3, K5) of ``token_rows``: ``(keep..., ids)``.  Words meet the table once per block of rows."""
    spark = rows.sparkSession
    specials = spark.createDataFrame([(t, [i]) for i, t in enumerate(P.SPECIAL_TOKENS)], "w string, ids array<int>")
    table = word_ids.select("w", F.col("ids").cast("array<int>").alias("ids")).where(~F.col("w").isin(*P.SPECIAL_TOKENS))
    out = lookup_arrays(rows.select(*keep, "_row", "toks"), "toks", table.unionByName(specials), "w", "ids", missing=[P.UNK_ID])
    return out.withColumnRenamed("toks", "ids")


def encode_sentences(sents: DataFrame, word_ids: DataFrame, keys, col: str = "sent",
                     freq: DataFrame | None = None, carry=()) -> DataFrame:
    """E2 (+E3, K5): ``(keys..., carry..., ids)`` per sentence, special tokens in
    the raw text mapped to their ids.  A sentence without a pre-token has no
    ids and keeps its row.  ``carry``: further columns.  ``freq`` is no longer needed: a word
    that is in every sentence is one row per block of them."""
    return encode_rows(token_rows(sents, col, [*keys, *carry]), word_ids, [*keys, *carry])


def add_specials(ids: Column, max_length: int = P.DEFAULT_MAX_LENGTH) -> Column:
    """E5 + E4: truncate so that ``<s> ... </s>`` fits in ``max_length``."""
    return F.concat(F.array(F.lit(P.BOS_ID)), F.slice(ids, 1, max_length - 2), F.array(F.lit(P.EOS_ID)))


def pad_to(ids: Column, length: Column | int) -> Column:
    """Right-pad with ``<pad>`` (id 0) to ``length``."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(P.PAD_ID), F.greatest(length - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, length: Column | int) -> Column:
    """1 for real tokens, 0 for padding."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.greatest(length - F.size(ids), F.lit(0))))


MAP_BATCH = 1000  # fixed value: rows per batch of the library's batched map


def pad_batches(df: DataFrame, ids: str = "input_ids", index_col: str = "row_idx", batch_size: int = MAP_BATCH) -> DataFrame:
    """E6 + E8: pad to the longest sequence of each batch of ``batch_size``
    consecutive rows.  A batch has a bounded number of rows, so the window per
    batch never grows with the data."""
    w = Window.partitionBy("_batch")
    return (df.withColumn("_batch", F.floor(F.col(index_col) / batch_size))
              .withColumn("_len", F.max(F.size(ids)).over(w))
              .withColumn("attention_mask", attention_mask(F.col(ids), F.col("_len")))
              .withColumn(ids, pad_to(F.col(ids), F.col("_len")))
              .drop("_batch", "_len"))


def decode(df: DataFrame, vocab: DataFrame, keys, ids: str = "ids") -> DataFrame:
    """Ids -> token strings, in order (``tokens`` array).  Rows of one key are read
    position by position: they come together as ids, the strings are never shuffled."""
    keys = list(keys)
    numbered = lambda x: stored(x.withColumn("_row", F.monotonically_increasing_id()))
    rows = numbered(df.select(*keys, F.col(ids).alias("ids")).where(F.size("ids") > 0))
    table = vocab.select("id", "token")
    if rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        return lookup_arrays(rows, "ids", table, "id", "token").withColumnRenamed("ids", "tokens")
    single, rows = rows, numbered(rows.groupBy(*keys).agg(F.collect_list("ids").alias("x")).select(
        *keys, F.flatten("x").alias("ids"), F.when(F.size("x") > 1, F.transform("x", F.size)).alias("_sizes")))
    forget(single)
    tokens = lookup_arrays(rows, "ids", table, "id", "token")
    place = F.flatten(F.transform("_sizes", lambda n: F.sequence(F.lit(0), n - 1)))
    placed = F.zip_with(place, "ids", lambda i, v: F.struct(i.alias("pos"), v.alias("token")))
    merged = F.transform(F.array_sort(placed), lambda v: v["token"])
    return tokens.select(*keys, F.when(F.col("_sizes").isNull(), F.col("ids")).otherwise(merged).alias("tokens"))


def vocab_lookup(vocab: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token -> id (``<unk>`` id when missing) for a table of tokens."""
    t = lookup_join(tokens.select("token").distinct(), vocab.select("token", "id"), "token", "left")
    return t.select("token", F.coalesce("id", F.lit(P.UNK_ID)).alias("id"))
