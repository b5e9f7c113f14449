"""Dictionary table -> word lists.

A dictionary has rows ``(base, word, type)``; ``type`` may hold several
comma-separated values.  Every operator is a projection, filter, explode or a
distinct (partial + final hash aggregate), so each list is one or two stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.tokens import normalise as nfkc_rows

# --- fixed values: types used by the derived test lexicon, indexed by h % 6 ---
DERIVED_TYPES = ["sb.", "vb.", "adj.,sb.", "adj., sb.", "sb. pl.", "talord"]


def derive_lexicon(documents: DataFrame, lang: str = "de", min_len: int = 2, max_len: int = 6) -> DataFrame:
    """The stand-in spelling dictionary built from the German documents
    (``FIXTURES.md`` section 2): distinct lower-case letter runs, with numbered
    homographs, capitalised bases, inflected words and multi-valued types."""
    w = F.col("w")
    # no letter run holds a blank: the distinct stretches between blanks have them all
    words = (documents.where(F.col("lang") == lang)
                      .select(F.explode(F.split("text", " ")).alias("w")).distinct()
                      .select(F.explode(F.regexp_extract_all(F.lower("w"), F.lit(P.LETTER_RUN), 0)).alias("w"))
                      .where(F.length(w).between(min_len, max_len))
                      .distinct())
    h = F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint")
    first = F.substring(w, 1, 1)
    base = (F.when(h % 7 == 0, F.concat(F.lit("1. "), w))
             .when((h % 5 == 0) & (first != "ß"), F.concat(F.upper(first), F.substring(w, 2, 1 << 30)))
             .otherwise(w))
    word = (F.when(h % 3 == 0, F.concat(w, F.lit("e")))
             .when(h % 11 == 0, F.concat(F.lit("2. "), w, F.lit("s")))
             .otherwise(w))
    typ = F.element_at(F.array(*[F.lit(t) for t in DERIVED_TYPES]), (h % 6 + 1).cast("int"))
    return words.select(base.alias("base"), word.alias("word"), typ.alias("type"))


def explode_types(lex: DataFrame) -> DataFrame:
    """L1: split ``type`` on ',' (no trimming) and explode."""
    return lex.withColumn("type", F.explode(F.split("type", ",", -1)))


def noun_rows(lex: DataFrame, noun_types=P.NOUN_TYPES, banned=P.BANNED_WORDS, ban_base: bool = False) -> DataFrame:
    """L1-L3: rows whose type is a noun type, minus banned words.  The ban looks
    at the raw ``word`` (so ``1. ren;rens`` still yields base ``ren``); with
    ``ban_base`` it also looks at the cleaned base."""
    rows = explode_types(lex).where(F.col("type").isin(*noun_types))
    rows = rows.where(~F.col("word").isin(*banned) | F.col("word").isNull())
    if ban_base:
        rows = rows.where(~clean_word(F.col("base")).isin(*banned))
    return rows


def clean_word(c: Column) -> Column:
    """L4 + L5: strip homograph numbers (``12. ``) anywhere, then lower-case."""
    return F.lower(F.regexp_replace(c, P.HOMOGRAPH_NUMBER, ""))


def word_list(lex: DataFrame, column: str = "word") -> DataFrame:
    """Cleaned, lower-cased distinct words with their length.  Empty
    values are missing and dropped.  L7 (order by length, ties by word) is
    ``ordered_by_length``, applied only where output is written."""
    return (lex.select(clean_word(F.col(column)).alias("word"))
               .where(F.col("word").isNotNull())
               .distinct()
               .withColumn("length", F.length("word").cast("bigint")))


def ordered_by_length(words: DataFrame) -> DataFrame:
    """Range-partitioned sort by (length, word)."""
    return words.orderBy("length", "word")


def dictionary_words(rows: DataFrame, column: str) -> DataFrame:
    """L8 on top of L4-L7: no multi-word entries, no one-character words."""
    return (word_list(rows, column)
            .where(~F.col("word").contains(" ") & (F.col("length") > 1)))


def small_dictionary(lex: DataFrame, **kw) -> DataFrame:
    """The small list (non-final compound parts) from ``base`` of nouns."""
    return dictionary_words(noun_rows(lex, **kw), "base")


def full_dictionary(lex: DataFrame, **kw) -> DataFrame:
    """The full list (final compound parts) from ``word`` of nouns."""
    return dictionary_words(noun_rows(lex, **kw), "word")


def drop_longest(words: DataFrame) -> DataFrame:
    """L9 / trap T1: length buckets run from 1 to max-1, so the words of the
    maximum length are never found.  The max is a scalar subquery."""
    longest = words.select(F.max("length")).scalar()
    return words.where(F.col("length") < longest)


def dictionaries(lex: DataFrame, drop_longest_words: bool = True, normalise: bool = True, **kw) -> DataFrame:
    """Both lists as one table ``(word, length, kind)``, kind ``small``/``full``.

    With ``normalise`` the entries get the same NFKC + lower-case as text does,
    so a non-NFKC entry can still match (trap T17)."""
    out = []
    for kind, df in (("small", small_dictionary(lex, **kw)), ("full", full_dictionary(lex, **kw))):
        if drop_longest_words:
            df = drop_longest(df)
        if normalise:
            df = (nfkc_rows(df.select("word"), "word").select(F.lower("word").alias("word"))
                  .groupBy("word").agg(F.lit(1).alias("_one")).drop("_one")
                  .withColumn("length", F.length("word").cast("bigint")))
        out.append(df.select("word", "length", F.lit(kind).alias("kind")))
    return out[0].unionByName(out[1])


def length_buckets(dicts: DataFrame) -> DataFrame:
    """L9 / A1 / A3 as a table: words per length per list, with the first and
    last word of each bucket (bounded aggregates, no list collected)."""
    return (dicts.groupBy("kind", "length")
                 .agg(F.count(F.lit(1)).alias("n_words"), F.min("word").alias("first_word"),
                      F.max("word").alias("last_word")))
