"""Normalisation and pre-tokenisation (K1-K5).

A text is normalised first (NFKC, then lower case) and cut into pre-tokens
after that: runs of word characters or runs of other non-space characters,
found by one JVM regex (``regexp_extract_all``).  NFKC has no Spark built-in,
so it runs as an Arrow UDF, which hands plain ASCII text back as it is.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import patterns as P

_SPECIAL = re.compile("(" + P.SPECIAL_TOKEN + ")")
# P.TOKEN with the commonest word characters named once more: the JVM finds
# these in a bit table before it asks for a character's category.
_WORD = "a-z0-9_" + P.WORD_CLASS
_TOKEN = f"[{_WORD}]+|[^{_WORD}{P.SPACE_CLASS}]+"


def token_array(text: Column, with_specials: bool = False) -> Column:
    """K1 (lower-casing) + K2: the pre-tokens of a text as an array.
    With ``with_specials`` the five special tokens are recognised first, in the
    raw text (they are not normalised)."""
    if with_specials:
        # specials keep their case; everything else is lower-cased
        return F.transform(F.regexp_extract_all(text, F.lit(P.TOKEN_WITH_SPECIALS), 0),
                           lambda t: F.when(t.isin(*P.SPECIAL_TOKENS), t).otherwise(F.lower(t)))
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), 0)


def pretokenise(df: DataFrame, col: str = "text", keep=None, with_specials: bool = False,
                keep_empty: bool = False) -> DataFrame:
    """K1 + K2: one row per pre-token occurrence of the normalised text with its
    position ``tok_no``.  With ``keep_empty`` a text without pre-tokens gives one
    row with a null token."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != col]
    df = normalise(df.select(*keep, col), col, with_specials)
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return df.select(*keep, explode(token_array(F.col(col), with_specials)).alias("tok_no", "token"))


def nfkc(text: str, with_specials: bool = False) -> str:
    """NFKC of a text.  With ``with_specials`` the special tokens that stand in
    the raw text are left alone, and none that only NFKC makes can be read as
    one (a blank parts its name from the marks, as the pre-tokeniser would)."""
    if not with_specials:
        return unicodedata.normalize("NFKC", text)
    return "".join(x if i % 2 else _SPECIAL.sub(lambda m: re.sub(r"(\w+)", r" \1", m[0]), unicodedata.normalize("NFKC", x))
                   for i, x in enumerate(_SPECIAL.split(text)))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x.isascii() else nfkc(x), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc_with_specials(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x.isascii() else nfkc(x, True), na_action="ignore")


def normalise(df: DataFrame, col: str = "text", with_specials: bool = False) -> DataFrame:
    """K1, first half: the column after NFKC (lower-casing is the tokeniser's).
    One pass over the rows: a branch of its own for those that NFKC may change
    would read and split everything twice."""
    return df.withColumn(col, (_nfkc_with_specials if with_specials else _nfkc)(F.col(col)))


def word_freq(tokens: DataFrame, col: str = "token") -> DataFrame:
    """K3: pre-token frequencies ``(w, f)``; partial counts are combined
    map-side, so a hot word costs one row per task before the shuffle."""
    return tokens.groupBy(F.col(col).alias("w")).agg(F.count(F.lit(1)).alias("f"))


def count_words(df: DataFrame, col: str = "text", by=()) -> DataFrame:
    """K1-K3 in one: ``(by..., w, f)``, the frequencies of a text column's pre-tokens.

    Nothing in K1 and K2 looks across a blank: NFKC joins no character with one,
    lower-casing takes it for a word's end, and no pre-token holds one.  So the
    stretches between blanks are counted first, and only the distinct ones are
    normalised and cut."""
    by = list(by)
    stretches = (df.select(*by, F.explode(F.split(col, " ")).alias("w")).where("w != ''")
                   .groupBy(*by, "w").agg(F.count(F.lit(1)).alias("f")))
    cut = normalise(stretches, "w").select(*by, "f", F.explode(token_array(F.col("w"))).alias("w"))
    return cut.groupBy(*by, "w").agg(F.sum("f").alias("f"))


def special_tokens(df: DataFrame, col: str = "text", keep=None, single_word: bool = False) -> DataFrame:
    """K5: special-token occurrences in raw text with their ids.  With
    ``single_word`` one that touches a word character on either side (a letter,
    mark, digit or joiner) is not counted."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != col]
    word = f"[{P.WORD_CLASS}]"
    pattern = f"(?<!{word})(?:{P.SPECIAL_TOKEN})(?!{word})" if single_word else P.SPECIAL_TOKEN
    found = df.select(*keep, F.posexplode(F.regexp_extract_all(F.col(col), F.lit(pattern), 0)).alias("tok_no", "token"))
    ids = F.array_position(F.array(*[F.lit(t) for t in P.SPECIAL_TOKENS]), F.col("token")) - 1
    return found.withColumn("token_id", ids.cast("int"))
