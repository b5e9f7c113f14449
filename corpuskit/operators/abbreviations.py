"""P5: sentence boundaries after abbreviations, learnt from the corpus itself.

A word that nearly always carries a full stop, wherever it stands, is an
abbreviation (Kiss & Strunk 2006, "Unsupervised Multilingual Sentence Boundary
Detection", with plain counts in place of likelihoods).  One pass counts every
word with and without its stop per language, combined before the shuffle; the
list is bounded by a share of all stops, whatever the corpus size, so it may
travel with the plan as a literal set and splitting stays one narrow stage.
A short word that the corpus only ever has at the end of sentences counts as one too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

# An abbreviation has at least this many stops, and this share of all stops (so
# the list has at most LIST_BOUND entries).
MIN_STOPS = 5
LIST_BOUND = 20_000
# Of its occurrences, 9 in 10 carry the stop.
STOP_TENTHS = 9
# A long word without inner stops must also go on in lower case after 1 stop in 10.
SHORT_WORD = 4


def abbreviation_counts(lines: DataFrame, col: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, word, n_stop, n_plain, n_lower)`` of every lower-cased word: with a
    full stop, without, and with one that a lower-case word or comma follows."""
    marked = F.regexp_replace(F.col(col), P.STOP_INSIDE, ".\x01$1")
    words = lines.select(F.col(lang).alias("lang"), F.explode(F.regexp_extract_all(marked, F.lit(P.STOPPED_WORD), F.lit(0))).alias("t"))
    word = F.lower(F.regexp_replace("t", P.STOP_TAIL, ""))
    lower, stop = F.col("t").endswith("\x01"), F.col("t").rlike(P.STOP_TAIL)
    return (words.groupBy("lang", word.alias("word"))
                 .agg(F.sum(stop.cast("bigint")).alias("n_stop"), F.sum((~stop).cast("bigint")).alias("n_plain"),
                      F.sum(lower.cast("bigint")).alias("n_lower")))


def abbreviations(counts: DataFrame) -> DataFrame:
    """The rows of ``abbreviation_counts`` that are abbreviations, at most ``LIST_BOUND``."""
    total = counts.select(F.sum("n_stop")).scalar()
    often = (F.col("n_stop") >= MIN_STOPS) & (F.col("n_stop") * LIST_BOUND >= total)
    tied = F.col("n_stop") * 10 >= (F.col("n_stop") + F.col("n_plain")) * STOP_TENTHS
    shape = (F.length("word") <= SHORT_WORD) | F.col("word").contains(".") | (F.col("n_lower") * 10 >= F.col("n_stop"))
    return counts.where(often & tied & shape)


def sentence_marks(text: Column, lang: Column, known: list[tuple[str, str]]) -> Column:
    """The text with a newline at every sentence boundary that does not follow a
    ``known`` (lang, word) abbreviation; all other characters stay."""
    pieces = F.split(F.regexp_replace(text, P.SENTENCE_GAP, "$1$2\n$3"), "\n", -1)
    if not known:
        return F.array_join(pieces, "\n")
    keys = [f"{a or ''} {w}" for a, w in known]

    def glued(x):
        last = F.lower(F.regexp_extract(x, P.LAST_STOPPED_WORD, 1))
        return F.when(F.concat(F.coalesce(lang, F.lit("")), F.lit(" "), last).isin(keys), x).otherwise(F.concat(x, F.lit("\n")))
    # the last piece ends the line: the newline after it goes again
    return F.regexp_replace(F.array_join(F.transform(pieces, glued), ""), "\n$", "")


def split_sentences(lines: DataFrame, counts: DataFrame, col: str = "text", lang: str = "lang") -> DataFrame:
    """P5 with the corpus's own abbreviations: one row per sentence (``sent_no``
    from 0 within the line), trimmed."""
    known = [(r.lang, r.word) for r in abbreviations(counts).select("lang", "word").collect()]   # at most LIST_BOUND
    others = [c for c in lines.columns if c != col]
    marked = sentence_marks(F.col(col), F.col(lang), known)
    return (lines.select(*others, F.posexplode(F.split(marked, "\n", -1)).alias("sent_no", "sent"))
                 .withColumn("sent", F.trim("sent")))
