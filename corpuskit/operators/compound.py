"""Compound splitting at linking letters.

Grammar (the reference's recursive search, made exact and polynomial):
a word splits as ``small interfix (word | final)`` where ``small`` is a word
of the small list, ``interfix`` one linking character, and ``final`` a word of
the full list.  Of all valid cut lists the chosen one is the first in order of
smallest first cut, then smallest second cut, ...; a rest that can be split is
split even when it is itself in the full list.

Spark plan, per *distinct* word (never per occurrence):

0. only words that begin with a small word and an interfix can split: one row
   per cut finds them, the rest goes on with these;
1. candidate edges ``(j, p)``: ``w[p]`` is an interfix and ``w[j:p]`` is in the
   small list -- an explode of bounded width (``p - j`` is at most the longest
   small word) and a broadcast (size-checked) semi join; a list too large for
   that meets the distinct substrings only (``in_list``);
2. terminals ``t``: ``w[t:]`` is in the full list -- the same, with the full list;
3. one ``groupBy(w)`` (words arrive hash-partitioned by ``w``, so it adds no
   shuffle) and a dynamic programme in one ``aggregate`` fold: edges by start
   descending, then cut ascending, accept an edge when its start has none yet
   and ``p + 1`` is a terminal or an accepted start; then follow from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.joins import BROADCAST_ROWS, bounded_broadcast, lookup_join
from ..session import cut_lineage


def check_interfixes(interfixes) -> list[str]:
    """C5 / trap T11: interfixes are single characters."""
    out = list(interfixes)
    bad = [i for i in out if len(i) != 1]
    if bad:
        raise ValueError(f"interfixes must be single characters, got {bad}")
    return out


def _list(dicts: DataFrame, kind: str) -> DataFrame:
    return dicts.where(F.col("kind") == kind).select(F.col("word").alias("sub")).distinct()


def in_list(subs: DataFrame, listed: DataFrame, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``subs`` (one per place in a word) whose ``sub`` is in the list.  A list
    proven small is broadcast.  Past that the distinct substrings meet the list,
    so that one in every word is a single row of that join, and what was found goes
    back to the words by ``lookup_join``, which salts the frequent ones."""
    table, small = bounded_broadcast(listed, max_broadcast_rows)
    if small:
        return subs.join(table, "sub", "left_semi")
    counted = subs.groupBy("sub").agg(F.count(F.lit(1)).alias("f"))
    found = cut_lineage(counted.join(listed, "sub", "left_semi"))
    return lookup_join(subs, found.select("sub"), "sub", "inner", freq=found, max_broadcast_rows=max_broadcast_rows)


def split_edges(words: DataFrame, dicts: DataFrame, interfixes=P.DEFAULT_INTERFIXES, col: str = "w",
                max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """C1 + L10: rows ``(w, e_kind, a, b)`` of the words that begin with a small word and an
    interfix (no other splits); ``edge`` rows are cuts ``(j, p)``, ``term`` rows are
    terminal starts ``(t, -)``."""
    interfixes = check_interfixes(interfixes)
    # longest word of each list, as scalar subqueries (bound the head width)
    max_small = F.coalesce(dicts.where(F.col("kind") == "small").select(F.max("length")).scalar(), F.lit(0))
    max_full = F.coalesce(dicts.where(F.col("kind") == "full").select(F.max("length")).scalar(), F.lit(0))
    n = F.length(F.col("w"))

    def cuts_of(base):
        """Cut positions p in [1, n-2] holding an interfix character."""
        return (base.select("w", F.explode(F.sequence(F.lit(1), n - 2)).alias("p"))
                    .where(F.substring("w", F.col("p") + 1, 1).isin(*interfixes)))
    # a split begins with a small word at the word's start: one row per cut finds
    # the words that have one, and only these get all their edges
    begin = (cuts_of(words.select(F.col(col).alias("w")).where(F.length("w") >= 3)).where(F.col("p") <= max_small)
             .withColumn("sub", F.expr("substring(w, 1, p)")))
    cuts = cuts_of(cut_lineage(in_list(begin, _list(dicts, "small"), max_broadcast_rows).select("w").distinct()))
    heads = (cuts.select("w", "p", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - max_small),
                                                        F.col("p") - 1)).alias("j"))
                 .withColumn("sub", F.expr("substring(w, j + 1, p - j)")))
    heads = (in_list(heads, _list(dicts, "small"), max_broadcast_rows)
             .select("w", F.lit("edge").alias("e_kind"), F.col("j").cast("int").alias("a"), F.col("p").cast("int").alias("b")))
    terms = (cuts.select("w", (F.col("p") + 1).alias("t"))
                 .where(F.length("w") - F.col("t") < max_full + 1)
                 .withColumn("sub", F.expr("substring(w, t + 1)")))
    terms = (in_list(terms, _list(dicts, "full"), max_broadcast_rows)
             .select("w", F.lit("term").alias("e_kind"), F.col("t").cast("int").alias("a"), F.lit(-1).alias("b")))
    return heads.unionByName(terms)


def first_split(edges: Column, terms: Column) -> Column:
    """The cut list of the first valid split, NULL if there is none.

    ``edges``: array<struct<nj:int, p:int>> sorted ascending (start descending,
    then cut ascending); ``terms``: array<int> of terminal starts.  The fold
    keeps, for every start that can split, the cut list chosen from it; a
    start's first acceptable cut wins, and a rest that splits is preferred
    to a terminal rest.  The answer is the entry for start 0."""
    empty = F.create_map().cast("map<int,array<int>>")

    def step(m, e):
        j, p = -e["nj"], e["p"]
        rest = F.element_at(m, p + 1)
        ok = ~F.map_contains_key(m, j) & (rest.isNotNull() | F.array_contains(terms, p + 1))
        cuts = F.concat(F.array(p), F.coalesce(rest, F.array().cast("array<int>")))
        return F.when(ok, F.map_concat(m, F.create_map(j, cuts))).otherwise(m)
    return F.element_at(F.aggregate(edges, empty, step), F.lit(0))


def parts_of(w: Column, cuts: Column) -> Column:
    """Head, interfix, head, interfix, ..., rest."""
    k = F.size(cuts)
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c + 1))
    ends = F.concat(cuts, F.array(F.length(w)))

    def piece(i):
        s = F.element_at(starts, i + 1)
        e = F.element_at(ends, i + 1)
        part = F.substring(w, s + 1, e - s)
        return F.when(i < k, F.array(part, F.substring(w, e + 1, 1))).otherwise(F.array(part))
    return F.flatten(F.transform(F.sequence(F.lit(0), k), piece))


def compound_splits(words: DataFrame, dicts: DataFrame, interfixes=P.DEFAULT_INTERFIXES, col: str = "w",
                    max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """C1-C3 on a distinct-word table: ``(w, cuts, parts)`` for every word that
    splits (words that do not split have no row)."""
    e = split_edges(words, dicts, interfixes, col, max_broadcast_rows)
    grouped = (e.groupBy("w").agg(
        F.array_sort(F.collect_list(F.when(F.col("e_kind") == "edge",
                                           F.struct((-F.col("a")).alias("nj"), F.col("b").alias("p"))))).alias("edges"),
        F.collect_list(F.when(F.col("e_kind") == "term", F.col("a"))).alias("terms"))
        .where(F.exists("edges", lambda x: x["nj"] == 0)))
    # a generator (not a filter) drops words without a split, so the fold is
    # evaluated once per word and not copied into a pushed-down predicate
    cuts = F.explode(F.filter(F.array(first_split(F.col("edges"), F.col("terms"))), lambda c: c.isNotNull()))
    return (grouped.select("w", cuts.alias("cuts"))
                   .withColumn("parts", parts_of(F.col("w"), F.col("cuts"))))


def word_lookup(words: DataFrame, dicts: DataFrame, col: str = "w") -> DataFrame:
    """Is each word in the small list, in the full list?"""
    flags = (dicts.groupBy(F.col("word").alias(col))
                  .agg(F.max(F.col("kind") == "small").alias("in_small"),
                       F.max(F.col("kind") == "full").alias("in_full")))
    out = lookup_join(words, flags, col, "left")
    return out.select(*words.columns, F.coalesce("in_small", F.lit(False)).alias("in_small"),
                      F.coalesce("in_full", F.lit(False)).alias("in_full"))


def compound_tokens(tokens: DataFrame, splits: DataFrame, col: str = "token",
                    freq: DataFrame | None = None) -> DataFrame:
    """C4 / K4: replace every pre-token occurrence by its parts (``part_no``
    from 0).  The per-word split table is joined by ``lookup_join``: broadcast
    when bounded, else a shuffle join with hot words salted."""
    table = splits.select(F.col("w").alias(col), "parts")
    f = freq.select(F.col("w").alias(col), "f") if freq is not None else None
    others = [c for c in tokens.columns if c != col]
    joined = lookup_join(tokens, table, col, "left", freq=f, salt_cols=others or None)
    return joined.select(*others, F.posexplode(F.coalesce("parts", F.array(F.col(col)))).alias("part_no", "piece"))
