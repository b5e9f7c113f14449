"""The word lattice behind the best segmentation (training keeps its own, ``kept_lattice``).

For each *distinct* word, its substrings up to ``max_piece_length`` that are
pieces of the vocabulary become edges ``(s, e, piece, lp)``; a one-character
substring that is no piece becomes an *unknown* edge with a penalty score, so
every position is reachable.  Edges are grouped per word (the word table is
hash-partitioned by word, so the grouping reuses that partitioning) and a
fold over the edges sorted by end position keeps, per position, the maximum
with a back pointer (Viterbi).  That fold is a numpy kernel over Arrow batches of words, with no
Python step per word or edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import bounded_broadcast
from ..functions.lattice_kernels import viterbi_path

# --- fixed values: defaults of the Unigram trainer ---------------------------
MAX_PIECE_LENGTH = 16
UNK_PENALTY = 10.0

EDGE = "struct<s:int,e:int,piece:string,lp:double,pid:int,unk:boolean>"


def substrings(words: DataFrame, max_len: int = MAX_PIECE_LENGTH, col: str = "w") -> DataFrame:
    """All substrings ``w[s:e]`` with ``e - s <= max_len`` (0-based, end exclusive)."""
    n = F.length(col)
    return (words.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
                 .select("*", F.explode(F.sequence(F.col("s") + 1, F.least(n, F.col("s") + max_len))).alias("e"))
                 .withColumn("piece", F.expr(f"substring({col}, s + 1, e - s)"))
                 .withColumn("s", F.col("s").cast("int")).withColumn("e", F.col("e").cast("int")))


def by_word(words: DataFrame, col: str = "w") -> DataFrame:
    """Words hash-partitioned over a fixed number of tasks: they are small, their
    substrings are not, so sizes measured before the explode say little."""
    spark = words.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return words.repartition(tasks, col)


def lattice_edges(words: DataFrame, pieces: DataFrame, unk_lp: Column | float,
                  max_len: int = MAX_PIECE_LENGTH, col: str = "w") -> DataFrame:
    """Edges of every word; ``pieces`` has ``(piece, lp)`` and optionally ``pid``.

    One pass: substrings LEFT JOIN the (size-checked, broadcast) pieces; a
    one-character substring without a piece stays as an unknown edge.  The
    words are hash-partitioned by word first, and a broadcast join keeps that
    partitioning, so grouping the edges per word needs no shuffle of edges."""
    if "pid" not in pieces.columns:
        pieces = pieces.withColumn("pid", F.lit(None).cast("int"))
    table, _ = bounded_broadcast(pieces.select("piece", "lp", "pid"))
    subs = substrings(by_word(words, col), max_len, col)
    unk = unk_lp if isinstance(unk_lp, Column) else F.lit(float(unk_lp))
    return (subs.join(table, "piece", "left")
                .where(F.col("lp").isNotNull() | (F.col("e") - F.col("s") == 1))
                .withColumn("unk", F.col("lp").isNull())
                .withColumn("lp", F.coalesce(F.col("lp"), unk.cast("double"))))


def collect_edges(edges: DataFrame, keys) -> DataFrame:
    """One row per word: ``edges`` sorted by (end, start)."""
    keys = list(keys)
    return edges.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("e", "s", "piece", "lp", "pid", "unk"))).alias("edges"))


def _arrays(edges: Column):
    return (F.transform(edges, lambda x: x["s"]), F.transform(edges, lambda x: x["e"]),
            F.transform(edges, lambda x: x["lp"]))


def with_viterbi(df: DataFrame, edges: str = "edges", n: str = "n", out: str = "best") -> DataFrame:
    """Adds ``out`` = struct<score:double, path:array<EDGE>>, the best
    segmentation (edges in text order).  The dynamic programme is the
    ``viterbi_path`` kernel; everything around it stays in Spark."""
    s, e, lp = _arrays(F.col(edges))
    df = df.withColumn("_idx", viterbi_path(s, e, lp, F.col(n)))
    path = F.transform("_idx", lambda i: F.element_at(F.col(edges), i + 1))
    return (df.withColumn("_path", path)
              .withColumn(out, F.struct(F.aggregate("_path", F.lit(0.0), lambda acc, x: acc + x["lp"]).alias("score"),
                                        F.col("_path").alias("path")))
              .drop("_idx", "_path"))
