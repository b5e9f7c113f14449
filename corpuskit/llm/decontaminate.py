"""Benchmark decontamination: size-partitioned MinHash containment search
(DataFrame functions only).

An item matches a document that holds at least 75 % of the item's distinct
five-word shingles (lower-cased words between blanks; a text with fewer words
is one shingle).  Items are partitioned by size, n shingles into the classes
[2^j, 2^(j+1)).  The MinHash sketch of an item is its k smallest shingle
hashes, with k = u - ceil(0.75 u) + 1 for its class's largest size u: a
document that misses at most n - ceil(0.75 n) of the item's shingles must hold
one of any k, so the search loses no match however long the document is, and
skips classes whose smallest size a document cannot contain.  Candidates are
then verified on the shingles themselves.

The items' tables are broadcast up to a checked number of rows and
shuffle-joined beyond it.  Empty and null texts hold no shingle and match
nothing.  Rows with one id (also a null one) count as one document in the
operator's table; the pipeline's stage judges each row by its own text.  Empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, prepare, stored, text_digest

WORDS = 5
PERCENT = 75
#: Rows of an item table, or ids of candidates, up to which it is broadcast.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), "")


def shingle_hashes(w: str) -> Column:
    """64-bit hashes of the shingles of the word array ``w``, in order, with repeats."""
    return F.expr(f"""
        CASE WHEN size({w}) >= {WORDS} THEN
               transform(sequence(0, size({w}) - {WORDS}), i -> xxhash64({', '.join(f'{w}[i + {k}]' for k in range(WORDS))}))
             WHEN size({w}) > 0 THEN array(xxhash64(array_join({w}, ' ')))
             ELSE array() END""")


def shingle_texts(w: str) -> Column:
    """The distinct shingles themselves."""
    return F.expr(f"""
        array_distinct(CASE
             WHEN size({w}) >= {WORDS} THEN transform(sequence(1, size({w}) - {WORDS - 1}), i -> array_join(slice({w}, i, {WORDS}), ' '))
             WHEN size({w}) > 0 THEN array(array_join({w}, ' '))
             ELSE array() END)""")


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sketches(items: DataFrame) -> DataFrame:
    """``hash, item_id, smallest``: the sketch of each item; ``smallest``: the
    least number of shingles that a match in the item's class needs."""
    largest = F.expr("shiftleft(2, cast(floor(log2(n)) as int)) - 1")
    sized = (items.select("item_id", F.array_distinct(shingle_hashes("w")).alias("h"))
                  .withColumn("n", F.size("h")).where("n > 0").withColumn("u", largest))
    k = F.expr(f"u - cast(ceil({PERCENT} * u / 100.0) as int) + 1")
    return sized.select("item_id", F.expr(f"cast(ceil({PERCENT} * ((u + 1) / 2) / 100.0) as int)").alias("smallest"),
                        F.explode(F.slice(F.sort_array("h"), F.lit(1), k)).alias("hash"))


def _same(keys: list[str], others: list[str]) -> Column:
    """Equal keys on both sides of a join, null equal to null."""
    out = F.lit(True)
    for a, b in zip(keys, others):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _matches(texts: DataFrame, keys: list[str], benchmark: DataFrame) -> DataFrame:
    """``*keys, item_id, n_shingles, n_shared`` of every match; rows of ``texts``
    with the same keys count as one document."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w"))
    sketch = _maybe_broadcast(stored(sketches(items), "sketches"))
    # explode_outer: for a plain explode the optimizer adds a filter on the
    # array's size and pushes it below the projections, where the words would
    # be split again for every shingle.  The joins drop the null of an empty array.
    # search: every shingle hash of every document against the sketches
    hashed = (texts.select(*keys, words(F.col("text")).alias("w"))
                   .select(*keys, shingle_hashes("w").alias("h"))
                   .select(*keys, F.size("h").alias("m"), F.explode_outer("h").alias("hash")))
    pairs = (hashed.join(sketch, "hash").where("m >= smallest")
                   .select(*keys, "item_id").distinct())
    pairs = stored(pairs, "candidates")
    # verify: the candidates' texts only
    cand = [f"cand_{k}" for k in keys]
    renamed = [F.col(k).alias(c) for k, c in zip(keys, cand)]
    ids = _maybe_broadcast(pairs.select(*renamed).distinct())
    found = texts.join(ids, _same(keys, cand), "left_semi")
    held = (found.select(*keys, words(F.col("text")).alias("w"))
                 .select(*keys, F.explode_outer(shingle_texts("w")).alias("shingle")))
    wanted = items.select("item_id", shingle_texts("w").alias("s")).withColumn("n_shingles", F.size("s"))
    wanted = wanted.select("item_id", "n_shingles", F.explode_outer("s").alias("shingle"))
    shared = (held.join(_maybe_broadcast(wanted), "shingle").distinct()
                  .groupBy(*keys, "item_id", "n_shingles").agg(F.count(F.lit(1)).alias("n_shared")))
    both = pairs.select(*renamed, F.col("item_id").alias("cand_item"))
    return (shared.where(F.col("n_shared") * 100 >= F.col("n_shingles") * PERCENT)
                  .join(both, _same([*keys, "item_id"], [*cand, "cand_item"]), "left_semi"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` of every match."""
    prepare(docs.sparkSession)
    return (_matches(docs.select("doc_id", "text"), ["doc_id"], benchmark)
            .select("doc_id", "item_id", F.col("n_shingles").cast("bigint").alias("n_shingles"), "n_shared",
                    (F.col("n_shared") / F.col("n_shingles")).alias("containment")))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds an item.  Each row is judged by
    its own text, known by id and digest, whatever other rows have its id or none."""
    prepare(docs.sparkSession)
    bad = (_matches(keyed_text(docs), ["doc_id", "digest"], benchmark)
           .select(F.col("doc_id").alias("_bad_id"), F.col("digest").alias("_bad_digest")).distinct())
    return (docs.withColumn("_digest", text_digest())
                .join(bad.hint("shuffle_hash"), _same(["doc_id", "_digest"], ["_bad_id", "_bad_digest"]), "left_anti").drop("_digest"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT kind, id, unnest(list_distinct(CASE
      WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingle
  FROM w),
i AS (SELECT id AS item_id, shingle, count(*) OVER (PARTITION BY id) AS n_shingles FROM s WHERE kind = 'i')
SELECT d.id AS doc_id, item_id, n_shingles, count(DISTINCT i.shingle) AS n_shared,
       count(DISTINCT i.shingle) / n_shingles AS containment
FROM i JOIN s d ON d.kind = 'd' AND d.shingle = i.shingle
GROUP BY d.id, item_id, n_shingles
HAVING count(DISTINCT i.shingle) * 100 >= n_shingles * 75
"""
