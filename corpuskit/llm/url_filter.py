"""URL filter lists by expression digests.

A rule is a host and a path: it fits its host and all subdomains if the URL's
path starts with the rule's.  Of the rules that fit, the longest (host and path
together) decides, of equally long ones that with the longer host; a host and
path listed both ways is blocked.  Without a rule the verdict is ``default``.

1. A URL is cut into host (after the first ``://``, A-Z lower-cased) and path.
   Only the host's end and the path's beginning, as long as the longest rule's,
   decide, so URLs are judged once per such place.
2. Each place is expanded into host-suffix x path-prefix expressions: the
   suffixes after a dot and the prefixes of the lengths that rules have.
3. The expressions meet the rules in an equi-join on the first ``SHORT`` hex
   digits of their sha-256; then the full digests are compared.
4. The best rule of each place goes back to the pages.

Both joins broadcast the smaller table only if its checked size allows, and else
salt the hot keys (``com/`` is an expression of most places).

A null URL, one without ``://``, or an empty one has an empty host and path, which
no rule fits.  Rules with a null host are ignored; a null path is the empty one.
Repeated pages and null ids are rows like any other; other columns are not read.
Empty tables of pages or rules work.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import lookup_join
from .common import prepare, stored

#: Hex digits of a digest's short form, the join key.
SHORT = 8
#: Bytes of rules that may be broadcast.
RULE_BYTES = 64 << 20

#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
RULE_SCHEMA = "host string, path string, verdict string"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(raw), path


def _expression(host: Column, path: Column) -> Column:
    # neither a host nor a path holds a '#'
    return F.sha2(F.concat(host, F.lit("#"), path), 256)


def rule_table(rules: DataFrame) -> tuple[DataFrame, int, list[int]]:
    """``short, entries`` of the rules, the longest host, and the paths' lengths
    (at most as many as the longest path has characters)."""
    rules = (rules.where("host IS NOT NULL")
                  .select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
                  .groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocked")))
    sizes = rules.agg(F.max(F.length("host")), F.collect_set(F.length("path"))).first()
    entry = F.struct(F.sha2(F.concat("host", F.lit("#"), "path"), 256).alias("digest"),
                     (F.length("host") + F.length("path")).alias("chars"), F.length("host").alias("host_chars"),
                     F.concat("host", "path").alias("rule"), "blocked")
    table = (rules.select(entry.alias("e")).groupBy(F.substring("e.digest", 1, SHORT).alias("short"))
                  .agg(F.collect_list("e").alias("entries")))
    return table, sizes[0] or 0, sorted(sizes[1] or [])


def place_of(longest_host: int, lengths: list[int]) -> dict[str, Column]:
    """The deciding end of the host (``#`` before it if it is not whole) and
    beginning of the path."""
    whole = F.length("host") <= longest_host
    tail = F.when(whole, F.col("host")).otherwise(F.concat(F.lit("#"), F.right("host", F.lit(longest_host + 1))))
    return {"tail": tail, "head": F.substring("path", 1, lengths[-1] if lengths else 0)}


def expand(places: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each expression of each place."""
    # a suffix begins after a dot, or is the whole host
    labels = F.when(F.col("tail").startswith("#"), F.expr("slice(split(tail, '[.]'), 2, size(split(tail, '[.]')))")).otherwise(F.split("tail", "[.]"))
    rows = places.withColumn("labels", labels)
    suffixes = F.expr("transform(labels, (x, i) -> array_join(slice(labels, i + 1, size(labels)), '.'))")
    sizes = F.array(*map(F.lit, lengths)).cast("array<int>")
    rows = rows.select("place", "head", F.explode(suffixes).alias("suffix"))
    rows = rows.select("place", "head", "suffix", F.explode(sizes).alias("size")).where("size <= length(head)")
    digest = F.sha2(F.concat("suffix", F.lit("#"), F.expr("substring(head, 1, size)")), 256)
    return rows.select("place", digest.alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", rule_bytes: int = RULE_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``."""
    prepare(pages.sparkSession)
    table, longest_host, lengths = rule_table(rules)
    host, path = host_and_path()
    pages = (pages.select("page_id", host.alias("host"), path.alias("path"))
                  .withColumns(place_of(longest_host, lengths)).withColumn("place", F.concat("tail", F.lit("#"), "head")))
    places = stored(pages.groupBy("place", "tail", "head").agg(F.count(F.lit(1)).alias("f")), "places")
    most = rule_bytes // (200 + 2 * (longest_host + (lengths[-1] if lengths else 0)))
    hits = (lookup_join(expand(places, lengths), table, "short", how="inner", max_broadcast_rows=most)
            .select("place", F.explode(F.filter("entries", lambda e: e.digest == F.col("digest"))).alias("e")))
    best = hits.groupBy("place").agg(F.max(F.struct("e.chars", "e.host_chars", "e.blocked", "e.rule")).alias("e"))
    verdicts = stored(best.select("place", "e.rule", F.when(F.col("e.blocked"), "block").otherwise("allow").alias("found")), "verdicts")
    out = lookup_join(pages.select("page_id", "host", "path", "place"), verdicts, "place", freq=places.select("place", "f"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))


def judge_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages, spark.createDataFrame(RULES, RULE_SCHEMA))


_HOST = "regexp_extract(rest, '^[^/?#]*')"
ORACLE_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS row_no, page_id,
                  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_no, page_id, translate({_HOST}, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
             regexp_extract(substr(rest, length({_HOST}) + 1), '^[^?#]*') AS path FROM u),
r(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, RULES))}),
f AS (SELECT p.*, rule_host || rule_path AS rule, rule_verdict,
             row_number() OVER (PARTITION BY row_no ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_verdict DESC) AS place
      FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM f WHERE place = 1
"""
