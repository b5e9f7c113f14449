"""N-gram Jaccard join by a token-group matrix.

A text's tokens are its distinct shingles of five words (A-Z lower-cased, words
between blanks; a shorter text is one shingle, an empty one has none).  Two
texts link when 100 * |intersection| >= 75 * |union|.

1. Texts with one token set form a class; all further work is on classes.
2. Order tokens by how often they occur (frequent ones found in every batch of
   texts, counted over all of them), then by hash.  Two linked sets share one
   of the first n - ceil(0.75 n) + 1 tokens of each (the prefix), whatever the
   order is; the frequent-last order keeps shared passages out of prefixes.
   Prefixes travel packed, by token, and only tokens of two or more classes stay;
   a known frequent token has several, so its classes are spread over all tasks.
3. Similar classes are partitioned into families: each goes to the class that
   leads most of its prefix tokens and is checked against it (linked ones form
   components).  A family of up to ``QUERIES`` classes is then compared in one task.
   Classes of a larger one go to the nearest of its centres (tokens of most of a
   sample's similar classes: any set gives the same result) and are compared by
   their differences from it.  As A and B differ by X(A) ^ X(B), with
   v = 7 |X| - n they link if and only if 14 * |X(A) & X(B)| >= v(A) + v(B).  So the
   class of least v links with all whose sum with it is not positive, and all
   other links share one of the rarer differences; those of one class only count
   for nothing, which leaves most classes that are no copies without a partner.
4. What is left are links between families and of classes like no centre.  The
   matrix of shared prefix tokens and groups (of about ``GROUP`` classes of a
   family) gives, for each class, the groups with classes of other components
   that it could reach, with enough common prefix tokens and fitting sizes.  For
   these the group's token union is built: a query is bounded by its overlap with
   the union, and only the groups that qualify are opened and compared set by
   set, and only for links that join two components.

So near copies, however many, cost one comparison each with their leader and
their tokens lead to no pairs among themselves.  Nothing is capped: groups and
queries of a group are only split.  Tokens and classes are told apart by
64-bit hashes.  Null text counts as empty; empty texts link with nothing, also
not with each other.  Repeated rows share a class.  A row is known by its id
and a digest of its text, so rows may share an id or have none.  An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_words, id_text, keyed_text, mix, prepare, stored, text_blocks, text_digest

WORDS = 5
#: Classes in a group and queries that meet it in one task, on average.
GROUP = 64
QUERIES = 256
#: Centres of a large family at most, and levels of differences within one.
CENTRES = 16
LEVELS = 16
#: A token in so many texts of one batch is counted as a frequent one.
LOCAL_COUNT = 3
#: Texts that make a batch for that count.
BATCH_TEXTS = 2000
#: Frequent tokens that all tasks know (an ordering only; 16 bytes each).
FREQUENT = 1 << 19
#: Prefix tokens per task of the matrix.
PART_TOKENS = 1 << 20

_MULTS = np.random.default_rng(55).integers(1, 2 ** 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def needed(n: int) -> int:
    return -(-75 * n // 100)


def prefix_size(n: int) -> int:
    return n - needed(n) + 1 if n else 0


def token_sets(data: np.ndarray, off: np.ndarray):
    """The sorted distinct shingle hashes of each text."""
    words, first = hash_words(data, off)
    count = len(words)
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
        five = sum(padded[k:k + count] * _MULTS[k] for k in range(WORDS))
    five = mix(five) if count else five
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= WORDS:
            yield np.unique(five[a:b - WORDS + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                yield mix((words[a:b] * _MULTS[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit number of the set, as a signed long."""
    with np.errstate(over="ignore"):
        total = mix(tokens ^ _MULTS[0]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens)) * _MULTS[1]
    return int(mix(total).view(np.int64)[0])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common entries of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = overlap(a, b)
    return common > 0 and 100 * common >= 75 * (len(a) + len(b) - common)


# --- 1, 2: classes, frequent tokens, prefixes -------------------------------------

SEEN = "kind int, doc_id bigint, digest bigint, n int, number bigint"


def _classes(batches):
    """Kind 0: a text's class and size; kind 1: a token with its count in a batch."""
    import pyarrow as pa

    def frequent(sets):
        if not sets:
            return None
        tokens, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        many = counts >= LOCAL_COUNT
        none = pa.nulls(int(many.sum()), pa.int64())
        return rows(1, none, none, counts[many], tokens[many].view(np.int64))

    def rows(kind, ids, digests, n, number):
        return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(n), pa.int32()), "doc_id": ids, "digest": digests,
                                           "n": pa.array(n, pa.int32()), "number": pa.array(number, pa.int64())})
    sets, texts = {}, 0
    for part, data, off in text_blocks(batches, "text"):
        n, ids = [], []
        for s in token_sets(data, off):
            k = set_id(s)
            n.append(len(s))
            ids.append(k)
            if len(s):
                sets[k] = s
        yield rows(0, part.column("doc_id"), part.column("digest"), n, ids)
        texts += len(n)
        if texts >= BATCH_TEXTS:
            if (got := frequent(sets)) is not None:
                yield got
            sets, texts = {}, 0
    if (got := frequent(sets)) is not None:
        yield got


def _known(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which tokens are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(tokens), bool)
    at = np.searchsorted(known, tokens)
    at[at == len(known)] = 0
    return known[at] == tokens


def _ordered(tokens: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Tokens, rare ones first; equal counts by hash."""
    if not len(known) or not len(tokens):
        return tokens
    at = np.searchsorted(known, tokens)
    at[at == len(known)] = 0
    count = np.where(known[at] == tokens, counts[at], 0)
    return tokens[np.argsort(count, kind="stable")]


def _prefixes(shared, parts: int):
    """Prefix tokens of the texts' classes, packed by part."""
    def run(batches):
        import pyarrow as pa
        known, counts = shared.value

        def packed(pending):
            if not pending:
                return None
            ids, sizes, tokens = zip(*((k, n, t) for k, (n, t) in pending.items()))
            size = [len(t) for t in tokens]
            token, cls = np.concatenate(tokens), np.repeat(np.array(ids, np.int64), size)
            n = np.repeat(np.array(sizes, np.int32), size)
            # a known token was in LOCAL_COUNT classes of one batch: its classes
            # need not meet to be counted
            hot = _known(token, known)
            part = (mix(np.where(hot, token ^ mix(cls.view(np.uint64)), token)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            used = np.flatnonzero(np.diff(cut))
            cell = lambda x: pa.array([x[order[cut[p]:cut[p + 1]]].tobytes() for p in used], pa.binary())
            return pa.RecordBatch.from_pydict({"part": pa.array(used, pa.int32()), "token": cell(token), "cls": cell(cls), "n": cell(n), "hot": cell(hot)})
        pending, held = {}, 0
        for _, data, off in text_blocks(batches, "text"):
            for s in token_sets(data, off):
                if len(s) and (k := set_id(s)) not in pending:
                    pending[k] = (len(s), _ordered(s, known, counts)[:prefix_size(len(s))])
                    held += len(pending[k][1])
            if held >= PART_TOKENS // 2:
                yield packed(pending)
                pending, held = {}, 0
        if pending:
            yield packed(pending)
    return run


PACKED = "part int, token binary, cls binary, n binary, hot binary"
SHARED = "token bigint, cls bigint, n int"


def _shared_tokens(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distinct (token, class) of a part, tokens of one class left out (a known
    token has other classes in other parts)."""
    token = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["token"]])
    cls = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["cls"]])
    n = np.concatenate([np.frombuffer(x, "<i4") for x in pdf["n"]])
    hot = np.concatenate([np.frombuffer(x, bool) for x in pdf["hot"]])
    order = np.lexsort((cls, token))
    token, cls, n, hot = token[order], cls[order], n[order], hot[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    token, cls, n, hot = token[new], cls[new], n[new], hot[new]
    _, at, count = np.unique(token, return_inverse=True, return_counts=True)
    many = hot | (count[at] > 1)
    return pd.DataFrame({"token": token[many], "cls": cls[many], "n": n[many]})


# --- sets of chosen classes ---------------------------------------------------------

def _sets_of(batches):
    import pyarrow as pa
    for part, data, off in text_blocks(batches, "text"):
        # two texts of one id with one digest: take that of the class
        rows = [(k, s.astype("<u8").tobytes()) for k, s in zip(part.column("cls").to_pylist(), token_sets(data, off)) if set_id(s) == k]
        yield pa.RecordBatch.from_pydict({"cls": pa.array([k for k, _ in rows], pa.int64()),
                                          "tokens": pa.array([t for _, t in rows], pa.binary())})


def _fetch(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cls, tokens`` of the wanted classes, from one text of each, stored."""
    chosen = classes.join(wanted.distinct(), "cls", "left_semi").select("cls", F.col("first.doc_id").alias("chosen_id"), F.col("first.digest").alias("chosen_digest"))
    # one text per class, rows spread evenly; the narrow side is held in memory
    own = F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("digest") == F.col("chosen_digest"))
    texts = keyed_text(docs).join(chosen.hint("shuffle_hash"), own).select("cls", "text")
    got = texts.mapInArrow(_sets_of, "cls bigint, tokens binary")
    return stored(got, "token-sets")


# --- 3: groups -------------------------------------------------------------------------

def _check_leader(pdf: pd.DataFrame) -> pd.DataFrame:
    """Members of one leader that link with it."""
    lead = pdf["cls"] == pdf["leader"]
    tokens = np.frombuffer(pdf.loc[lead, "tokens"].iloc[0], "<u8")
    members = pdf[~lead]
    ok = [linked(np.frombuffer(t, "<u8"), tokens) for t in members["tokens"]]
    return members.loc[ok, ["cls", "leader"]].rename(columns={"cls": "a", "leader": "b"})


LINKS = "a bigint, b bigint"


def _leader_links(docs: DataFrame, classes: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of classes with the leader of most of their prefix tokens, the
    families (every class that has a leader, and the leaders, with theirs) and
    the sets of their classes."""
    leaders = shared.groupBy("token").agg(F.min("cls").alias("leader"))
    pairs = (shared.join(leaders, "token").where("cls != leader")
                   .groupBy("cls", "n", "leader").agg(F.count(F.lit(1)).alias("c")))
    # a guess is enough here: a twentieth of the set in common prefix tokens
    best = (pairs.where("c * 20 >= n").groupBy("cls").agg(F.max(F.struct("c", "leader")).alias("m"))
                 .select("cls", F.col("m.leader").alias("leader")))
    sizes = best.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("salts"))
    best = stored(best.join(sizes, "leader").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts"))).drop("salts"), "leaders")
    sets = _fetch(docs, classes, best.select("cls").unionByName(best.select(F.col("leader").alias("cls")))).dropDuplicates(["cls"])
    heads = best.select("leader", "salt").distinct().withColumn("cls", F.col("leader"))
    rows = best.select("cls", "leader", "salt").unionByName(heads.select("cls", "leader", "salt")).join(sets, "cls")
    links = stored(rows.groupBy("leader", "salt").applyInPandas(lambda pdf: _check_leader(pdf), LINKS), "leader-links")
    # a leader that follows another one takes its followers along, one step
    up = best.select(F.col("cls").alias("leader"), F.col("leader").alias("far"))
    families = best.select("cls", "leader").join(up, "leader", "left").select("cls", F.coalesce("far", "leader").alias("family"))
    heads = families.select(F.col("family").alias("cls")).distinct().join(families, "cls", "left_anti")
    families = stored(families.unionByName(heads.select("cls", F.col("cls").alias("family"))), "families")
    return links, families, sets


def components(links: DataFrame) -> DataFrame:
    """``cls, comp``: the least class reachable by links, for all linked classes.
    Every round each class takes its smallest neighbour's smallest neighbour, the
    links are rewritten between the results, and those inside one go: what is
    left shrinks from round to round (a stored table each)."""
    ends = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    labels = ends(edges).select(F.col("a").alias("cls"), F.col("a").alias("comp")).distinct()
    while not edges.isEmpty():
        near = stored(ends(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "near")
        jump = stored(near.join(near.select(F.col("a").alias("to"), F.col("to").alias("root")), "to").select("a", "root"), "jump")
        left = jump.withColumnRenamed("root", "x")
        right = jump.select(F.col("a").alias("b"), F.col("root").alias("y"))
        edges = stored(edges.join(left, "a").join(right, "b").where("x != y")
                            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        labels = stored(labels.join(jump.withColumnRenamed("a", "comp"), "comp", "left")
                              .select("cls", F.coalesce("root", "comp").alias("comp")), "labels")
    return labels


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` after further links: only the components that these touch are
    worked on again."""
    at = comps.select(F.col("cls").alias("a"), F.col("comp").alias("x")), comps.select(F.col("cls").alias("b"), F.col("comp").alias("y"))
    between = stored(links.join(at[0], "a", "left").join(at[1], "b", "left")
                          .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")), "links")
    roots = components(between).select(F.col("cls").alias("comp"), F.col("comp").alias("root"))
    moved = comps.join(roots, "comp", "left").select("cls", F.coalesce("root", "comp").alias("comp"))
    new = roots.join(comps, roots["comp"] == comps["cls"], "left_anti").select(F.col("comp").alias("cls"), F.col("root").alias("comp"))
    return stored(moved.unionByName(new), "components")


# --- 3: inside the families ----------------------------------------------------------------

FAMILY = "a bigint, b bigint, centre int, tokens binary, family bigint"


def _centres(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Sets near many of the given ones: the tokens that most of those like a seed hold."""
    left, found = list(range(len(sets))), []
    while len(left) > 1:
        seed = sets[left.pop(0)]
        near = [i for i in left if 2 * overlap(sets[i], seed) >= max(len(seed), len(sets[i]))]
        if near:
            tokens, count = np.unique(np.concatenate([seed, *(sets[i] for i in near)]), return_counts=True)
            found.append((len(near), tokens[2 * count > len(near)]))
            left = [i for i in left if i not in set(near)]
    return [tokens for _, tokens in sorted(found, key=lambda x: -x[0])[:CENTRES]]


def _one_family(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a whole family that join two components, or the centres of a larger
    one, from a sample."""
    sets = [np.frombuffer(t, "<u8") for t in pdf["tokens"]]
    if pdf["size"].iloc[0] > len(sets):
        rows = [(None, None, k, c.tobytes()) for k, c in enumerate(_centres(sets))]
    else:
        cls, comp = pdf["cls"].to_numpy(), pdf["comp"].tolist()
        parent, rows = {c: c for c in comp}, []

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        for at, i in enumerate(order):
            for k in order[at + 1:]:
                if len(sets[i]) < needed(len(sets[k])):
                    break
                x, y = root(comp[i]), root(comp[k])
                if x != y and linked(sets[i], sets[k]):
                    rows.append((cls[i], cls[k], None, None))
                    parent[x] = y
    out = pd.DataFrame(rows, columns=["a", "b", "centre", "tokens"])
    return out.astype({"a": "Int64", "b": "Int64", "centre": "Int32"}).assign(family=int(pdf["family"].iloc[0]))


DIFFERENCES = "cls bigint, family bigint, centre int, n bigint, x bigint, diff array<bigint>"


def _differences(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tokens by which classes differ from their nearest centre (none: -1)."""
    central = pdf["centre"] >= 0
    centres = [(k, np.frombuffer(t, "<u8")) for k, t in zip(pdf.loc[central, "centre"], pdf.loc[central, "tokens"])]
    centres.sort(key=lambda x: x[0])
    members, rows = pdf[~central], []
    for cls, family, t in zip(members["cls"], members["family"], members["tokens"]):
        s = np.frombuffer(t, "<u8")
        x, k, at = min(((len(s) + len(c) - 2 * overlap(s, c), k, i) for i, (k, c) in enumerate(centres)), default=(len(s) + 1, -1, 0))
        near = x <= len(s)
        diff = np.setxor1d(s, centres[at][1], assume_unique=True).view(np.int64) if near else np.zeros(0, np.int64)
        rows.append((cls, family, k if near else -1, len(s), len(diff), diff))
    return pd.DataFrame(rows, columns=["cls", "family", "centre", "n", "x", "diff"])


def _verified(pairs: DataFrame, diffs: DataFrame) -> DataFrame:
    """Those pairs ``a, b`` that link."""
    own = diffs.select(F.col("cls").alias("a"), F.col("v").alias("v_a"), F.col("diff").alias("diff_a"))
    other = diffs.select(F.col("cls").alias("b"), F.col("v").alias("v_b"), F.col("diff").alias("diff_b"))
    return pairs.join(own, "a").join(other, "b").where("14 * size(array_intersect(diff_a, diff_b)) >= v_a + v_b").drop("v_a", "v_b", "diff_a", "diff_b")


def _central_links(diffs: DataFrame, comps: DataFrame) -> DataFrame:
    """``comps`` after all links between classes of one centre (``family``)."""
    with_comp = lambda df: df.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    # differences of two or more classes
    tokens = diffs.select("cls", "family", F.explode("diff").alias("token"))
    counts = tokens.groupBy("family", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    tokens = stored(tokens.join(counts, ["family", "token"]), "differing-tokens")
    usable = tokens.groupBy("cls").agg(F.count(F.lit(1)).alias("x_shared"))
    stats = (diffs.drop("diff").join(usable, "cls", "left").withColumn("x_shared", F.coalesce("x_shared", F.lit(0)))
                  .withColumn("w", F.expr("14 * x_shared - v")))
    ranges = stored(stats.groupBy("family").agg(F.min(F.struct("v", "cls")).alias("mid"), F.max("w").alias("w_max"), F.max("n").alias("n_max")), "ranges")
    # 14 * (common differences) >= v(a) + v(b) > 0 needs v(a) <= w(b) and v(b) <= w(a)
    stats = stored(stats.join(ranges, "family").withColumn("least", F.expr("greatest(1, ceil((v + mid.v) / 14D))")), "differing-classes")
    # the class of least v links with all whose sum with it is not positive
    straight = stats.where("v + mid.v <= 0 AND cls != mid.cls").select(F.col("cls").alias("a"), F.col("mid.cls").alias("b"))
    open_ = stats.where("least <= x_shared AND v <= w_max").select("cls", "v", "w", "n_max", F.expr("x_shared - least + 1").alias("length"))
    order = Window.partitionBy("cls").orderBy("c", "token")
    prefix = stored(tokens.join(open_, "cls").withColumn("rank", F.row_number().over(order)).where("rank <= length")
                          .select("cls", "family", "token", "v", "w", "n_max"), "differing-prefixes")
    # first with the most central class of most of these tokens: no more links than classes
    leaders = prefix.groupBy("family", "token").agg(F.min(F.struct("v", "cls")).alias("m"))
    best = (prefix.join(leaders, ["family", "token"]).where("cls != m.cls").groupBy("cls", "m.cls").agg(F.count(F.lit(1)).alias("c"))
                  .toDF("a", "b", "c").groupBy("a").agg(F.max(F.struct("c", "b")).alias("m")).select("a", F.col("m.b").alias("b")))
    links = stored(straight.unionByName(_verified(best, diffs)), "central-links")
    comps = merged(comps, links)
    # then with any class of another component; most of a family are of its largest one, so
    # that one's classes meet only others
    rows = stored(with_comp(prefix), "differing-rows")
    mixed = rows.groupBy("family", "token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("family", "token")
    home = (rows.select("family", "cls", "comp").distinct().groupBy("family", "comp").agg(F.count(F.lit(1)).alias("c"))
                .groupBy("family").agg(F.max(F.struct("c", "comp")).alias("m")).select("family", F.col("m.comp").alias("home")))
    level = lambda of: F.expr(f"cast(greatest(0, least({LEVELS - 1}, floor(4 * {of} / n_max))) AS int)")
    rows = rows.join(mixed, ["family", "token"]).join(home, "family").withColumn("level", level("w"))
    levels = rows.groupBy("family").agg(F.collect_set("level").alias("levels"))
    probes = (rows.where("comp != home").withColumn("from", level("v")).join(levels, "family")
                  .select("family", "token", F.explode(F.expr("filter(levels, l -> l >= from)")).alias("level"), F.col("cls").alias("a"),
                          F.col("comp").alias("x"), F.col("v").alias("v_a"), F.col("w").alias("w_a")))
    index = rows.select("family", "token", "level", F.col("cls").alias("b"), F.col("comp").alias("y"), F.col("v").alias("v_b"),
                        F.col("w").alias("w_b"), (F.col("comp") == F.col("home")).alias("at_home"))
    pairs = (probes.join(index, ["family", "token", "level"])
                   .where("x != y AND v_a <= w_b AND v_b <= w_a AND (at_home OR a < b)").select("a", "b", "y").distinct())
    links = _verified(pairs, diffs).groupBy("a", "y").agg(F.min("b").alias("b")).select("a", "b")
    return merged(comps, stored(links, "central-links"))


def _family_links(families: DataFrame, sets: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``comps`` after all links inside families, and the places of the classes:
    ``cls, family, size, chunk, met`` (no: not compared with the others of its family)."""
    size = families.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    sized = stored(families.join(size, "family").withColumn("parts", F.ceil(F.col("size") / QUERIES).cast("int")), "sized-families")
    # a class of a large family meets its centres only; those come from a part of it
    members = (sized.where("parts = 1 OR pmod(xxhash64(cls), parts) = 0").join(sets, "cls").join(comps, "cls", "left")
                    .withColumn("comp", F.coalesce("comp", "cls")))
    found = stored(members.groupBy("family").applyInPandas(lambda pdf: _one_family(pdf), FAMILY), "family-links")
    links = found.where("a IS NOT NULL").select("a", "b")
    if not links.isEmpty():
        comps = merged(comps, links)
    places = sized.where("parts = 1").select("cls", "family", "size", F.lit(True).alias("met"))
    large = sized.where("parts > 1")
    if not large.isEmpty():
        salts = large.select("family", "parts").distinct()
        centres = (found.where("centre IS NOT NULL").join(salts, "family").withColumn("salt", F.explode(F.expr("sequence(0, parts - 1)")))
                        .select(F.lit(0).cast("bigint").alias("cls"), "family", "salt", "centre", "tokens"))
        rows = large.join(sets, "cls").select("cls", "family", F.expr("cast(pmod(xxhash64(cls, 1), parts) AS int)").alias("salt"),
                                              F.lit(-1).alias("centre"), "tokens")
        diffs = stored(rows.unionByName(centres).groupBy("family", "salt").applyInPandas(lambda pdf: _differences(pdf), DIFFERENCES)
                           .withColumn("met", F.col("centre") >= 0).withColumn("v", F.expr("7 * x - n"))
                           .withColumn("family", F.xxhash64("family", "centre")).drop("centre"), "differences")
        comps = _central_links(diffs.where("met"), comps)
        size = diffs.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
        places = places.unionByName(diffs.join(size, "family").select("cls", "family", "size", "met"))
    chunk = F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / GROUP)).cast("bigint")
    return comps, stored(places.withColumn("chunk", chunk).select("cls", "family", "size", "chunk", "met"), "places")


# --- 4: the token-group matrix -----------------------------------------------------------

def _open_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Queries against one group: bound by the union, then open.  One union-find over
    the components of members and queries: only links that join two of them are
    looked for, so there are fewer links than components."""
    member = pdf["member"].to_numpy(bool)
    sets = [np.frombuffer(t, "<u8") for t in pdf["tokens"]]
    cls, comp = pdf["cls"].to_numpy(), pdf["comp"].tolist()
    inside = np.flatnonzero(member)
    union = np.unique(np.concatenate([sets[i] for i in inside])) if len(inside) else np.zeros(0, np.uint64)
    parent = {c: c for c in comp}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c
    out = []
    for q in np.flatnonzero(~member):
        s = sets[q]
        if overlap(s, union) < needed(len(s)):
            continue
        for i in sorted(inside, key=lambda i: abs(len(sets[i]) - len(s))):
            x, y = root(comp[q]), root(comp[i])
            if x != y and linked(s, sets[i]):
                out.append((cls[q], cls[i]))
                parent[x] = y
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _group_links(docs: DataFrame, classes: DataFrame, shared: DataFrame, comps: DataFrame, places: DataFrame) -> DataFrame:
    """Links between classes of different components that have not met inside a family."""
    place = places.join(comps, "cls", "left").select("cls", "family", "size", "chunk", "met", F.coalesce("comp", "cls").alias("comp"))
    # a class without a family is a group of its own
    alone = {"family": F.col("cls"), "size": F.lit(1).cast("bigint"), "chunk": F.lit(0).cast("bigint"), "comp": F.col("cls"), "met": F.lit(True)}
    rows = shared.join(place, "cls", "left").select("token", "cls", "n", *[F.coalesce(F.col(k), v).alias(k) for k, v in alone.items()])
    mixed = (rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("family").alias("first"),
                                       F.max("family").alias("last"), F.min("met").alias("met"))
                 .where("low != high AND (first != last OR NOT met)").select("token"))
    rows = stored(rows.join(mixed, "token"), "mixed-tokens")
    if rows.isEmpty():
        return docs.sparkSession.createDataFrame([], LINKS)
    matrix = rows.groupBy("token", "size", "family", "chunk").agg(
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    g = matrix.select("token", F.struct("size", "family", "chunk").alias("g"), "n_min", "n_max", "low", "high")
    pairs = (rows.withColumn("own", F.struct("size", "family", "chunk")).join(g, "token")
                 # one direction between two groups: the query is of the smaller family
                 .where("own <= g AND NOT (low = comp AND high = comp) AND NOT (met AND own.family = g.family)")
                 .where("100 * n >= 75 * n_min AND 100 * n_max >= 75 * n")
                 .groupBy("cls", "n", "comp", "g")
                 .agg(F.count(F.lit(1)).alias("c"), F.min("n_min").alias("n_min"), F.max("n_max").alias("n_max")))
    # common prefix tokens that a member of size y needs: the overlap of linked
    # sets less what can lie behind the prefixes; least at an end of the range
    least = "({y} + n) * 3 / 7 - 0.75 * greatest({y}, n) - 1"
    low, high = least.format(y="greatest(n_min, 0.75 * n)"), least.format(y="least(n_max, n / 0.75)")
    pairs = stored(pairs.where(f"c >= least({low}, {high})")
                        .select("cls", "comp", F.col("g.family").alias("family"), F.col("g.chunk").alias("chunk")), "query-groups")
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], LINKS)
    salts = pairs.groupBy("family", "chunk").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("salts"))
    queries = (pairs.join(salts, ["family", "chunk"]).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")))
                    .select("cls", "comp", "family", "chunk", "salt", F.lit(False).alias("member")))
    single = (pairs.select("family").distinct().join(places.select("family").distinct(), "family", "left_anti")
                   .select(F.col("family").alias("cls"), "family", F.lit(0).cast("bigint").alias("chunk"), F.col("family").alias("comp")))
    inside = place.select("cls", "family", F.col("chunk").cast("bigint").alias("chunk"), "comp").unionByName(single)
    members = (inside.join(salts, ["family", "chunk"])
                     .withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)")))
                     .select("cls", "comp", "family", "chunk", F.col("salt").cast("bigint").alias("salt"), F.lit(True).alias("member")))
    meet = stored(queries.unionByName(members), "group-meetings")
    sets = _fetch(docs, classes, meet.select("cls"))
    return (meet.join(sets.dropDuplicates(["cls"]), "cls").groupBy("family", "chunk", "salt")
                .applyInPandas(lambda pdf: _open_group(pdf), LINKS))


def _components_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, digest, n, cls`` of every row, and ``cls, comp, first`` of every
    class with shingles.  ``first`` is the class's row with the smallest id (none
    only if all have none), of equal ids the one with the smallest digest."""
    spark = prepare(docs.sparkSession)
    seen = stored(keyed_text(docs).mapInArrow(_classes, SEEN), "text-classes")
    texts = seen.where("kind = 0").select("doc_id", "digest", "n", F.col("number").alias("cls"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    classes = texts.where("n > 0").groupBy("cls", "n").agg(F.min(row).alias("first"))
    frequent = (seen.where("kind = 1").groupBy("number").agg(F.sum("n").alias("c"))
                    .orderBy(F.desc("c"), "number").limit(FREQUENT).toPandas())  # bounded by FREQUENT
    known = frequent["number"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    shared_counts = spark.sparkContext.broadcast((known[order], frequent["c"].to_numpy(np.int64)[order]))
    total = classes.select(F.sum(F.col("n") - F.ceil(F.col("n") * 0.75) + 1)).first()[0] or 0
    parts = int(min(max(16, -(-total // PART_TOKENS)), 1 << 16))
    packed = id_text(docs).select("text").mapInArrow(_prefixes(shared_counts, parts), PACKED)
    shared = stored(packed.groupBy("part").applyInPandas(lambda pdf: _shared_tokens(pdf), SHARED), "shared-tokens")
    first, families, sets = _leader_links(docs, classes, shared)
    comps, places = _family_links(families, sets, components(first))
    links = stored(_group_links(docs, classes, shared, comps, places), "group-links")
    if not links.isEmpty():
        comps = merged(comps, links)
    return texts, classes.join(comps, "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"), "first")


def similar_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    texts, home = _components_of(docs)
    # smallest id of each component, and of each class outside of them
    home = home.select("cls", "comp", F.col("first.doc_id").alias("first_id"))
    least = home.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    home = home.join(least, "comp").select("cls", "component_id")
    return (texts.join(home, "cls", "left")
                 .select("doc_id", F.col("n").cast("bigint").alias("n_shingles"),
                         F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of linked texts, all columns kept: the
    one with the smallest id (a null id counts as larger than any other), of equal
    ids the one with the smallest digest.  Rows are told apart by id and digest,
    so other texts under the same id or under none are judged on their own.
    A text without shingles links with nothing and stays."""
    texts, home = _components_of(docs)
    chosen = home.groupBy("comp").agg(F.min("first").alias("first")).select("first.doc_id", "first.digest")
    empty = texts.where("n = 0").select("doc_id", "digest").distinct()
    kept = stored(chosen.unionByName(empty).select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest")), "kept-rows")
    own = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_digest"))
    out = docs.withColumn("_digest", text_digest()).join(kept.hint("shuffle_hash"), own, "left_semi")
    if not texts.where("n > 0").groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        # repeated rows of one id and text
        full = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        out = out.where(~full).unionByName(out.where(full).dropDuplicates(["doc_id", "_digest"]))
    return out.drop("_digest")


ORACLE_SQL = None
