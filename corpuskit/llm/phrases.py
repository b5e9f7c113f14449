"""Phrase collocations by top-order marginalisation.

A text (A-Z lower-cased) is cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these
into words ``[^\\x20\\x09]+``.  All counts are per language (null: ``und``).

1. Every word begins one longest window: itself and its ``order - 1`` lead words,
   padded with the empty word behind the piece's end.  Only these windows
   are counted.
2. Spark's ROLLUP over the window's columns sums them to all shorter prefixes:
   the count of a phrase is that of the windows which begin with it, the count of
   the empty prefix is the number of words.
3. A phrase's score is that of its weakest cut, in exact decimal arithmetic;
   phrases that a longer candidate explains go; ranks are per language.

Most windows are unique, and no phrase of theirs can be a candidate.  So a first
pass adds up the counts of phrases in 2^``SKETCH_BITS`` hashed slots.  A phrase in a
slot below ``least`` is certainly rarer than ``least``, and so is every longer one that
begins with it: the second pass pads a window where it becomes such a phrase.
This leaves all counts of words and of phrases that reach ``least`` unchanged.
Slots are shared by chance only upwards, so a full sketch (many more phrases
than slots) pads less and costs shuffle, never a phrase.

Null, empty or blank texts have no words; repeated rows count each time; an empty
table has no phrases; other columns are not read.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _fold, _LOWER, _LOWER_VALUES, mix, prepare, shared_path, stored, text_blocks

#: Slots of the phrase sketch; its bit map of 2^28 / 8 bytes = 32 MB goes to the workers.
SKETCH_BITS = 28
#: Slices of the sketch that are summed apart.
SLICES = 64
#: Phrases of one task that are counted before they are handed on.
FLUSH = 1 << 22
#: Cells of a slice summed by one task before the tasks' sums are.
FAN = 256
#: Parts of a language that are cut to the best before the whole is.
RANK_PARTS = 64

_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\x0b\f\r"]] = True
_WORD = ~_BREAKS
_WORD[[32, 9]] = False
_MULTS = np.random.default_rng(13).integers(1, 2 ** 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def piece_words(data: np.ndarray, off: np.ndarray):
    """Lower-cased bytes of all words, where each begins among them, and a
    number for each word's piece (texts are never in one piece)."""
    inside = _WORD[data]
    begin = inside.copy()
    cut = off[:-1][off[:-1] < len(data)]
    if len(data):
        begin[1:] &= ~inside[:-1]
        begin[cut] = inside[cut]
    border = _BREAKS[data].astype(np.int64)
    np.add.at(border, cut, 1)
    starts = np.flatnonzero(begin)
    return _LOWER[data[inside]].astype(np.uint8), np.flatnonzero(begin[inside]), np.cumsum(border)[starts], starts


def _distinct(chars: np.ndarray, starts: np.ndarray):
    """The distinct words as an Arrow array, and each word's index in it."""
    import pyarrow as pa
    ends = np.append(starts, len(chars)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(chars)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _langs(column):
    """Distinct languages (null: ``und``) and each text's index."""
    coded = column.fill_null("und").dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _hashes(strings) -> np.ndarray:
    """64-bit hashes of an Arrow array of non-null strings or binaries."""
    import pyarrow as pa
    strings = strings.cast(pa.large_binary())
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    raw = np.frombuffer(strings.buffers()[2], np.uint8)[ends[0]:ends[-1]] if len(strings) and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    out = np.zeros(len(strings), np.uint64)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        out[full] = _fold(_LOWER_VALUES[raw], (ends[:-1] - ends[0])[full])
    return out


class Words:
    """The words of a block of texts, by index, with the slots of their phrases."""

    def __init__(self, part, data, off, bits: int):
        chars, begin, self.piece, at = piece_words(data, off)
        self.words, self.ids = _distinct(chars, begin)
        self.langs, lang = _langs(part.column("lang"))
        self.lang = np.repeat(lang, np.diff(np.searchsorted(at, off)))
        self.bits = bits

    def phrases(self, order: int):
        """For each length from 1 on: whether a phrase of that length begins at
        each word, and its slot."""
        n = len(self.ids)
        h, g = _hashes(self.words)[self.ids], _hashes(self.langs)
        with np.errstate(over="ignore"):
            total = (h + (g * _MULTS[0])[self.lang]) if n else h
            yield np.ones(n, bool), mix(total) >> np.uint64(64 - self.bits)
            for k in range(1, order):
                total, inside, m = mix(total * _MULTS[k % len(_MULTS)]), np.zeros(n, bool), max(n - k, 0)
                total[:m] += h[k:]
                inside[:m] = self.piece[k:] == self.piece[:m]
                yield inside, mix(total) >> np.uint64(64 - self.bits)


# --- the sketch of phrase counts -----------------------------------------------------

CELL = "slice int, slots binary, counts binary"


def _phrase_cells(order: int, bits: int, least: int):
    """Slots of the phrases of a task with their counts (``least`` stands for more),
    packed by slice."""
    def run(batches):
        import pyarrow as pa
        import zlib

        def cells(held):
            if not held:
                return
            slots, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(slots, np.arange(SLICES + 1, dtype=np.uint64) << np.uint64(bits - SLICES.bit_length() + 1))
            used = np.flatnonzero(np.diff(cut))
            counts = np.minimum(counts, least).astype("<i4")
            gaps = np.diff(slots, prepend=np.uint64(0)).astype("<u4")
            gaps[cut[used]] = (slots[cut[used]] - (used.astype(np.uint64) << np.uint64(bits - SLICES.bit_length() + 1))).astype("<u4")
            pack = lambda x: pa.array([zlib.compress(x[cut[s]:cut[s + 1]].tobytes(), 1) for s in used], pa.binary())
            yield pa.RecordBatch.from_pydict({"slice": pa.array(used, pa.int32()), "slots": pack(gaps), "counts": pack(counts)})
        held, size = [], 0
        for part, data, off in text_blocks(batches, "text"):
            for inside, slot in Words(part, data, off, bits).phrases(order):
                held.append(slot[inside])
                size += len(held[-1])
            if size >= FLUSH:
                yield from cells(held)
                held, size = [], 0
        yield from cells(held)
    return run


def _sum_cells(bits: int, least: int, final: bool):
    """Sums of the cells of a slice as they come (one dense slice in memory);
    ``final``: the bits of slots that reach ``least``."""
    width = 1 << (bits - SLICES.bit_length() + 1)

    def run(batches):
        import pyarrow as pa
        import zlib

        def out(key, total):
            if final:
                return pa.RecordBatch.from_pydict({"slice": pa.array([key], pa.int32()), "rare": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})
            at = np.flatnonzero(total)
            gaps = np.diff(at, prepend=0).astype("<u4")
            return pa.RecordBatch.from_pydict({"slice": pa.array([key], pa.int32()), "slots": pa.array([zlib.compress(gaps.tobytes(), 1)], pa.binary()),
                                               "counts": pa.array([zlib.compress(total[at].astype("<i4").tobytes(), 1)], pa.binary())})
        key, sub, total = None, None, None
        for batch in batches:
            for s, t, gaps, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "sub", "slots", "counts"))):
                if (s, t) != (key, sub):
                    if total is not None:
                        yield out(key, total)
                    key, sub, total = s, t, np.zeros(width, np.int32)
                at = np.cumsum(np.frombuffer(zlib.decompress(gaps), "<u4").astype(np.int64))
                total[at] = np.minimum(total[at] + np.frombuffer(zlib.decompress(counts), "<i4"), least)
        if total is not None:
            yield out(key, total)
    return run


def frequent_slots(docs: DataFrame, order: int, least: int, bits: int) -> np.ndarray:
    """The bit map of the slots whose phrases occur ``least`` times together
    (2^``bits`` bits whatever the input)."""
    if bits < SLICES.bit_length() + 2:
        raise ValueError("a slice of the sketch has at least 8 slots")
    cells = docs.mapInArrow(_phrase_cells(order, bits, least), CELL)
    tasks = docs.rdd.getNumPartitions()
    while tasks > FAN:  # so many cells of a slice are first summed in groups
        tasks = -(-tasks // FAN)
        groups = cells.withColumn("sub", F.pmod(F.spark_partition_id(), F.lit(tasks))).repartition("slice", "sub").sortWithinPartitions("slice", "sub")
        cells = stored(groups.mapInArrow(_sum_cells(bits, least, False), CELL), "phrase-cells")
    groups = cells.select("slice", F.lit(0).alias("sub"), "slots", "counts").repartition("slice").sortWithinPartitions("slice")
    rows = groups.mapInArrow(_sum_cells(bits, least, True), "slice int, rare binary").collect()  # 2^bits bits in all
    table = np.zeros((SLICES, (1 << bits) // 8 // SLICES), np.uint8)
    for r in rows:
        table[r["slice"]] = np.frombuffer(r["rare"], np.uint8)
    return table.reshape(-1)


# --- windows and their counts --------------------------------------------------------

def _windows(frequent, order: int, bits: int):
    """Padded longest windows with their counts in a block of texts."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        bitmap = frequent.value
        names = [f"w{k}" for k in range(1, order + 1)]
        for part, data, off in text_blocks(batches, "text", 4 << 20):
            block = Words(part, data, off, bits)
            n = len(block.ids)
            if not n:
                continue
            pad = len(block.words)
            columns, longer = [], np.ones(n, bool)
            for k, (inside, slot) in enumerate(block.phrases(order)):
                bit = bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8) & 1
                longer &= inside & bit.astype(bool)
                lead = np.append(block.ids[k:], np.full(min(k, n), pad))
                columns.append(np.where(longer, lead, pad))
            counted = (pa.table(dict(zip(names, columns)) | {"lang": block.lang}).group_by(["lang", *names], use_threads=False)
                       .aggregate([([], "count_all")]))
            # one narrow string to shuffle: the words, then the language
            words = pa.concat_arrays([block.words, pa.array([b""], pa.large_binary())]).cast(pa.binary()).cast(pa.string())
            text = pc.utf8_rtrim(pc.binary_join_element_wise(*(words.take(counted[c].combine_chunks()) for c in names), " "), " ")
            langs = block.langs.cast(pa.string()).take(counted["lang"].combine_chunks())
            batch = pa.table({"lead_window": pc.binary_join_element_wise(text, langs, "\n"), "c": counted["count_all"].cast(pa.int64())})
            yield from batch.to_batches(max_chunksize=50_000)
    return run


def phrase_counts(docs: DataFrame, order: int, least: int, bits: int = SKETCH_BITS) -> DataFrame:
    """``lang, words, f``: exact counts of the phrases of up to ``order`` words that
    occur ``least`` times, and of the empty phrase (all words)."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    frequent = spark.sparkContext.broadcast(frequent_slots(docs, order, least, bits))
    names = [f"w{k}" for k in range(1, order + 1)]
    top = docs.mapInArrow(_windows(frequent, order, bits), "lead_window string, c bigint").groupBy("lead_window").agg(F.sum("c").alias("c"))
    # no word holds a line end or a blank
    words, lang = F.split(F.substring_index("lead_window", "\n", 1), " "), F.expr("substring(lead_window, locate('\n', lead_window) + 1)")
    top = top.select(lang.alias("lang"), *[F.coalesce(F.get(words, F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(names)], "c")
    summed = top.rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("level"))
    # level 2^j - 1: the last j columns are summed over; padding is no phrase
    size = F.when(F.col("level") == 0, order)
    for j in range(1, order + 1):
        size = size.when(F.col("level") == 2 ** j - 1, order - j)
    words = F.slice(F.array(*names), 1, F.col("size"))
    return (summed.where(F.col("level") < 2 ** (order + 1) - 1).withColumn("size", size).withColumn("words", words)
                  .where("size = 0 OR f >= " + str(int(least))).where(~F.array_contains("words", "")).select("lang", "words", "f"))


# --- collocations --------------------------------------------------------------------

def collocations(docs: DataFrame, order: int = 3, least: int = 10, cover: int = 50, top: int | None = 2000,
                 bits: int = SKETCH_BITS) -> DataFrame:
    """The best phrases of 2 to ``order`` words of each language (``top`` None: all).

    A phrase that occurs a >= ``least`` times is a candidate.  Each cut into a
    first part (l times) and a rest (r times) scores floor(10^6 a a / (l r)); the lowest
    counts, ties to the shortest first part.  A candidate inside a longer one
    with 100 f(longer) >= ``cover`` a is dropped.  Returns ``lang, rank, phrase, a, l, r, n,
    score``, ranked by score, count and phrase."""
    counts = phrase_counts(docs, order, least, bits)
    text = lambda c: F.array_join(c, " ")
    counts = stored(counts.select("lang", text(F.col("words")).alias("phrase"), F.size("words").alias("size"), "f"), "phrase-counts")
    known = counts.where(F.col("size").between(1, order - 1) & (F.col("f") >= least)).select("lang", "phrase", "f")
    found = counts.where("size >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = (found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
                 .withColumn("first", text(F.slice("words", 1, F.col("k")))).withColumn("rest", text(F.slice("words", F.col("k") + 1, F.size("words")))))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    cuts = cuts.withColumn("above", whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("below", whole("l") * whole("r"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    scored = (cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.*"))
    # the most frequent longer candidate around each shorter one
    inner = (found.where(F.size("words") > 2).withColumn("length", F.explode(F.expr("sequence(2, size(words) - 1)")))
                  .withColumn("at", F.explode(F.expr("sequence(1, size(words) - length + 1)")))
                  .select("lang", text(F.slice("words", F.col("at"), F.col("length"))).alias("phrase"), "a")
                  .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * cover, F.lit(True)))
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    order_by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    if top is not None:
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
        within = Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a"), "phrase")
        kept = kept.withColumn("part", part).withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(order_by))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return (ranked.join(F.broadcast(total), "lang")
                  .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


ORACLE_SQL = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM t),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS pos FROM p WHERE len(w) > 0),
g AS (SELECT lang, w[pos] AS w1, w[pos + 1] AS w2, w[pos + 2] AS w3 FROM i),
f1 AS (SELECT lang, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, w1 || ' ' || w2 AS phrase, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (SELECT f2.lang, f2.phrase, 1 AS k, f2.f AS a, x.f AS l, y.f AS r
         FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.phrase = w1 JOIN f1 y ON y.lang = f2.lang AND y.phrase = w2
         UNION ALL SELECT f3.lang, f3.phrase, 1, f3.f, x.f, y.f
         FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.phrase = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
         UNION ALL SELECT f3.lang, f3.phrase, 2, f3.f, x.f, y.f
         FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.phrase = f3.w3),
s AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM s),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase WHERE place = 1 AND (longer.f IS NULL OR 100 * longer.f < 50 * a)),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY ALL)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM k JOIN n ON n.lang = k.lang QUALIFY rank <= 2000
"""
