"""Alignment of two tokenisers by merge-path partitioning.

A is a byte-level vocabulary of the ``tokenizers`` library and encodes a blank and
the text; B is a ``sentencepiece`` model, which puts the blank there itself.  Special
tokens are neither added nor known inside texts.  A token covers the bytes that
it stands for: A's entry decoded, B's piece with U+2581 as a blank and ``<0xHH>`` as that byte.
A text that is null or empty, or whose joined bytes of A or B differ from blank +
text, has no tokens: all its numbers are 0 and its lists empty.

1. A block of texts becomes two rising lists of byte offsets where tokens of A and
   of B end (texts one behind the other, so that text borders are common ends).
2. Diagonal binary searches cut the merge of both lists into pieces of ``WORK``
   steps, however long a text is; each piece is merged by itself and emits its
   overlaps (an overlap of two tokens ends at exactly one end of either) and common ends.
3. The pieces' results are stitched: a group reaches from one common end to the next,
   across pieces.
4. An id pair's count is the number of texts that hold it linked.  Each block keeps its
   texts' distinct pairs packed; they are summed, and a pair's count and whether it is its
   A id's highest go back to the blocks: pairs in parts of about ``PART_PAIRS``, each part's
   table meets the blocks' cells of that part, which stream past it.

Repeated rows count each time.  An empty table gives an empty result.  Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, prepare, stored, text_blocks

#: Merge steps of a piece.
WORK = 1 << 15
#: Bytes of texts that make a block.
BLOCK_BYTES = 1 << 20
#: Pairs of a part's table in one task's memory.
PART_PAIRS = 1 << 20
#: Bytes of cells that stream past one copy of a part's table, and rows of the cells' answers.
CELL_BYTES = 64 << 20
#: Pairs that a task adds up before it hands them on.
FLUSH = 1 << 22
#: Text units whose ids a Python worker keeps.
CACHE_UNITS = 400_000

# --- both encodings, unit by unit ---------------------------------------------------

#: A blank or line end between two characters that are no white space begins a unit: A's
#: pattern starts a pre-token there in any context, and no piece of B goes across.
_UNITS = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S)(?=\n)")
_CODERS: dict = {}


class PairCoder:
    """Ids of A and B of whole texts, encoded unit by unit."""

    def __init__(self, path_a: str, path_b: str):
        import json
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        with open(path_a, encoding="utf-8") as f:
            pre = json.load(f).get("pre_tokenizer") or {}
        if not (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")):
            raise ValueError(f"{path_a}: unit by unit encoding is not proved for this pre-tokenizer")
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or self.b.encode("x\n y") != self.b.encode("x") + self.b.encode("\n y")[1:]:
            raise ValueError(f"{path_b}: unit by unit encoding is not proved for this model")
        letter = _byte_letters()
        size = max(self.a.get_vocab().values()) + 1
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id("▁")
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.kept: dict[str, tuple[bytes, bytes] | None] = {}

    def _encode(self, units: list[str]):
        """Ids of A and of B per unit, as bytes; None where bytes differ from the unit's."""
        a = self.a.encode_batch_fast(units, add_special_tokens=False)
        # B adds the blank that a unit begins with, or else one that goes again
        own = [u.startswith(" ") for u in units]
        b = self.b.encode([u[1:] if o else u for u, o in zip(units, own)], num_threads=1)
        for u, o, x, y in zip(units, own, a, b):
            if not o:
                y = y[1:] if y and y[0] == self.blank else None
            raw = u.encode()
            same = y is not None and b"".join([self.bytes_b[i] for i in y]) == raw and b"".join([self.bytes_a[i] for i in x.ids]) == raw
            yield (np.array(x.ids, "<u4").tobytes(), np.array(y, "<u4").tobytes()) if same else None

    def block(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and B of each text; None for a text without tokens."""
        cut = [_UNITS.split(" " + t) if t else [] for t in texts]
        kept = self.kept
        missing = list({u for units in cut for u in units if u not in kept})
        new = dict(zip(missing, self._encode(missing))) if missing else {}
        for u in missing[:max(CACHE_UNITS - len(kept), 0)]:
            kept[u] = new[u]
        get = lambda u: kept[u] if u in kept else new[u]
        out = []
        for units in cut:
            got = [get(u) for u in units]
            out.append(None if not got or None in got else (b"".join([x for x, _ in got]), b"".join([y for _, y in got])))
        return out


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1
    as itself, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def coder(path_a: str, path_b: str) -> PairCoder:
    if (path_a, path_b) not in _CODERS:
        _CODERS[path_a, path_b] = PairCoder(path_a, path_b)
    return _CODERS[path_a, path_b]


# --- merge path ----------------------------------------------------------------------

def merge_cuts(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where to cut the rising lists ``a`` and ``b`` so that their merge falls into pieces
    of ``work`` steps: for each diagonal i + j = d, a binary search along it (all
    diagonals at once).  Equal ends stay in one piece."""
    d = np.arange(0, len(a) + len(b), work, dtype=np.int64)
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        i = (low + high) // 2
        # a[i] comes before b[d - i - 1]: the cut lies behind i
        behind = open_ & (a[np.minimum(i, len(a) - 1)] <= b[np.clip(d - i - 1, 0, len(b) - 1)])
        low, high = np.where(behind, i + 1, low), np.where(open_ & ~behind, i, high)
    i, j = low, d - low
    tie = (i > 0) & (j < len(b))
    tie &= a[np.maximum(i - 1, 0)] == b[np.minimum(j, len(b) - 1)]
    return np.append(i, len(a)), np.append(j + tie, len(b))


def merge_piece(a: np.ndarray, b: np.ndarray, i: int, j: int, i_end: int, j_end: int):
    """Overlaps that end in a piece, as token numbers of A and B, and its common ends."""
    x, y = a[i:i_end], b[j:j_end]
    common = x[np.isin(x, y, assume_unique=True)]
    ends = np.union1d(x, y)
    # the token that covers the byte before an end; past the piece it is the next one
    return i + np.searchsorted(x, ends), j + np.searchsorted(y, ends), common


def align(a: np.ndarray, b: np.ndarray, work: int = WORK):
    """Overlaps of tokens that end at ``a`` and ``b`` (rising, with the same last end), by
    number, and the group of each token."""
    if not len(a):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    i, j = merge_cuts(a, b, work)
    pieces = [merge_piece(a, b, *cut) for cut in zip(i[:-1], j[:-1], i[1:], j[1:])]
    link_a, link_b, common = (np.concatenate(x) for x in zip(*pieces))
    return link_a, link_b, common, np.searchsorted(common, a), np.searchsorted(common, b)


# --- a block of texts ------------------------------------------------------------------

def _group_text(ids_a, ids_b, group_a, group_b) -> bytes:
    """``a1,a2|b1;a3|b2,b3`` of one or more texts; a text begins with a semicolon."""
    at_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")
    at_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
    n = len(ids_a) + len(ids_b)
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    mark[at_a[np.append(True, np.diff(group_a) > 0)]] = ord(";")
    mark[at_b[np.append(True, np.diff(group_b) > 0)]] = ord("|")
    width = len(str(int(ids.max())))
    powers = 10 ** np.arange(width - 1, -1, -1)
    cells = np.empty((n, width + 1), np.uint8)
    cells[:, 0] = mark
    cells[:, 1:] = ids[:, None] // powers % 10 + 48
    shown = np.ones((n, width + 1), bool)
    shown[:, 1:-1] = ids[:, None] >= powers[:-1]
    return cells[shown].tobytes(), np.append(0, np.cumsum(shown.sum(1))), at_a


BLOCK = ("block string, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
         "groups_sha256 array<string>, pairs binary, times binary, first array<bigint>")


def _blocks(path_a: str, path_b: str, base: int):
    """Blocks of texts with their numbers, and each text's distinct id pairs (``a * base +
    b``) and how often it holds each."""
    def run(batches):
        import uuid

        import pyarrow as pa
        enc = coder(path_a, path_b)
        for part, _, _ in text_blocks(batches, "text", BLOCK_BYTES):
            got = enc.block(part.column("text").to_pylist())
            join = lambda k: np.frombuffer(b"".join([g[k] for g in got if g]), "<u4").astype(np.int64)  # noqa: E731,B023
            n_a, n_b = (np.array([len(g[k]) // 4 if g else 0 for g in got], np.int64) for k in (0, 1))
            ids_a, ids_b = join(0), join(1)
            first_a, first_b = (np.append(0, np.cumsum(n)) for n in (n_a, n_b))
            link_a, link_b, common, group_a, group_b = align(np.cumsum(enc.len_a[ids_a]), np.cumsum(enc.len_b[ids_b]))
            text_of = np.searchsorted(first_a, link_a, "right") - 1
            n_links = np.bincount(text_of, minlength=len(got))
            full = np.flatnonzero(n_a)
            n_groups = np.zeros(len(got), np.int64)
            shas = [""] * len(got)
            if len(full):
                n_groups[full] = group_a[first_a[full + 1] - 1] - group_a[first_a[full]] + 1
                text, at, at_a = _group_text(ids_a, ids_b, group_a, group_b)
                begin = at[at_a[first_a[full]]]
                for t, lo, hi in zip(full, begin, np.append(begin[1:], len(text))):
                    shas[t] = hashlib.sha256(memoryview(text)[lo + 1:hi]).hexdigest()
            pair = ids_a[link_a] * base + ids_b[link_b]
            order = np.lexsort((pair, text_of))
            pair, text_of = pair[order], text_of[order]
            new = np.append(True, (pair[1:] != pair[:-1]) | (text_of[1:] != text_of[:-1])) if len(pair) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            times = np.diff(np.append(starts, len(pair)))
            first = np.searchsorted(text_of[starts], np.arange(len(got) + 1))
            one = lambda x: pa.array([x], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([uuid.uuid4().hex]), "doc_id": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), "n_a": one(n_a), "n_b": one(n_b), "n_groups": one(n_groups),
                "n_links": one(n_links), "groups_sha256": pa.array([shas]), "pairs": pa.array([pair[starts].astype("<i8").tobytes()], pa.binary()),
                "times": pa.array([times.astype("<i4").tobytes()], pa.binary()), "first": one(first)})
    return run


# --- counts of the pairs ----------------------------------------------------------------

def _count_pairs(batches):
    """Pairs with the number of texts that hold them, added up per task."""
    import pyarrow as pa

    def rows(held):
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        for k in range(0, len(pair), 100_000):
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pair[k:k + 100_000], pa.int64()), "n": pa.array(n[k:k + 100_000].astype(np.int64))})
    held, size = [], 0
    for batch in batches:
        for raw in batch.column("pairs"):
            held.append(np.frombuffer(raw.as_buffer(), "<i8"))
            size += len(held[-1])
            if size >= FLUSH:
                yield from rows(held)
                held, size = [], 0
    if held:
        yield from rows(held)


def pair_counts(blocks: DataFrame, base: int) -> DataFrame:
    """``pair, n, best``: the texts that hold a pair, and whether no pair of the same A id
    is in more."""
    counts = stored(blocks.select("pairs").mapInArrow(_count_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / base)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
    return counts.withColumn("a", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


TABLE = "part int, pairs binary, n binary, best binary"
CELL = "part int, block string, pairs binary, times binary, first binary"


def _pack_table(pdf):
    import pandas as pd
    pdf = pdf.sort_values("pair")
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "pairs": [pdf["pair"].to_numpy("<i8").tobytes()], "n": [pdf["n"].to_numpy("<i8").tobytes()],
                         "best": [pdf["best"].to_numpy(bool).tobytes()]})


def _part(pair: np.ndarray, parts: int) -> np.ndarray:
    return pair % parts


def _cells(parts: int):
    """A block's pairs, a row for each part."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for row in batch.to_pylist():
                pair, times, first = np.frombuffer(row["pairs"], "<i8"), np.frombuffer(row["times"], "<i4"), np.array(row["first"])
                part = _part(pair, parts)
                for p in range(parts):
                    at = np.flatnonzero(part == p) if parts > 1 else np.arange(len(pair))
                    yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "block": [row["block"]], "pairs": pa.array([pair[at].tobytes()], pa.binary()),
                                                      "times": pa.array([times[at].tobytes()], pa.binary()), "first": pa.array([np.searchsorted(at, first).astype("<i8").tobytes()], pa.binary())})
    return run


ANSWER = "block string, n_best binary, count_sum binary"


def _answer(batches):
    """For each cell its texts' sums; a part's table comes before its cells."""
    import pyarrow as pa
    key = None
    for batch in batches:
        for row in batch.to_pylist():
            if not row["is_cell"]:
                key = row["part"], row["salt"]
                table, n, best = np.frombuffer(row["pairs"], "<i8"), np.frombuffer(row["n"], "<i8"), np.frombuffer(row["best"], bool)
                continue
            pair = np.frombuffer(row["pairs"], "<i8")
            if key != (row["part"], row["salt"]):
                if len(pair):
                    raise ValueError("cells without their table")
                table, n, best = pair, pair, pair  # no text has a token
            times, first = np.frombuffer(row["times"], "<i4").astype(np.int64), np.frombuffer(row["first"], "<i8")
            at = np.searchsorted(table, pair)
            sums = [np.diff(np.append(0, np.cumsum(x * times))[first]) for x in (best[at], n[at])]
            yield pa.RecordBatch.from_pydict({"block": [row["block"]], "n_best": pa.array([sums[0].tobytes()], pa.binary()), "count_sum": pa.array([sums[1].tobytes()], pa.binary())})


OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _finish(left, right):
    """The texts of a block, with the sums of its parts' answers."""
    import pandas as pd
    block = left.iloc[0]
    total = lambda c: np.sum([np.frombuffer(x, "<i8") for x in right[c]], axis=0)
    return pd.DataFrame({c: block[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                        | {"doc_id": pd.array([None if pd.isna(x) else int(x) for x in block["doc_id"]], "Int64"), "n_best": total("n_best"), "count_sum": total("count_sum")})[
        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]]


def alignment(docs: DataFrame, path_a: str, path_b: str, part_pairs: int = PART_PAIRS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """A row for each row of ``docs``: its numbers of tokens, groups and links, how many links
    are their A id's most frequent pair, the links' counts added up, and its groups' digest."""
    prepare(docs.sparkSession)
    base = coder(path_a, path_b).b.get_piece_size()
    blocks = stored(id_text(docs).mapInArrow(_blocks(path_a, path_b, base), BLOCK), "aligned-blocks")
    counts = stored(pair_counts(blocks, base), "best-pairs")
    size, cells_size = counts.count(), blocks.select(F.sum(F.octet_length("pairs"))).first()[0] or 0
    parts = max(1, -(-size // part_pairs))
    salts = max(1, -(-cells_size // (parts * cell_bytes)))
    table = (counts.withColumn("part", F.pmod("pair", F.lit(parts)).cast("int")).groupBy("part").applyInPandas(_pack_table, TABLE)
                   .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    cells = blocks.select("block", "pairs", "times", "first").mapInArrow(_cells(parts), CELL).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    none = F.lit(None).cast("binary")
    both = (table.select("part", "salt", F.lit(False).alias("is_cell"), F.lit("").alias("block"), "pairs", "n", "best", none.alias("times"), none.alias("first"))
                 .unionByName(cells.select("part", "salt", F.lit(True).alias("is_cell"), "block", "pairs", none.alias("n"), none.alias("best"), "times", "first")))
    met = both.repartition("part", "salt").sortWithinPartitions("part", "salt", "is_cell")
    answers = met.mapInArrow(_answer, ANSWER)
    heads = blocks.drop("pairs", "times", "first")
    return heads.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_finish, OUT)
