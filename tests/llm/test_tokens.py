"""Operators 1, 7 and 10 against the tokenizers library itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuskit.llm import packing, token_counts, token_files
from corpuskit.llm.common import shared_path
from corpuskit.llm.tokenizing import coder

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_encode_as_whole_texts(library, path):
    rng = random.Random(3)
    parts = list("aB'é. ,\n\t1$ſ½ñ́ 中 \x1c\x85s!") + ["'s", " the", "  ", "\r\n", "😀", "İ", "Σ", "<|endoftext|>", "<|", "#12"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None]
    got = [np.frombuffer(x, "<u4").tolist() for x in coder(path).encode(texts)]
    assert got == [ids_of(library[path], t) for t in texts]


def test_cache_overflow_keeps_ids(library, monkeypatch):
    from corpuskit.llm import tokenizing
    monkeypatch.setattr(tokenizing, "CACHE_PIECES", 5)
    c = tokenizing.PieceCoder(BYTE, True)
    texts = [f"some words {i} and more" for i in range(50)]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == [ids_of(library[BYTE], t) for t in texts]


def test_token_files_round_trip(spark, table, odd_rows, library):
    df = table(odd_rows)
    manifest = token_files.write_token_files(df, shared_path(spark, "t"), BYTE, end_id=2, file_bytes=60_000)
    assert manifest.count() > 1
    got = token_files.read_token_files(manifest).collect()
    want = Counter((i, tuple([*ids_of(library[BYTE], t), 2])) for i, t in odd_rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_reader_decompresses_only_requested_frames(tmp_path):
    path = str(tmp_path / "x.zst")
    with open(path, "wb") as f:
        w = token_files.TokenFileWriter(f, 4, frame_bytes=400)
        for i in range(100):
            w.add(i, np.arange(i, dtype=np.uint32))
        w.close()
    file = token_files.TokenFile(path, 4)
    opened = []
    real = file.frame
    file.frame = lambda k: opened.append(k) or real(k)
    assert [(i, x.tolist()) for _, i, x in file.rows([7, 90])] == [(7, list(range(7))), (90, list(range(90)))]
    assert len(opened) == 2 and file.n_frames > 10
    raw = bytearray(open(path, "rb").read())
    raw[int(file.at[opened[1]]) + int(file.packed[opened[1]]) - 2] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        list(token_files.TokenFile(path, 4).rows([90]))


def test_counts_use_and_grow_the_cache(spark, table, odd_rows, library):
    cache = shared_path(spark, "cache")
    first = token_counts.cached_counts(table(odd_rows[:6]), BYTE, cache).collect()
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == len({t or "" for _, t in odd_rows[:6]})
    got = token_counts.cached_counts(table(odd_rows), BYTE, cache).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(
        (i, len((t or "").encode()), len(ids_of(library[BYTE], t))) for i, t in odd_rows)
    assert len(first) == 6
    # every content once, but for repeated rows of one id
    assert spark.read.parquet(cache).select("content_digest").distinct().count() == len({t or "" for _, t in odd_rows})


def test_stored_counts_are_used(spark, table):
    import hashlib
    cache = shared_path(spark, "cache")
    row = (token_counts.tokenizer_digest(BYTE), bytearray(hashlib.sha256(b"hello there").digest()), 11, 4321)
    spark.createDataFrame([row], token_counts.CACHE_SCHEMA).write.parquet(cache)
    assert token_counts.cached_counts(table([(1, "hello there")]), BYTE, cache).first().n_tokens == 4321


def check_packing(rows, room, library, docs):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= room
    want = Counter()
    for i, t in docs:
        x = [*ids_of(library[WORD], t), 0]
        for k, a in enumerate(range(0, len(x), room)):
            p = x[a:a + room]
            want[i, k, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by_seq)


def test_packing_is_gapless_and_whole(spark, table, odd_rows, library):
    rows = packing.pack_documents(table(odd_rows), WORD, 0, 256).collect()
    check_packing(rows, 256, library, odd_rows)


def test_tree_of_nodes_packs_tightly(spark):
    rng = random.Random(5)
    sizes = [rng.randint(1, 100) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item bigint, length bigint")
    out = packing.pack(items, 100, leaf_items=100).collect()
    assert Counter(r.item for r in out) == Counter(range(3000))
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for xs in used.values():
        at = 0
        for o, n in sorted(xs):
            assert o == at
            at += n
        assert at <= 100
    # leaves of a hundred items are far below the default; bins merge up the tree
    assert len(used) <= 1.06 * -(-sum(sizes) // 100)
    assert any(s >> 56 for s in used)


def test_best_fit_prefers_the_fullest_bin():
    bins, offsets, used = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8] and used == [10, 10]


def test_empty_tables(spark, table):
    empty = table([])
    manifest = token_files.write_token_files(empty, shared_path(spark, "t"), BYTE, 2)
    assert token_files.read_token_files(manifest).count() == 0
    assert token_counts.count_query(spark, empty, BYTE).count() == 0
    assert packing.pack_documents(empty, WORD).count() == 0
