"""Operator 11 against plain merging of whole-text encodings."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuskit.llm import alignment


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers as p
    return p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")


def spans(ids, sizes):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + sizes[i]))
        at += sizes[i]
    return out


def whole(paths, text):
    """Ids and bytes of both encodings of a whole text by the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer
    enc = alignment.coder(*paths)
    t = Tokenizer.from_file(paths[0])
    t.encode_special_tokens = True
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1]).encode(text)
    want = (" " + text).encode()
    if not text or b"".join(enc.bytes_a[i] for i in a) != want or b"".join(enc.bytes_b[i] for i in b) != want:
        return [], []
    return a, b


def brute(paths, rows):
    enc = alignment.coder(*paths)
    docs, count = [], Counter()
    for i, text in rows:
        a, b = whole(paths, text or "")
        sa, sb = spans(a, enc.len_a), spans(b, enc.len_b)
        links, k = [], 0
        for x, lo, hi in sa:
            while k < len(sb) and sb[k][2] <= lo:
                k += 1
            m = k
            while m < len(sb) and sb[m][1] < hi:
                links.append((x, sb[m][0]))
                m += 1
        common = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        groups, low = [], 0
        for end in common:
            groups.append(",".join(str(x) for x, _, e in sa if low < e <= end) + "|" + ",".join(str(y) for y, _, e in sb if low < e <= end)) if len(sa) < 3000 else groups.append(end)
            low = end
        count.update(set(links))
        docs.append((i, len(a), len(b), len(common), links, groups))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, n_a, n_b, n_groups, links, groups in docs:
        sha = "" if not n_a else hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a < 3000 else None
        out.append((i, n_a, n_b, n_groups, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha))
    return out


ODD = [(20, "plain <|endoftext|> words <s> and <0x0A> é ﬁ ½ 　x"), (21, "a▁b"), (22, "  two  blanks  "), (23, "\n\nline\n \nends\r\n\tthe end\n"),
       (24, "antidisestablishmentarianism Donaudampfschifffahrtsgesellschaft 12345678901 ...!!!???"), (25, "日本語 текст 🙂🙂 \x00\x1c x"),
       (26, "it's we'll I'd"), (27, " x y \x85z"), (28, " x"), (29, "\n")]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r[:7]))


@pytest.mark.parametrize("small", [False, True])
def test_alignment_matches_brute_force(spark, table, odd_rows, paths, small, monkeypatch):
    if small:  # several blocks, parts and copies of a part's table
        monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)
    rows = odd_rows + ODD
    kw = {"part_pairs": 300, "cell_bytes": 5_000} if small else {}
    got = key([tuple(r) for r in alignment.alignment(table(rows), *paths, **kw).collect()])
    want = key(brute(paths, rows))
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert [g[7] for g, w in zip(got, want) if w[7] is not None] == [w[7] for w in want if w[7] is not None]
    assert any(w[7] is None for w in want)


def test_groups_of_long_texts(paths):
    """The digest's text, against plain joining."""
    enc = alignment.coder(*paths)
    text = " ".join(f"word{i} Näch{i % 7}ste" for i in range(3000))
    a, b = whole(paths, text)
    end_a, end_b = np.cumsum(enc.len_a[a]), np.cumsum(enc.len_b[b])
    for work in (7, 1000, 1 << 15):
        link_a, link_b, common, group_a, group_b = alignment.align(end_a, end_b, work)
        assert len(link_a) == len(set(end_a) | set(end_b)) and set(common) == set(end_a) & set(end_b)
        made = alignment._group_text(np.array(a), np.array(b), group_a, group_b)[0]
        groups = defaultdict(lambda: ([], []))
        for side, ids, group in ((0, a, group_a), (1, b, group_b)):
            for i, g in zip(ids, group):
                groups[g][side].append(str(i))
        assert made == (";" + ";".join(",".join(x) + "|" + ",".join(y) for _, (x, y) in sorted(groups.items()))).encode()


def test_merge_pieces_cover_the_merge():
    rng = np.random.default_rng(1)
    for _ in range(200):
        last = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, last + 1, rng.integers(0, 40)), last)) for _ in range(2))
        work = int(rng.integers(1, 12))
        i, j = alignment.merge_cuts(a, b, work)
        assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
        assert (np.diff(i) + np.diff(j) <= work + 1).all()
        link_a, link_b, common, _, _ = alignment.align(a, b, work)
        start_a, start_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if max(start_a[x], start_b[y]) < min(a[x], b[y])]
        assert sorted(zip(link_a.tolist(), link_b.tolist())) == want
        assert common.tolist() == sorted(set(a) & set(b))


def test_units_give_the_ids_of_whole_texts(spark, paths):
    enc = alignment.coder(*paths)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r.text or "" for r in rows]
    for text, got in zip(texts, enc.block(texts)):
        a, b = whole(paths, text)
        assert ([], []) == (a, b) if got is None else (np.frombuffer(got[0], "<u4").tolist(), np.frombuffer(got[1], "<u4").tolist()) == (a, b)


def test_empty_table(spark, table, paths):
    assert alignment.alignment(table([]), *paths).collect() == []
    assert [tuple(r) for r in alignment.alignment(table([(1, None)]), *paths).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
