"""Operator 3 against all pairs, with hot groups."""

import random
from collections import Counter

import pytest

from conftest_llm import shingles
from corpuskit.llm import jaccard_join


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in range(len(rows)):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if x and 100 * x >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies(rng, base, n, start, edits=2):
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10 ** 6)}"
        out.append((start + k, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    passage = " ".join(f"pass{i}" for i in range(40))
    rows = []
    for k in range(120):  # texts that share a passage
        rows.append((1000 + k, f"{passage} " + " ".join(f"own{k}x{i}" for i in range(rng.choice([3, 10, 40, 80])))))
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(rng.choice([30, 60, 120]))]
        rows += near_copies(rng, base, rng.choice([3, 20, 150]), 2000 + 1000 * g, edits=3)
    # a chain: each links with the next only
    chain = [f"c{i}" for i in range(200)]
    rows += [(9000 + k, " ".join(chain[10 * k:10 * k + 80])) for k in range(12)]
    rng.shuffle(rows)
    return rows


def test_components_match_all_pairs(spark, table, corpus):
    got = jaccard_join.similar_groups(table(corpus).repartition(5)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(corpus)


def test_small_groups_and_no_known_frequencies(spark, table, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "QUERIES", 5)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)
    got = jaccard_join.similar_groups(table(corpus)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(corpus)


def test_odd_rows(spark, table, odd_rows):
    got = jaccard_join.similar_groups(table(odd_rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(odd_rows)


def test_one_id_with_several_texts(spark, table):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (5, a + " end"), (None, a + " x y"), (None, b + " z"), (7, "other text that stands alone here")]
    got = jaccard_join.similar_groups(table(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_boundary_of_the_threshold():
    import numpy as np
    a = np.arange(7, dtype=np.uint64)
    assert jaccard_join.linked(a, np.append(a[:6], np.uint64(99))) is (100 * 6 >= 75 * 8)
    assert not jaccard_join.linked(a, np.append(a[:5], np.array([98, 99], np.uint64)))
    assert not jaccard_join.linked(a[:0], a[:0])


def test_one_per_group(spark, table, corpus):
    out = jaccard_join.one_per_group(table(corpus))
    want = {c if n else d for d, n, c in brute(corpus)}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want) and out.columns == table([]).columns


def test_one_per_group_tells_rows_of_one_id_apart(spark, table, odd_rows):
    """One row of each component of texts, whatever ids the rows have."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = odd_rows + [(105, a), (108, a + " end"), (103, b), (105, b + " end"),  # 105 is not the least of b's group
                       (None, c), (None, c + " end"), (None, d), (None, "other text that stands alone here"),
                       (120, "one text of an id told twice"), (120, "and quite another text of it"), (120, "and quite another text of it")]
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.one_per_group(table(rows).repartition(3)).collect()), key=str)
    # by row number, no two rows share an id: the components as rows
    numbers = list(brute([(k, t) for k, (_, t) in enumerate(rows)]).elements())
    groups = {}
    for k, n, comp in numbers:
        groups.setdefault(comp if n else ("empty", k), []).append(rows[k])
    want = {key: min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for key, g in groups.items()}
    assert len(got) == len(groups)
    left = list(got)
    for key, g in groups.items():  # each group has one row left, of its smallest id
        mine = [r for r in left if r in g]
        assert len(mine) >= 1 and mine[0][0] == want[key]
        left.remove(mine[0])
    assert not left and {(105, a), (103, b), (None, d)} <= set(got)


def test_one_per_group_without_repeated_ids_but_nulls(spark, table):
    a = " ".join(f"a{i}" for i in range(60))
    got = jaccard_join.one_per_group(table([(None, a), (None, a + " end"), (4, "other text that stands alone here")])).collect()
    assert len(got) == 2 and {r.doc_id for r in got} == {None, 4}


def test_classes_of_a_frequent_token_are_spread():
    """No task gets all classes of a token of many near copies, and none is lost."""
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd
    import pyarrow as pa
    base = " ".join(f"w{i}" for i in range(40))
    texts = [f"{base} own{k}" for k in range(400)] + ["a text with words of its own alone"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(401)), "digest": pa.array(range(401)), "text": texts})
    seen = pa.Table.from_batches(list(jaccard_join._classes([batch]))).to_pandas()
    known = np.sort(seen.loc[seen["kind"] == 1, "number"].to_numpy(np.int64).view(np.uint64))
    run = lambda known: pa.Table.from_batches(list(jaccard_join._prefixes(
        SimpleNamespace(value=(known, np.full(len(known), 400))), 16)([batch, batch]))).to_pandas()
    parts = {p: jaccard_join._shared_tokens(pdf) for p, pdf in run(known).groupby("part")}
    sizes = [pdf.groupby("token").size().max() for pdf in parts.values() if len(pdf)]
    assert len(sizes) == 16 and max(sizes) < 100
    rows = lambda parts: sorted(map(tuple, pd.concat(parts).to_numpy().tolist()))
    got = rows(parts.values())
    assert len(got) == len(set(got)) and {t for t, _, _ in got} <= set(known.view(np.int64).tolist())
    # the same rows as by counting the classes of each token in one place
    order = run(known).groupby(lambda _: 0)
    assert got == rows([jaccard_join._shared_tokens(pdf.assign(hot=[bytes(len(x)) for x in pdf["hot"]])) for _, pdf in order])


def test_links_grow_with_the_group(spark, table, monkeypatch):
    """Texts with one edited word each: most do not link with most, yet all are one component."""
    seen = []
    real = jaccard_join.merged
    monkeypatch.setattr(jaccard_join, "merged", lambda comps, links: seen.append(links.count()) or real(comps, links))

    def links(n):
        base = [f"w{i}" for i in range(70)]
        rows = [(k, " ".join(base[:k % 70] + [f"edit{k}"] + base[k % 70 + 1:])) for k in range(n)]
        seen.clear()
        got = {r.component_id for r in jaccard_join.similar_groups(table(rows)).collect()}
        assert got == {0}
        return sum(seen)
    assert links(300) < 300 * 3 and links(900) < 900 * 3


def test_copies_too_far_apart_to_link_meet_no_groups(spark, table, monkeypatch):
    """Near copies of one text, most of which link with none: they are told apart by their
    differences, neither group by group nor with a reading of all texts per pass."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for k in range(700):
        w = list(base)
        for at in rng.sample(range(90), rng.choice([0, 1, 2, 4, 6])):
            w[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(w)))
    met, fetched = [], []
    stored, fetch = jaccard_join.stored, jaccard_join._fetch

    def counted(df, name):
        out = stored(df, name)
        if name == "query-groups":
            met.append(out.count())
        return out
    monkeypatch.setattr(jaccard_join, "stored", counted)
    monkeypatch.setattr(jaccard_join, "_fetch", lambda *a: fetched.append(1) or fetch(*a))
    got = jaccard_join.similar_groups(table(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert sum(met) < len(rows) and len(fetched) <= 2


def test_links_by_common_differences(spark, table, monkeypatch):
    """Clusters around one text, linked among themselves by edits that they share, not with it."""
    monkeypatch.setattr(jaccard_join, "QUERIES", 20)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join(base[:-1] + [f"end{k}"])) for k in range(60)]
    for g in range(8):
        w = list(base)
        for at in rng.sample(range(80), 5):
            w[at] = f"g{g}at{at}"
        rows += near_copies(rng, w, 12, 100 + 20 * g, edits=2)
    got = jaccard_join.similar_groups(table(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_empty_table(spark, table):
    assert jaccard_join.similar_groups(table([])).count() == 0
