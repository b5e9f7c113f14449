"""Operators 4, 6 and 9 against brute force."""

import math
import re
import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest_llm import shingles_lower
from corpuskit.llm import decontaminate, sharding, stream_dedup


def dedup_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return Counter(out)


def test_dedup_matches_brute_force(spark, table, odd_rows):
    got = stream_dedup.dedup_table(table(odd_rows)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == dedup_brute(odd_rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in got}


def test_colliding_digests_are_told_apart(spark, table, odd_rows):
    weak = lambda c: F.substring(stream_dedup.sha256(c), 1, 1) if False else F.unhex(F.lpad(F.hex(F.length(c) % 2), 2, "0"))
    got = stream_dedup.deduplicate(table(odd_rows), digest=weak).collect()
    want = Counter((a, b, c) for (a, b, c, _), n in dedup_brute(odd_rows).items() for _ in range(n))
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len({re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in odd_rows})


def test_state_goes_on_where_it_stood(spark, table):
    from corpuskit.llm.common import prepare, shared_path
    prepare(spark)
    feed, state, check = (shared_path(spark, x) for x in ("feed", "state", "check"))
    stream_dedup.write_feed(table([(5, "a b"), (6, "c")]), feed)
    stream_dedup.run_stream(spark, feed, state, check)
    stream_dedup.write_feed(table([(4, "a  b"), (7, "d")]), feed)
    stream_dedup.run_stream(spark, feed, state, check)
    got = {r.keep_id: r.group_size for r in stream_dedup.current_state(spark, state).collect()}
    assert got == {4: 2, 6: 1, 7: 1}


def test_without_copies_keeps_one_row(spark, table, odd_rows):
    out = stream_dedup.without_copies(table(odd_rows))
    texts = [re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in out.collect()]
    assert sorted(texts) == sorted({re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in odd_rows})
    assert out.columns == table([]).columns


def test_shards(spark, table, odd_rows):
    got = sharding.shard_documents(table(odd_rows), [1.0] * 24).collect()
    assert len(got) == len(odd_rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
        draws = [-math.log((int(hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13)
                 for i in range(25)]
        assert r.shard == min(range(24), key=draws.__getitem__) and r.grown_shard == min(range(25), key=draws.__getitem__)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in odd_rows)


def test_weights_share_the_records(spark):
    df = sharding.assign(spark.range(20_000).withColumnRenamed("id", "k"), "k", [1.0, 2.0, 1.0])
    n = {r.shard: r["count"] for r in df.groupBy("shard").count().collect()}
    assert abs(n[1] / 20_000 - 0.5) < 0.02
    moved = df.where("shard != grown_shard")
    assert moved.where("grown_shard != 3").count() == 0 and abs(moved.count() / 20_000 - 0.2) < 0.02


ITEM = "the quick brown fox jumps over the lazy dog and then it runs far away from here"


@pytest.fixture()
def bench(spark):
    rows = [(0, ITEM), (1, "only three words"), (2, ""), (3, None), (4, "Another Item of exactly seven words, yes"), (5, "zz yy xx ww vv uu tt")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_contamination_matches_brute_force(spark, table, odd_rows, bench):
    w = ITEM.split()
    long_text = " ".join(f"f{i}" for i in range(3000))
    rows = odd_rows + [(20, long_text + " " + ITEM.upper() + " " + long_text), (21, "x " + " ".join(w[:14]) + " y"), (22, " ".join(w[:10])),
                       (23, "only three words"), (24, "so only three words more"), (25, "another item of exactly seven words, yes")]
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontaminate.contaminated(table(rows), bench).collect()}
    want = {}
    for d, t in rows:
        for r in bench.collect():
            a, b = shingles_lower(r.text), shingles_lower(t)
            if a and 100 * len(a & b) >= 75 * len(a):
                want[d, r.item_id] = (len(a), len(a & b))
    assert got == want and {(20, 0), (23, 1), (25, 4)} <= set(got)
    # the same without broadcasts
    old, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, -1
    try:
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(rows), bench).collect()} == set(want)
    finally:
        decontaminate.BROADCAST_ROWS = old
    clean = {r.doc_id for r in decontaminate.without_benchmark(table(rows), bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in want}


def test_stage_judges_each_row_by_its_own_text(spark, table, odd_rows, bench):
    """Rows without an id, or of one id, neither fall with another row nor add up to a match."""
    w = ITEM.split()
    rows = odd_rows + [(None, "y " + ITEM), (None, " ".join(w[:12]) + " p"), (None, "q " + " ".join(w[7:])), (None, "clean without an id"), (None, None),
                       (30, ITEM + " z"), (30, "a clean text under the same id"), (30, " ".join(w[:12])), (31, " ".join(w[:12])), (31, " ".join(w[7:]))]
    items = [s for r in bench.collect() if (s := shingles_lower(r.text))]
    want = [(d, t) for d, t in rows if not any(100 * len(i & shingles_lower(t)) >= 75 * len(i) for i in items)]
    assert len(want) == len(rows) - 2
    old = decontaminate.BROADCAST_ROWS
    try:
        for decontaminate.BROADCAST_ROWS in (old, -1):
            out = decontaminate.without_benchmark(table(rows), bench)
            assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want) and out.columns == table([]).columns
    finally:
        decontaminate.BROADCAST_ROWS = old


def test_native_plans_have_no_python(spark, table, odd_rows, bench):
    for df in (sharding.shard_documents(table(odd_rows), [1.0] * 3), stream_dedup.dedup_table(table(odd_rows)),
               decontaminate.contaminated(table(odd_rows), bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_empty_tables(spark, table, bench):
    empty = table([])
    assert stream_dedup.dedup_table(empty).count() == 0
    assert sharding.shard_documents(empty, [1.0, 1.0]).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(table([(1, ITEM)]), bench.limit(0)).count() == 0
