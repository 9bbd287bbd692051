import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from tessella.llm import shards


def whole(rows, n):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(n))
    for got in by.values():
        assert sorted(r.slot for r in got) == list(range(len(got)))
    return {s: sum(r.size for r in got) for s, got in by.items()}


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()
    texts = dict(zip(t["doc_id"], t["text"], strict=True))
    got = shards.op5_kd_shards(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode()))
        assert r.law == "bytes" and r.grown_shard is None
    size = whole(got, 24)
    mean, most = sum(size.values()) / 24, max(r.size for r in got)
    assert len(size) == 24 and all(abs(x - mean) <= 2 * most for x in size.values())


def test_copies_and_ties_are_balanced(spark):
    rows = [(i, "same text " * 20, "s", "en") for i in range(3000)] + [(5000 + i, f"text {i} " * 20, "s", "en") for i in range(3000)]
    size = whole(shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 7).collect(), 7)
    assert len(size) == 7 and max(size.values()) < 1.02 * min(size.values())


def test_odd_rows(spark):
    rows = [(1, None, None, None, 1, 2), (1, None, None, None, 1, 2), (None, "", "a", "b", 1, 2), (3, "x" * 500_000, "a", "b", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard int, node int")
    got = shards.kd_shards(df, 5).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, None: 1, 3: 1}
    whole(got, 5)
    assert shards.kd_shards(df.limit(0), 5).count() == 0
    assert {r.shard for r in shards.kd_shards(df, target_bytes=1 << 30).collect()} == {0}


def test_slots_follow_an_order(spark):
    df = spark.range(500).selectExpr("id as doc_id", "repeat('x', 50) as text", "'s' as source", "'l' as lang", "999 - id as place")
    got = shards.kd_shards(df, 3, order="place").collect()
    for s in range(3):
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.doc_id for r in mine] == sorted((r.doc_id for r in mine), reverse=True)


def test_clashing_names_are_kept(spark):
    df = spark.range(40).selectExpr("id as doc_id", "repeat('x', 50) as text", "'s' as source", "'l' as lang", "id as size", "7 as shard", "8 as node", "9 as _at", "id as place", "5 as k0")
    got = shards.kd_shards(df, 3, order="place", keep=tuple(c for c in df.columns if c != "doc_id")).collect()
    assert {(r.shard, r.node, r["_at"], r.k0, r["_size"]) for r in got} == {(7, 8, 9, 5, 58)} and {r.size for r in got} == set(range(40))
    assert {r["_shard"] for r in got} == {0, 1, 2} and len({(r["_shard"], r.slot) for r in got}) == 40


def brute(points, shards, dims):
    """The tree by sorting: (shard of each point)."""
    out = {}

    def cut(rows, k, first):
        if k == 1 or not rows:
            out.update({i: first for i, *_ in rows})
            return
        real = [(max(r[2 + d] for r in rows) - min(r[2 + d] for r in rows)) >> 42 for d in range(dims)]
        d = max(range(dims), key=lambda i: (real[i], -i))
        rows = sorted(rows, key=lambda r: r[2 + d])
        left, total = k // 2, sum(r[1] for r in rows)
        goal, before, n = total * left / k, 0, 0
        while n < len(rows) - 1 and before + rows[n][1] < goal:
            before += rows[n][1]
            n += 1
        n += before + rows[n][1] - goal < goal - before
        cut(rows[:n], left, first)
        cut(rows[n:], k - left, first + left)

    cut(points, shards, 0)
    return out


@pytest.mark.parametrize("cells", [256, 3])
def test_tree_against_sorting(spark, monkeypatch, cells):
    """With the driver's cuts alone, and with all but the first levels as tables."""
    monkeypatch.setattr(shards, "CELLS", cells)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id is not null").dropDuplicates(["doc_id"])
    points = [tuple(r) for r in shards._points(docs, None, []).select("doc_id", "size", "k0", "k1", "k2").collect()]
    got = shards.kd_shards(docs, 13, keep=("lang",)).collect()
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert {r.doc_id: r.shard for r in got} == brute(points, 13, 3) and all(r.lang == langs[r.doc_id] for r in got)
    whole(got, 13)


def test_more_shards_than_the_driver_cuts(spark, monkeypatch):
    monkeypatch.setattr(shards, "CELLS", 4)
    monkeypatch.setattr(shards, "BROADCAST_ROWS", 10)
    rows = [(i, f"text {i} " * 20, f"s{i % 3}", "en") for i in range(1500)] + [(9999, None, None, None)] * 3
    got = shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 40, keep=("source",)).collect()
    size = whole(got, 40)
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[2]) for r in rows)
    assert len(size) == 40 and max(size.values()) - min(size.values()) <= 4 * max(r.size for r in got)
