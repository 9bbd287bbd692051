import re
from collections import Counter
from itertools import accumulate
from math import log

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given
from hypothesis import strategies as st

from tessella.llm import decontaminate as D


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.integers(0, 40), st.integers(0, 2**64 - 1), st.integers(0, 2**30))
def test_index_finds_all_within_the_radius(stored, radius, query, flips):
    queries = [query, stored[0] ^ flips, stored[-1]]
    q, s, d = D.HammingIndex(np.array(stored, np.uint64), radius).within(np.array(queries, np.uint64))
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(queries) for j, b in enumerate(stored) if (a ^ b).bit_count() <= radius}
    assert set(zip(q.tolist(), s.tolist(), d.tolist(), strict=True)) == want


def fold(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=5):
    shingles = {}
    for x, (_, t) in enumerate(items):
        w = fold(t)
        if w:
            shingles[x] = (len(w), min(k, len(w)), w)
    grams = lambda w, n: [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]
    df = Counter(g for _, n, w in shingles.values() for g in set(grams(w, n)))
    weight = lambda g: log(1 + len(shingles) / df.get(g, 1)) if g in df else log(1 + len(shingles))
    out = {}
    for d, t in docs:
        words = fold(t)
        for x, (n, size, w) in shingles.items():
            i, b = items[x][0], Counter(grams(w, size))
            # Windows without any of the item's shingles have similarity 0.
            held = [0, *accumulate(g in b for g in grams(words, size))]
            for s in range(max(1, len(words) - n + 1)):
                if held[min(s + n - size + 1, len(held) - 1)] == held[min(s, len(held) - 1)]:
                    continue
                a = Counter(grams(words[s : s + n], size))
                top = sum(weight(g) * min(c, b[g]) for g, c in a.items() if g in b)
                if top:
                    got = top / (sum(weight(g) * c for g, c in a.items()) + sum(weight(g) * c for g, c in b.items()) - top)
                    if got >= 0.8 and got > out.get((d, i), 0):
                        out[d, i] = got
    return out


def test_cases(spark):
    item = " ".join(f"it{i}" for i in range(40))
    items = [(1, item), (2, None), (3, ""), (4, "tiny one here"), (5, item.replace("it20", "zz")), (1, item)]
    docs = [(1, "x y " + item + " z"), (2, item.upper().replace(" ", ", ")), (3, item.replace("it0 ", "q ")), (4, item.replace("it7 ", "q ").replace("it30 ", "r ")), (5, " ".join(item.split()[:25])), (6, None), (7, ""), (8, "a tiny, one here b"), (9, "w " * 30_000 + item), (10, item + " " + item), (11, " ".join(item.split()[2:]))]
    got = D.find_leaks(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == set(want)
    assert {r.doc_id for r in got} == {1, 2, 3, 8, 9, 10, 11}
    for r in got:
        text = dict(docs)[r.doc_id].encode()[r.begin_byte : r.end_byte].decode()
        assert len(fold(text)) == r.n_words
    kept = D.clean(spark.createDataFrame([(t, i, [1]) for i, t in docs], "text string, doc_id long, more array<int>"), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == ["text", "doc_id", "more"]
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {r.doc_id for r in got}


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (list(zip(*pq.read_table(f"{sf}/{t}.parquet", columns=c).to_pydict().values(), strict=True)) for t, c in (("documents", ["doc_id", "text"]), ("benchmark", ["item_id", "text"])))
    got = {(r.doc_id, r.item_id): r.similarity for r in D.op3_simhash_leaks(spark, sf).collect()}
    want = brute(docs, items)
    assert want and set(got) == set(want)
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_blocks_change_no_result(spark, monkeypatch):
    """One item a block, with shingles that several items share; one long text."""
    base = [f"it{i}" for i in range(30)]
    items = [(k, " ".join([*base[:15], *(f"x{k}_{i}" for i in range(15))])) for k in range(5)] + [(9, "tiny one here")]
    docs = [(k, " ".join(["lead", *t.split()[:-2], "tail"])) for k, t in items] + [(50, "w " * 60_000 + items[3][1]), (51, " ".join(base))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(tuple, D.find_leaks(*frames).collect()))
    monkeypatch.setattr(D.benchmark_blocks, "__defaults__", (200,))
    assert len(D.benchmark_blocks(frames[1])) > 1 and sorted(map(tuple, D.find_leaks(*frames).collect())) == once
    assert {x[:2] for x in once} == set(brute(docs, items)) and len(once) >= 6
    assert {r.doc_id for r in D.clean(*frames).collect()} == {d for d, _ in docs} - {x[0] for x in once}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert D.find_leaks(docs.limit(0), items).count() == 0 and D.find_leaks(docs, items.limit(0)).count() == 0
    assert D.clean(docs, items.limit(0)).count() == 1
