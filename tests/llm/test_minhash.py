import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from tessella.llm import minhash
from tessella.llm.components import components

from .compare import agree


def brute(texts, k=3, percent=85):
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in texts}


def test_cases(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = {9: base, 4: base + " tail", 7: base.upper(), 30: base.replace("w30", "x"), 31: base.replace("w5 ", "y ").replace("w50", "z"), 1: None, 2: "", 3: " \n", 5: "A b", 6: "a B", 8: "a b c", 10: "a", 11: base.replace("w1 ", "q "), 12: "w1 " * 4000, 13: "w1 w1 w1"}
    rows = [(i, t, "x") for i, t in texts.items()]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == brute(texts)


def test_documents_against_brute_force(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    got = minhash.op2_minhash_forest(spark, "/root/testdata/sf0.001").collect()
    assert {tuple(r) for r in got} == brute(dict(zip(t["doc_id"], t["text"], strict=True)))


def check(spark, texts):
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == brute(texts)


def changed(words, at, mark):
    return [f"{mark}{i}" if i in at else w for i, w in enumerate(words)]


@pytest.fixture(params=[(64, 8192, 1024), (3, 20, 8)], ids=["whole", "cut"])
def sizes(request, monkeypatch):
    """Leaves, held rows and blocks as they are, and so small that regions exceed all three."""
    for name, value in zip(("LEAF", "HELD", "BLOCK"), request.param, strict=True):
        monkeypatch.setattr(minhash, name, value)


def test_crowded_regions(spark, sizes):
    base = [f"w{i}" for i in range(150)]
    check(spark, {i: " ".join([*base[: i % 150], f"u{i}", *base[i % 150 + 1 :]]) for i in range(200)})


def test_pairs_parted_by_longer_prefixes(spark, sizes):
    """Many pairs at 0.86 in crowded regions, which the longer prefixes cut between their ends."""
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for k in range(60):
        mine = changed(base, {(7 * k + d) % 120 for d in (0, 31, 62, 93)}, f"m{k}_")
        texts[2 * k], texts[2 * k + 1] = " ".join(mine), " ".join(changed(mine, {(7 * k + d) % 120 for d in (15, 46, 77)}, f"n{k}_"))
    check(spark, texts)


def test_bridges_between_tight_clusters(spark, sizes):
    """Clusters of near copies, two and two joined by a single pair at 0.852 whose ends have many nearer partners."""
    texts = {}
    for g in range(6):
        a = [f"g{g}w{i}" for i in range(400)]
        b = changed(a, set(range(20, 400, 39)), f"g{g}b")
        for at, base, tail in ((1000 * g, a, "s"), (1000 * g + 500, b, "t")):
            whole = [*base, *(f"g{g}{tail}{i}" for i in range(3))]
            texts[at] = " ".join(whole)
            texts[at + 499] = " ".join(whole[:-1])
            texts |= {at + k: " ".join(changed(whole, {5 * k + 3}, f"g{g}{tail}u{k}_")) for k in range(1, 60)}
    check(spark, texts)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70), (99, 50)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 99: 50, **{i: 200 for i in range(200, 260)}}


def test_groups_joined_only_across(spark, sizes):
    """Pairs of groups of near copies, at 0.99 inside and 0.867 across."""
    texts = {}
    for g in range(10):
        base = [f"g{g}w{i}" for i in range(300)]
        for side, whole in enumerate((base, changed(base, set(range(7, 300, 43)), f"g{g}x"))):
            texts |= {1000 * g + 500 * side + k: " ".join(changed(whole, {299 - k}, f"g{g}u{side}_{k}_")) for k in range(20)}
    check(spark, texts)


def test_dense_group_below_the_threshold(spark, sizes):
    """Every pair may reach the threshold by its estimate, none does: candidates of the first round stay linear."""
    base = [f"w{i}" for i in range(300)]
    check(spark, {k: " ".join(changed(base, set(range(k % 9, 300, 18)), f"m{k}_")) for k in range(120)})


def test_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (2, b), (9, a + " tail"), (None, a), (None, None), (7, c), (7, c), (8, ""), (8, "")]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, kept long")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 2, False), (2, 2, True), (9, 2, False), (None, None, True), (7, 7, True), (8, 8, True)}
    left = minhash.one_of_each(df, 3, 85)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(2, b), (None, a), (None, None), (7, c), (8, "")], key=repr)


def test_recall_on_all_pairs(spark):
    """10,000 documents: components against exact ones, by an index over rare shingles that misses no pair."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pydict()
    sets = {}
    for i, text in zip(t["doc_id"], t["text"], strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = frozenset(tuple(w[j : j + 3]) for j in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    by_set = defaultdict(list)
    for i, x in sets.items():
        if x:
            by_set[x].append(i)
    count = Counter(g for x in by_set for g in x)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    index = defaultdict(list)
    for x, ids in sorted(by_set.items(), key=lambda p: len(p[0])):
        for i in ids:
            join(ids[0], i)
        prefix = sorted(x, key=lambda g: (count[g], g))[: len(x) - -(-85 * len(x) // 100) + 1]
        for y in {id(y): y for g in prefix for y in index[g]}.values():
            if 100 * len(y) >= 85 * len(x):
                n = len(x & y)
                if 100 * n >= 85 * (len(x) + len(y) - n):
                    join(ids[0], by_set[y][0])
        for g in prefix:
            index[g].append(x)
    want = {i: find(i) for i in sets}
    got = {r.doc_id: r.component_id for r in minhash.op2_minhash_forest(spark, "/root/testdata/sf0.1").collect()}
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 500 and set(got) == set(want)
    assert sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked) and all(got[i] == i or find(got[i]) == find(i) for i in want)
    print("documents with a smaller one:", len(linked), "found:", sum(got[i] == want[i] for i in linked))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    agree(spark, minhash.op2_minhash_forest, minhash.ORACLE_SQL["op2_minhash_forest"], f"/root/testdata/{sf}")
