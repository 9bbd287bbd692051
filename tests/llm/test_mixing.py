from collections import Counter, defaultdict
from fractions import Fraction
from heapq import heappop, heappush

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import mixing


sources = st.lists(st.tuples(st.integers(0, 400), st.one_of(st.floats(0, 5), st.just(0.0), st.just(1e308), st.just(5e-324))), min_size=1, max_size=6)


@given(sources)
@settings(max_examples=100)
def test_phases_place_every_block(sources):
    blocks, weights = [n for n, _ in sources], [w for _, w in sources]
    phases = mixing.plan_phases(blocks, weights, 50)
    placed, slot = Counter(), 0
    for p in phases:
        assert p["slot"] == slot and dict(zip(p["s"], p["first"], strict=True)) == {s: placed[s] for s in p["s"]}
        slot += sum(p["done"])
        placed.update(dict(zip(p["s"], p["done"], strict=True)))
    assert [placed[s] for s in range(len(blocks))] == blocks
    assert len(phases) <= len(blocks) + 2


@pytest.mark.parametrize("bad", [-1.0, float("nan"), float("inf")])
def test_odd_weights_are_refused(bad):
    with pytest.raises(ValueError):
        mixing.plan_phases([1, 1], [1.0, bad])


def check(spark, blocks, weights, stretch):
    """Every block once, gapless slots, and in the first phase every block within its window and every source less than a block from its target."""
    got = mixing.schedule(spark, mixing.plan_phases(blocks, weights, stretch)).collect()
    assert sorted(r.mix_slot for r in got) == list(range(sum(blocks)))
    assert Counter((r.s, r.mix_block) for r in got) == Counter((s, j) for s, n in enumerate(blocks) for j in range(n))
    total = sum(Fraction(w) for w in weights)
    share = [Fraction(w) / total if total else 0 for w in weights]
    done, slack = Counter(), Fraction(1, 10**6)
    on_target = [r for r in sorted(got, key=lambda r: r.mix_slot) if r.on_target]
    for r in sorted(got, key=lambda r: r.mix_slot):
        assert r.mix_block == done[r.s]
        done[r.s] += 1
    done.clear()
    for t, r in enumerate(on_target):
        assert r.mix_slot == t
        done[r.s] += 1
        assert all(abs(done[s] - share[s] * (t + 1)) < 1 + slack for s in range(len(blocks)) if share[s]), (t, blocks, weights)
    # The first phase lasts until a source can't keep to its target any more.
    if total:
        assert len(on_target) + 1 >= min(n / w for n, w in zip(blocks, share, strict=True) if n and w)
    return on_target


def test_schedules(spark):
    check(spark, [700, 90, 33, 500, 1], [0.5, 0.3, 0.05, 0.1, 0.05], 97)
    check(spark, [3000] * 3, [1, 1, 1], 64)
    check(spark, [4000, 9], [3000.0, 1.0], 16)
    check(spark, [5, 5], [0.0, 0.0], 16)
    check(spark, [3, 0, 4], [1e-300, 7.0, 1e300], 16)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 900), st.floats(0.01, 5)), min_size=1, max_size=7), st.integers(1, 60))
def test_schedules_of_any_weights(spark, sources, stretch):
    check(spark, [n for n, _ in sources], [w for _, w in sources], stretch)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(0.05, 1), min_size=2, max_size=5))
def test_against_one_long_run(spark, weights):
    """Deadlines hold in stretches as in a heap that runs through; blocks enough for many stretches."""
    n = 1500
    on_target = check(spark, [n] * len(weights), weights, 1)
    unit = mixing.shares(weights)
    total = sum(unit)
    heap, waiting, long_run = [], [(0, s, 0) for s in range(len(weights))], []
    for t in range(len(on_target)):
        while waiting and waiting[0][0] <= t:
            _, s, j = heappop(waiting)
            heappush(heap, (-(-(j + 1) * total // unit[s]), s, j))
        due, s, j = heappop(heap)
        assert due > t
        long_run.append(s)
        heappush(waiting, ((j + 1) * total // unit[s], s, j + 1))
    for t, r in enumerate(on_target):
        assert r.mix_block * total // unit[r.s] <= t < -(-(r.mix_block + 1) * total // unit[r.s])
    assert Counter(r.s for r in on_target).keys() == Counter(long_run).keys()


def test_rows(spark):
    rows = [(i, "a" if i % 3 else "b", "x" * (i % 50), 1) for i in range(3000)] + [(None, None, None, 1), (5, "a", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, parts int")
    got = mixing.mix(df, {"a": 1.0, "b": 1.0}, block_bytes=300, stretch=10).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[1]) for r in rows)
    by = defaultdict(set)
    for r in got:
        by[r.mix_slot].add((r.source, r.mix_block))
    assert all(len(x) == 1 for x in by.values()) and sorted(by) == list(range(len(by)))
    assert len({(r.mix_slot, r.mix_rank) for r in got}) == len(got)
    seen = Counter()
    for slot in sorted(by):
        (source, _), = by[slot]
        if not all(r.on_target for r in got if r.mix_slot == slot):
            break
        seen[source] += 1
        assert abs(seen["a"] - seen["b"]) <= 2
    assert mixing.mix(df.limit(0)).count() == 0
    clashing = df.selectExpr("doc_id", "source", "text", "9 as mix_slot", "8 as _part", "7 as _size", "6 as s")
    again = mixing.mix(clashing, {"a": 1.0, "b": 1.0}, block_bytes=300, stretch=10).collect()
    assert {(r.mix_slot, r["_part"], r["_size"], r.s) for r in again} == {(9, 8, 7, 6)}
    assert sorted(r["_mix_slot"] for r in again) == sorted(r.mix_slot for r in got)


def test_documents(spark):
    got = mixing.op8_pfair_mix(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == list(range(1000))
