"""Operator 2: near duplicates by MinHash and an LSH forest.

1. Every document becomes the set of its distinct word shingles (64-bit hashes) and a signature of
   ``HASHES`` minimum hashes.  Documents with equal sets form a class with one representative.
2. ``TREES`` sorted orders: order t sorts representatives by the signature rotated by its own offset.
   Representatives whose rotated signatures share at least ``DEPTH`` leading values form a region.
   Where a region is crowded its depth adapts, branch by branch: it is cut at the longer common prefixes of
   neighbours into leaves of ``LEAF`` members at most.
3. First round: candidates are a spanning forest of the likeliest pairs of each leaf and the neighbours in sorted order, those
   with the longest common prefixes, across leaves: at most two pairs a member and order, however large the region.
   They are verified on the full sets; links join components.
4. Second round: regions that the first one may not have exhausted, and which still hold several components, are compared whole,
   block against block in separate tasks, whatever their size.  A member that may reach the threshold with one of another component is
   sent on with its full set, and the block's task verifies all such pairs of different components and emits the links
   that join some.  So no pair that shares a region and may reach the threshold is left out, unless its ends are joined already.

Only representatives in regions of two or more carry signatures, only documents in a candidate
carry sets, and no step gathers a class, a component or the fingerprints of all documents in one place.
With 128 hashes and 16 orders of depth 4, a pair of similarity 0.85 shares no region with a chance of 1e-5,
and its estimate falls below the threshold less ``SLACK`` with one of about 2e-4.

Nulls and texts without words: an empty set, linked with nothing, kept.  Texts with fewer words
than a shingle: the whole sequence is the one shingle.  Rows with the same id are one document: they are linked, by whichever of their texts.
Rows with a null id are linked with nothing and kept.  Empty tables give no rows.  Clashing extra columns are ignored: only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import store, words
from tessella.llm.components import components

HASHES, TREES, DEPTH = 128, 16, 4
#: Members of a leaf; rows of a region that a task holds in the first round; load of a block (a member counts 1, or its shingles by ``LOAD``, if that is more).
LEAF, HELD, BLOCK, LOAD = 64, 8192, 1024, 1000
SLACK = 0.11
_MULT = np.random.default_rng(5).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, sig binary"


def shingle_sets(run: words.Run, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents of a run, and where each document's begin."""
    grams, whole = run.grams(k)
    owner = run.owner()
    count = np.diff(run.bounds)
    short = np.flatnonzero((count > 0) & (count < k))
    hashes, owners = grams[whole], owner[whole]
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for x, d in enumerate(short):
            acc = np.uint64(count[d])
            with np.errstate(over="ignore"):
                for h in run.hash[run.bounds[d] : run.bounds[d + 1]]:
                    acc = acc * np.uint64(0xD6E8FEB86659FD93) + h
            extra[x] = acc
        hashes, owners = np.concatenate([hashes, words.mix(extra)]), np.concatenate([owners, short])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        hashes, owners = hashes[new], owners[new]
    return hashes, np.searchsorted(owners, np.arange(len(run) + 1))


def _signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """uint32[documents, HASHES]; rows of empty sets are zero."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, HASHES), np.uint32)
    if len(full):
        for j in range(HASHES):
            x = hashes * _MULT[j]
            out[full, j] = np.minimum.reduceat(x, bounds[full]) >> np.uint64(32)
    return out


def _sign(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in words.runs(batch.column(1), table=words.FOLDED):
                hashes, bounds = shingle_sets(run, k)
                n = np.diff(bounds)
                sig = _signatures(hashes, bounds)
                total = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(words.mix(hashes ^ np.uint64(0x5555555555555555)), out=total[1:])
                h1 = total[bounds[1:]] - total[bounds[:-1]]
                np.cumsum(words.mix(hashes + np.uint64(0x1234567890ABCDEF)), out=total[1:])
                h2 = total[bounds[1:]] - total[bounds[:-1]]
                rows = batch.slice(run.first, len(run))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return sign


def _sets(k: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in words.runs(batch.column(1), table=words.FOLDED):
                hashes, bounds = shingle_sets(run, k)
                rows = batch.slice(run.first, len(run))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], ["doc_id", "set"])

    return build


def _leaves(sig: np.ndarray, lcp: np.ndarray, leaf: int) -> list[tuple[int, int]]:
    """Cuts a sorted region of more than ``leaf`` members into leaves: where a branch of the prefix tree is crowded, its
    depth grows by as many values as its members share, until its branches aren't; equal signatures go in runs."""
    out, todo = [], [(0, len(sig))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            out.append((lo, hi))
            continue
        inner = lcp[lo + 1 : hi]
        shared = int(inner.min())
        at = np.arange(lo + leaf, hi, leaf) if shared >= HASHES else lo + 1 + np.flatnonzero(inner == shared)
        todo += zip([lo, *at.tolist()], [*at.tolist(), hi], strict=True)
    return out


def _forest(est: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The pairs (i, j) of a maximum spanning forest of the kept pairs, by estimate, and how many kept pairs it leaves out."""
    i, j = np.nonzero(keep)
    order = np.argsort(-est[i, j], kind="stable")
    root, used = list(range(len(est))), []
    for x in order.tolist():
        a, b = _find(root, int(i[x])), _find(root, int(j[x]))
        if a != b:
            root[a] = b
            used.append(x)
    return i[used], j[used], len(i) - len(used)


def _find(root, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _signatures_of(column: pa.Array) -> np.ndarray:
    """uint32[rows, HASHES] of a binary column of whole signatures."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)
    start = int(offsets[column.offset])
    body = np.frombuffer(column.buffers()[2], np.uint8)[start : start + 4 * HASHES * len(column)]
    return body.view(np.uint32).reshape(len(column), HASHES)


def _candidates_of(percent: int):
    """Over rows (region, doc_id, n_shingles, turned) sorted by region and turned signature: pairs (a, b), at most two per
    row, and the numbers of regions that these may not exhaust."""
    least, leaf, most = int((percent / 100 - SLACK) * HASHES), LEAF, HELD

    def region_pairs(ids: np.ndarray, n: np.ndarray, sig: np.ndarray, alike: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """``alike[i]``, ``lcp[i]``: equal values and leading equal values of i and i - 1."""
        leaves = [(0, len(ids))] if len(ids) <= leaf else _leaves(sig, lcp, leaf)
        left, right, rest, leaf_of = [], [], len(leaves) > 1, np.zeros(len(ids), np.int64)
        for lo, hi in leaves:
            leaf_of[lo:hi] = lo
            if hi - lo < 2:
                continue
            s, m = sig[lo:hi], n[lo:hi]
            est = (s[:, None] == s[None]).sum(2)
            keep = np.triu((est >= least) & _sizes_allow(m[:, None], m[None], percent), 1)
            i, j, out = _forest(est, keep)
            left.append(lo + i)
            right.append(lo + j)
            rest = rest or out > 0
        # Neighbours in sorted order that stand in different leaves.
        x = np.flatnonzero((leaf_of[1:] != leaf_of[:-1]) & (alike[1:] >= least) & _sizes_allow(n[1:], n[:-1], percent))
        return np.concatenate([*left, x]).astype(np.int64), np.concatenate([*right, x + 1]).astype(np.int64), rest

    def compared(region: np.ndarray, ids: np.ndarray, n: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(region):
            return
        same = sig[1:] == sig[:-1]
        alike = np.concatenate([[0], same.sum(1)])
        lcp = np.concatenate([[0], np.where(same.all(1), HASHES, (~same).argmax(1))])
        bounds = np.concatenate([[0], np.flatnonzero(region[1:] != region[:-1]) + 1, [len(region)]])
        size = np.diff(bounds)
        # Regions of two: their one pair is that of neighbours.
        x = bounds[:-1][size == 2]
        x = x[(alike[x + 1] >= least) & _sizes_allow(n[x], n[x + 1], percent)]
        a, b, marks = [ids[x]], [ids[x + 1]], []
        for lo, hi in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist(), strict=True):
            i, j, rest = region_pairs(ids[lo:hi], n[lo:hi], sig[lo:hi], alike[lo:hi], lcp[lo:hi])
            a.append(ids[lo + i])
            b.append(ids[lo + j])
            if rest:
                marks.append(region[lo])
        yield _pair_rows(np.concatenate(a), np.concatenate(b), marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros((0, HASHES), np.uint32)]
        for batch in batches:
            new = [np.asarray(batch.column(c)) for c in range(3)] + [_signatures_of(batch.column(3))]
            rows = [np.concatenate(c) for c in zip(held, new, strict=True)]
            # The last region may go on in the next batch.  One beyond HELD goes on from its last member, and is marked.
            cut = int(np.searchsorted(np.flatnonzero(rows[0] != rows[0][-1]), len(rows[0]))) if len(rows[0]) else 0
            if len(rows[0]) - cut > most:
                yield from compared(*rows)
                yield _pair_rows(np.zeros(0, np.int64), np.zeros(0, np.int64), [rows[0][-1]])
                cut = len(rows[0]) - 1
            else:
                yield from compared(*[c[:cut] for c in rows])
            held = [c[cut:].copy() for c in rows]
        yield from compared(*held)
        yield _pair_rows(np.zeros(0, np.int64), np.zeros(0, np.int64), [])

    return run


def _pair_rows(a: np.ndarray, b: np.ndarray, marks: list) -> pa.RecordBatch:
    none = [None] * len(marks)
    columns = ([*np.minimum(a, b).tolist(), *none], [*np.maximum(a, b).tolist(), *none], [None] * len(a) + [int(x) for x in marks])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "region"])


def _sizes_allow(m, n, percent: int):
    """Whether sets of m and n elements can have the similarity at all."""
    return 100 * np.minimum(m, n) >= percent * np.maximum(m, n)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _first_round(reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b, distinct, of ``reps(doc_id, n_shingles, sig)``; and (region, doc_id, tree) of the regions that these may not exhaust."""
    step = 4 * HASHES // TREES
    turned = "concat(substring(sig, {0}, 10000), substring(sig, 1, {0} - 1))"
    trees = reps.select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(t).alias("tree"), F.expr(f"xxhash64({t}, substring({turned.format(1 + t * step)}, 1, {4 * DEPTH}))").alias("region"))
        for t in range(TREES)])).alias("x")).select("doc_id", "x.*").distinct()
    trees = store.written(trees, "trees")
    shared = trees.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("region")
    rows = trees.hint("merge").join(shared, "region").hint("merge").join(reps, "doc_id")
    rows = rows.select("region", "doc_id", "n_shingles", F.expr("concat(substring(sig, 1 + tree * {0}, 10000), substring(sig, 1, tree * {0}))".format(step)).alias("turned"))
    rows = rows.repartition(_parts(reps), "region").sortWithinPartitions("region", "turned", "doc_id")
    found = store.written(rows.mapInArrow(_candidates_of(percent), "a long, b long, region long"), "found")
    pairs = store.written(found.filter("a < b").select("a", "b").distinct(), "pairs")
    whole = store.written(trees.hint("merge").join(found.filter("region is not null").select("region").distinct(), "region"), "whole")
    store.discard(trees, found)
    return pairs, whole


def _blocks_of(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[str, list]]:
    """Of rows (pair, side, ...) sorted by pair and side: each pair with the rows of both sides, as ``read(batch)`` gives them."""
    pair, sides = None, ([], [])
    for batch in batches:
        for p, side, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), read(batch), strict=True):
            if p != pair:
                if sides[0] and sides[1]:
                    yield pair, sides
                pair, sides = p, ([], [])
            sides[side].append(row)
    if sides[0] and sides[1]:
        yield pair, sides


def _likely(u: list, v: list, least: int, percent: int) -> np.ndarray:
    """Which rows (doc_id, component, n_shingles, signature, tree) of both sides may reach the threshold and cross components: bool[u, v].

    A pair that shares a region of an earlier tree is left to it."""
    step = HASHES // TREES
    x, y = np.stack([r[3] for r in u]), np.stack([r[3] for r in v])
    out = np.zeros((len(u), len(v)), bool)
    comps, sizes = (np.array([r[1] for r in v]), np.array([r[2] for r in v]))
    for i, row in enumerate(u):
        at = np.flatnonzero((comps != row[1]) & _sizes_allow(sizes, row[2], percent))
        if not len(at):
            continue
        same = y[at] == x[i]
        ok = same.sum(1) >= least
        for t in range(row[4] if ok.any() else 0):
            ok &= ~same[:, t * step : t * step + DEPTH].all(1)
        out[i, at[ok]] = True
    return out


def _sent_on(percent: int):
    """(pair, side, doc_id) of the members with a likely partner, one row each."""
    least = int((percent / 100 - SLACK) * HASHES)

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        rows = zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 6)), _signatures_of(batch.column(5)).copy(), strict=True)
        return ((d, c, n, s, t) for d, c, n, t, s in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, (u, v) in _blocks_of(batches, read):
            likely = _likely(u, v, least, percent)
            ids = [[u[i][0] for i in np.flatnonzero(likely.any(1))], [v[i][0] for i in np.flatnonzero(likely.any(0))]]
            sides = [0] * len(ids[0]) + [1] * len(ids[1])
            if sides:
                yield pa.RecordBatch.from_arrays([pa.array([pair] * len(sides)), pa.array(sides, pa.int32()), pa.array(ids[0] + ids[1], pa.int64())], ["pair", "side", "doc_id"])

    return run


def _exact(percent: int):
    """Over rows (pair, side, doc_id, component, set): links that join components, by exact similarity of all pairs of both sides that cross them."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        sets = batch.column(4)
        return ((d, c, sets[i].values.to_numpy(zero_copy_only=False)) for i, (d, c) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (u, v) in _blocks_of(batches, read):
            yield _pair_rows(*_links_across(u, v, percent), []).drop_columns(["region"])

    return run


def _links_across(u: list, v: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    root: dict[int, int] = {r[1]: r[1] for r in (*u, *v)}
    elements, places = np.unique(np.concatenate([r[2] for r in v]), return_inverse=True)
    sizes = np.array([len(r[2]) for r in v])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    a, b = [], []
    for d, c, mine in u:
        own = _find(root, c)
        at = np.flatnonzero(np.array([_find(root, r[1]) != own for r in v]) & _sizes_allow(sizes, len(mine), percent))
        if not len(at):
            continue
        marked = np.zeros(len(elements) + 1, bool)
        where = np.searchsorted(elements, mine)
        hit = where < len(elements)
        hit[hit] = elements[where[hit]] == mine[hit]
        marked[where[hit]] = True
        if len(at) * 4 > len(v):
            both = np.add.reduceat(marked[places].astype(np.int64), starts)[at]
        else:
            both = np.array([np.count_nonzero(marked[places[starts[i] : starts[i] + sizes[i]]]) for i in at])
        for i in at[100 * both >= percent * (len(mine) + sizes[at] - both)].tolist():
            x, y = _find(root, c), _find(root, v[i][1])
            if x != y:
                root[x] = y
                a.append(d)
                b.append(v[i][0])
    return np.array(a, np.int64), np.array(b, np.int64)


def _second_round(whole: DataFrame, reps: DataFrame, label: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links between components of ``label`` that share a region of ``whole``.

    A component with a load above ``BLOCK`` in a region has blocks of its own; the others are dealt
    over mixed blocks, each as a whole.  Blocks of one and the same component are passed over."""
    label = label.select(F.col("node").alias("doc_id"), "component")
    members = whole.hint("merge").join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = members.groupBy("region").agg((F.min("component") < F.max("component")).alias("several")).filter("several").select("region")
    load = F.greatest(F.lit(1.0), F.col("n_shingles") / LOAD)
    rows = store.written(members.hint("merge").join(several, "region").hint("merge").join(reps.withColumn("load", load), "doc_id"), "members")
    sizes = rows.groupBy("region", "component").agg(F.sum("load").alias("n"))
    total = sizes.groupBy("region").agg(F.sum("n").alias("total"))
    placed = rows.select("region", "doc_id", "tree", "component").hint("merge").join(sizes, ["region", "component"]).hint("merge").join(total, "region")
    own = F.col("n") > BLOCK
    part = F.when(own, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BLOCK))).otherwise(F.pmod(F.xxhash64("component"), F.ceil(F.col("total") / BLOCK)))
    placed = store.written(placed.select("region", "doc_id", "tree", "component", F.when(own, F.col("component")).alias("only"), F.concat_ws(":", F.when(own, F.col("component").cast("string")), part.cast("string")).alias("block")), "placed")
    blocks = placed.select("region", "block", "only").distinct()
    other = blocks.select("region", F.col("block").alias("block2"), F.col("only").alias("only2"))
    pairs = blocks.hint("merge").join(other, "region").filter("block <= block2 and not coalesce(only = only2, false)")
    pairs = pairs.select("region", F.concat_ws(" ", "region", "block", "block2").alias("pair"), F.posexplode(F.array("block", "block2")).alias("side", "block"))
    dealt = placed.select("region", "doc_id", "component", "block").hint("merge").join(pairs, ["region", "block"]).hint("merge").join(rows.select("region", "doc_id", "n_shingles", "sig", "tree"), ["region", "doc_id"])
    dealt = dealt.select("pair", "side", "doc_id", "component", "n_shingles", "sig", "tree")
    parts = _parts(whole)
    sent = store.written(dealt.repartition(parts, "pair").sortWithinPartitions("pair", "side", "doc_id").mapInArrow(_sent_on(percent), "pair string, side int, doc_id long"), "sent")
    store.discard(rows, placed)
    sets = _sets_of(docs, sent.select("doc_id").distinct(), shingle)
    full = sent.hint("merge").join(label, "doc_id", "left").hint("merge").join(sets, "doc_id").select("pair", "side", "doc_id", F.coalesce("component", "doc_id").alias("component"), "set")
    links = store.written(full.repartition(parts, "pair").sortWithinPartitions("pair", "side", "doc_id").mapInArrow(_exact(percent), "a long, b long").distinct(), "links")
    store.discard(sent, sets)
    return links


def _sets_of(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, set) of the documents in ``nodes``; a row for each distinct text of an id."""
    nodes = store.written(nodes, "nodes")
    found = store.by_id(docs, nodes, "doc_id", "left_semi").withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"])
    return store.written(found.select("doc_id", "text").mapInArrow(_sets(shingle), "doc_id long, set array<long>"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = pairs.hint("merge").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("_b")), "b")
    both = left.hint("merge").join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("_a")), "a")
    common = F.size(F.array_intersect("_a", "_b")).cast("long")
    total = F.size("_a").cast("long") + F.size("_b")
    return both.filter(100 * common >= percent * (total - common)).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links (links of its class that were verified and joined components)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = store.written(docs.mapInArrow(_sign(shingle), SIGNED), "signed")
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = store.written(filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.join(classes, (filled.h1 == classes.h1) & (filled.h2 == classes.h2) & (filled.doc_id == classes.rep), "left_semi")
    reps = store.written(reps.dropDuplicates(["doc_id", "h1", "h2"]).select("doc_id", "n_shingles", "sig"), "reps")
    # Ids whose rows fall in several classes link these; ids of one class alone need no row.
    spread = filled.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    several = filled.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select(F.col("doc_id").alias("a"))
    same_id = store.written(spread.join(several, "a", "left_semi"), "same_id")
    pairs, whole = _first_round(reps, percent)
    nodes = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = _sets_of(docs, nodes, shingle)
    links = store.written(_verified(pairs, sets, percent).distinct().union(same_id), "links")
    store.discard(sets, pairs, same_id)
    label = store.written(components(links), "components")
    more = _second_round(whole, reps, label, docs, shingle, percent)
    store.discard(whole, reps)
    if not more.isEmpty():
        links = links.union(more)
        store.discard(label)
        label = store.written(components(links), "components")
    degree = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    known = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    known = known.select("h1", "h2", F.coalesce("component", "rep").alias("_c"), F.coalesce("n_links", F.lit(0)).alias("_l"))
    # A set that is empty has no class: its hashes are made null, so that it joins nothing.
    some = F.col("n_shingles") > 0
    rows = signed.select("doc_id", "n_shingles", F.when(some, F.col("h1")).alias("h1"), F.when(some, F.col("h2")).alias("h2"))
    out = rows.join(known, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("_l", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, less those of documents that are linked with a smaller id; of rows with the same id, one stays."""
    verdict = store.written(near_duplicates(docs, shingle, percent).select(F.col("doc_id").alias("_id"), "kept"), "verdict")
    gone = store.written(verdict.filter("not kept").select("_id").distinct(), "gone")
    repeated = verdict.filter("kept and _id is not null").groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id")
    left = store.by_id(docs, gone, F.col("doc_id").cast("long") == F.col("_id"), "left_anti")
    if repeated.isEmpty():
        return left
    repeated = store.written(repeated, "repeated")
    once = store.by_id(left, repeated, F.col("doc_id").cast("long") == F.col("_id"), "left_anti")
    first = store.by_id(left, repeated, F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    first = first.toDF(*names).select(F.struct(*names).alias("_row"), F.col(f"_c{docs.columns.index('doc_id')}").cast("long").alias("_id"), F.xxhash64(*names).alias("_h"))
    first = first.groupBy("_id").agg(F.min_by("_row", "_h").alias("_row")).select("_row.*")
    return once.union(first.toDF(*docs.columns))


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents: 3-word shingles, similarity 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = {
    "op2_minhash_forest": r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word, len(w) as n from d),
k as (select doc_id, i, n, word || coalesce(' ' || lead(word) over v, '') || coalesce(' ' || lead(word, 2) over v, '') as s from p window v as (partition by doc_id order by i)),
s as (select distinct doc_id, s from k where i <= greatest(n - 2, 1)),
c as (select doc_id, count(*) as n from s group by doc_id),
x as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from x join c ca on ca.doc_id = a join c cb on cb.doc_id = b where 100 * x.n >= 85 * (ca.n + cb.n - x.n)),
t as (select a, b from l union all select b, a from l),
reach(node, other) as (select a, b from t union select reach.node, t.b from reach join t on t.a = reach.other),
m as (select node, min(other) as least from reach group by node)
select d.doc_id, coalesce(c.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(m.least, d.doc_id)) as kept
from d left join c using (doc_id) left join m on m.node = d.doc_id
"""
}
