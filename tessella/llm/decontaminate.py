"""Operator 3: benchmark decontamination by SimHash of item-sized windows.

Words are ASCII-folded runs of letters, digits and non-ASCII characters; shingles are ``SHINGLE`` words
(an item with fewer words is one shingle).  For an item of L words, every document window of L
words that holds one of its shingles gets a 64-bit SimHash of its weighted shingles; windows that
hold none have similarity 0, so leaving them out loses nothing.  A multi-index over
``BLOCKS`` blocks of the items' fingerprints finds all items within ``RADIUS`` bits: if at most RADIUS bits differ, some
block differs in at most RADIUS / BLOCKS bits, and each block is probed that far.  Candidates are verified by the exact weighted-shingle
similarity, sum of min over sum of max of the weighted shingle counts, at least ``LEAST``.
A shingle weighs log(1 + items / items that have it), over all items.

The benchmark is a stated query set: it is taken in blocks of at most ``BLOCK_BYTES`` of text (or one item).  Blocks are written to
the shared folder one by one, so the driver holds one of them and 16 bytes for each distinct shingle of all; each block is
a map of its own over the documents, and a task loads it once.  Documents are only mapped, never shuffled, so hot keys do not matter.
Blocks change no result: weights are those of the whole benchmark.

Texts are read in runs; a text longer than a run is one by itself, about 50 bytes of memory a byte of text.
A null text or item has no words and matches nothing.  Repeated rows and items are each reported.
Empty tables give no rows.  Extra columns of the input pass through ``clean`` untouched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import store, words

SHINGLE, LEAST, RADIUS, BLOCKS = 5, 0.8, 20, 4
BLOCK_BYTES = 16 << 20
HITS = "doc_id long, item_id long, start_word long, n_words long, begin_byte long, end_byte long, distance int, similarity double"


class HammingIndex:
    """All stored 64-bit fingerprints within ``radius`` of a query, by ``BLOCKS`` blocks, each probed within its part of the radius."""

    def __init__(self, fingerprints: np.ndarray, radius: int):
        self.fps, self.radius = fingerprints.astype(np.uint64), radius
        width = 64 // BLOCKS
        self.blocks = []
        for i in range(BLOCKS):
            lo, mask = np.uint64(i * width), np.uint64((1 << width) - 1)
            values, inverse = np.unique((self.fps >> lo) & mask, return_inverse=True)
            # The last blocks need one bit less: all blocks beyond their parts would differ in more than ``radius`` bits.
            near = radius // BLOCKS - (i > radius % BLOCKS)
            if near >= 0:
                self.blocks.append((lo, mask, near, values, np.argsort(inverse, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(values)))])))

    def _candidates(self, queries: np.ndarray) -> np.ndarray:
        """query * stored + place of every stored fingerprint that is near in some block."""
        found = []
        for lo, mask, near, values, order, starts in self.blocks:
            asked, inverse = np.unique((queries >> lo) & mask, return_inverse=True)
            q, v = np.nonzero(np.bitwise_count(asked[:, None] ^ values[None]) <= near)
            # All queries with the asked value, then all stored with the near one.
            by_value = np.argsort(inverse, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(asked)))])
            queries_of, x = _spread(by_value, first, q)
            stored_of, y = _spread(order, starts, v[x])
            found.append(queries_of[y] * len(self.fps) + stored_of)
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, stored, distance) of every pair within the radius."""
        step, out = max(16, (1 << 22) // max(1, len(self.fps))), []
        for lo in range(0, len(queries), step):
            part = queries[lo : lo + step]
            q, s = np.divmod(self._candidates(part), len(self.fps))
            d = np.bitwise_count(part[q] ^ self.fps[s]).astype(np.int32)
            ok = d <= self.radius
            out.append((lo + q[ok], s[ok], d[ok]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _spread(members: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of each of ``groups``, one after the other, and for each which of the groups it came from."""
    size = starts[groups + 1] - starts[groups]
    which = np.repeat(np.arange(len(groups)), size)
    within = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return members[starts[groups][which] + within], which


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1 and -1 by the bits of each hash: float64[n, 64]."""
    h = words.mix(hashes ^ np.uint64(0x3C6EF372FE94F82B))
    return ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2 - 1


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def known_items(items: list[tuple[int, str | None]], shingle: int = SHINGLE) -> list[tuple]:
    """(item_id, words, shingle size, shingles in order) of the items that have words."""
    out = []
    for run in words.runs(pa.array([t or "" for _, t in items], pa.string()), words.NOT_ALNUM, words.FOLDED):
        for d in range(len(run)):
            n = int(run.bounds[d + 1] - run.bounds[d])
            if n:
                size = min(shingle, n)
                out.append((items[run.first + d][0], n, size, run.grams(size)[0][run.bounds[d] : run.bounds[d + 1] - size + 1]))
    return out


class Weights:
    """Sorted shingles of all items, in how many of them each is, and how many items there are."""

    def __init__(self) -> None:
        self.shingles, self.df, self.items = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def add(self, known: list[tuple]) -> None:
        if not known:
            return
        new = np.concatenate([self.shingles, *[np.unique(g) for *_, g in known]])
        counts = np.concatenate([self.df, np.ones(len(new) - len(self.df), np.int64)])
        self.shingles, inverse = np.unique(new, return_inverse=True)
        self.df = np.bincount(inverse, weights=counts, minlength=len(self.shingles)).astype(np.int64)
        self.items += len(known)


class Benchmark:
    """Items by their length in words, with shingles, weights, fingerprints and the index."""

    def __init__(self, items: list[tuple[int, str | None]], weights: Weights | None = None, shingle: int = SHINGLE, least: float = LEAST, radius: int = RADIUS):
        self.k, self.least = shingle, least
        known = known_items(items, shingle)
        if weights is None:
            weights = Weights()
            weights.add(known)
        self.other = float(np.log(1 + max(1, weights.items)))
        self.shingles, self.weights = weights.shingles, np.log(1 + weights.items / np.maximum(weights.df, 1))
        self.groups: list[dict] = []
        for n in sorted({x[1] for x in known}):
            mine = [x for x in known if x[1] == n]
            size = mine[0][2]
            counts = [dict(zip(*[c.tolist() for c in np.unique(g, return_counts=True)], strict=True)) for *_, g in mine]
            total = [float(sum(c * self.weight(np.array([h], np.uint64))[0] for h, c in x.items())) for x in counts]
            fps = np.array([_fingerprint((_bits(g) * self.weight(g)[:, None]).sum(0, keepdims=True))[0] for *_, g in mine])
            self.groups.append({"n": n, "size": size, "ids": [x[0] for x in mine], "counts": counts, "total": total, "index": HammingIndex(fps, radius), "anchors": np.unique(np.concatenate([x[3] for x in mine]))})
        self.sizes = sorted({g["size"] for g in self.groups})
        self.filters = {}
        for size in self.sizes:
            hashes = np.unique(np.concatenate([g["anchors"] for g in self.groups if g["size"] == size]))
            seen = np.zeros(1 << 20, bool)
            seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.filters[size] = (seen, hashes)

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.shingles, hashes), len(self.shingles) - 1)
        return np.where(self.shingles[at] == hashes, self.weights[at], self.other)

    def anchors(self, grams: np.ndarray, whole: np.ndarray, size: int) -> np.ndarray:
        """Places of all grams that any item has."""
        seen, hashes = self.filters[size]
        at = np.flatnonzero(seen[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] & whole)
        x = np.minimum(np.searchsorted(hashes, grams[at]), len(hashes) - 1)
        return at[hashes[x] == grams[at]]

    def similarity(self, window: np.ndarray, counts: dict[int, int], total: float) -> float:
        h, c = np.unique(window, return_counts=True)
        w = self.weight(h)
        mine = float((w * c).sum())
        both = float(sum(x * min(n, counts.get(g, 0)) for g, n, x in zip(h.tolist(), c.tolist(), w.tolist(), strict=True)))
        return both / (mine + total - both)

    def hits(self, run: words.Run) -> list[tuple]:
        """(document in the run, item, first word, words, first byte, last byte, distance, similarity): the best window of each document and item."""
        best: dict[tuple, tuple] = {}
        if not self.groups or not len(run.hash):
            return []
        for size in self.sizes:
            grams, whole = run.grams(size)
            anchors = self.anchors(grams, whole, size)
            if not len(anchors):
                continue
            owner = np.searchsorted(run.bounds, anchors, "right") - 1
            for group in (g for g in self.groups if g["size"] == size):
                n = group["n"]
                x = np.minimum(np.searchsorted(group["anchors"], grams[anchors]), len(group["anchors"]) - 1)
                mine = group["anchors"][x] == grams[anchors]
                if not mine.any():
                    continue
                at, doc = anchors[mine], owner[mine]
                # All windows of n words with an anchor inside; a document shorter than n is one window.
                first, last = run.bounds[doc], np.maximum(run.bounds[doc], run.bounds[doc + 1] - n)
                lo, hi = np.clip(at - (n - size), first, last), np.clip(at, first, last)
                starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)]))
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    for c in range(0, len(part), 4096):
                        self._scan(run, grams, group, part[c : c + 4096], best)
        return [(d, i, *v) for (d, _, i), v in best.items()]

    def _scan(self, run: words.Run, grams: np.ndarray, group: dict, starts: np.ndarray, best: dict) -> None:
        n, size = group["n"], group["size"]
        doc = np.searchsorted(run.bounds, starts, "right") - 1
        ends = np.minimum(starts + n, run.bounds[doc + 1])
        a, b = int(starts[0]), int(ends[-1]) - size + 1
        sums = np.zeros((b - a + 1, 64))
        g = grams[a:b]
        np.cumsum(_bits(g) * self.weight(g)[:, None], axis=0, out=sums[1:])
        fps = _fingerprint(np.round(sums[ends - size + 1 - a] - sums[starts - a], 9))
        q, s, d = group["index"].within(fps)
        for k, item, far in zip(q.tolist(), s.tolist(), d.tolist(), strict=True):
            at, end = int(starts[k]), int(ends[k])
            got = self.similarity(grams[at : end - size + 1], group["counts"][item], group["total"][item])
            if got >= self.least - 1e-12:
                key = (int(doc[k]), (n, item), group["ids"][item])
                if key not in best or (got, -at) > (best[key][-1], -best[key][0] - int(run.bounds[doc[k]])):
                    base = int(run.offsets[doc[k]])
                    best[key] = (at - int(run.bounds[doc[k]]), end - at, int(run.start[at]) - base, int(run.end[end - 1]) - base, far, got)


def benchmark_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """The query set in blocks of bounded size (or one item): files in the shared folder."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)

    def block(b: int) -> list[tuple]:
        return [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]

    weights, only = Weights(), None
    for b in range(blocks):
        only = block(b)
        weights.add(known_items(only))
    return [store.put(items.sparkSession, pickle.dumps(Benchmark(only if blocks == 1 else block(b), weights)), "benchmark") for b in range(blocks)]


_loaded: dict[str, Benchmark] = {}


def _load(uri: str) -> Benchmark:
    """The block in a file; a worker process holds the last one."""
    if uri not in _loaded:
        _loaded.clear()
        _loaded[uri] = pickle.loads(store.get(uri))
    return _loaded[uri]


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document and item found in it, with its best window."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
    names = [x.split()[0] for x in HITS.split(", ")]

    def finder(uri: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _load(uri)
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), []
                for r in words.runs(batch.column(1), words.NOT_ALNUM, words.FOLDED):
                    out += [(ids[r.first + d], *x) for d, *x in block.hits(r)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 8, kinds, strict=True)], names)

        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [texts.mapInArrow(finder(uri), HITS) for uri in benchmark_blocks(items)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], HITS)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    place = docs.columns.index("text")

    def cleaner(uri: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _load(uri)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for r in words.runs(batch.column(place), words.NOT_ALNUM, words.FOLDED):
                    for d, *_ in block.hits(r):
                        keep[r.first + d] = False
                yield batch.filter(pa.array(keep))

        return run

    for uri in benchmark_blocks(items):
        docs = docs.mapInArrow(cleaner(uri), docs.schema)
    return docs


def op3_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, items)
