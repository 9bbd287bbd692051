"""Operator 6: removal of repeated word windows by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document.  Its minimiser is, among its ``GRAM``-word
pieces, the one with the smallest hash (the leftmost of equals); equal windows have equal
minimisers at the same place.  Consecutive windows with the same minimiser occurrence form a
super-k-mer, which travels as one packed string to its minimiser's bucket:

1. Super-k-mers are listed as (minimiser, document, place).  A window can repeat only if its
   minimiser occurs in two super-k-mers; the others travel no further.
2. The remaining ones are packed as strings.  Equal strings are counted first, in partial sums, so a
   passage that any number of documents share is one row; all windows of a string seen twice repeat.
3. Distinct strings meet in their minimiser's bucket, where sorting their windows finds those
   that two strings share.  A bucket of more than ``HOT`` distinct strings does not meet in one
   task: its windows are counted one by one by their own hash, in partial sums.
4. Flagged windows go back to the places of their strings, and from there to the documents.

Two windows of one super-k-mer are never equal: they would have different minimiser occurrences.
Windows are compared by two 64-bit hashes over 64-bit word hashes.  Documents are identified by a
hash of id and text, so repeated rows need no other key, and each counts as a place of its own.

Null texts and texts without words have no windows and keep the empty string.  Empty tables give no
rows; of the input only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import store, words

WINDOW, GRAM, HOT = 35, 16, 1000
SECOND = 0xA24BAED4963EE407
_MAX = np.uint64(2**64 - 1)
SPANS = "array<struct<first: int, n: int, key: long>>"


def super_kmers(run: words.Run, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document in the run, first word, number of windows, minimiser hash) of every super-k-mer."""
    hashes, whole = run.grams(gram)
    n, w = len(hashes), window - gram + 1
    key = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    key[~whole] = _MAX
    least, size = np.concatenate([key, np.full(w, _MAX)]), 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = w - size
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    ends = np.repeat(run.bounds[1:], np.diff(run.bounds))
    at = np.flatnonzero(np.arange(n) + window <= ends)
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    doc = run.owner()[at[first]]
    return doc, at[first] - run.bounds[doc], count, hashes[place[first]]


def _list(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in words.runs(batch.column(1)):
                doc, first, count, key = super_kmers(r, window, gram)
                rid = batch.column(0).slice(r.first, len(r)).to_numpy()[doc]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rid), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], ["key", "rid", "first", "n"])

    return run


def _pack(window: int):
    """Rows (rid, text, spans) to (key, rid, first, n, packed, h); words of a string are joined by a space, ``h`` is its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            h = np.array([xxhash.xxh64_intdigest(x) for x in out[4]], np.uint64).view(np.int64)
            columns = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(h)], ["key", "rid", "first", "n", "packed", "h"])

        out: list[list] = [[], [], [], [], []]
        held = 0
        for batch in batches:
            spans = batch.column(2)
            parts = [spans.flatten().field(i).to_pylist() for i in range(3)]
            cuts = (spans.offsets.to_numpy() - spans.offsets[0].as_py()).tolist()
            for k, (rid, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                tokens = text.encode().split()
                for x in range(cuts[k], cuts[k + 1]):
                    first, n, key = parts[0][x], parts[1][x], parts[2][x]
                    packed = b" ".join(tokens[first : first + n + window - 1])
                    for column, value in zip(out, (key, rid, first, n, packed), strict=True):
                        column.append(value)
                    held += len(packed)
                if held > 4 << 20:
                    yield made()
                    out, held = [[], [], [], [], []], 0
        yield made()

    return run


def _windows(strings: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """(string, window in it, hash, second hash) of all windows of packed strings."""
    parts: list[tuple] = []
    for r in words.runs(strings.cast(pa.string())):
        a, whole = r.grams(window)
        b, _ = r.grams(window, SECOND)
        at = np.flatnonzero(whole)
        doc = r.owner()[at]
        parts.append((doc + r.first, at - r.bounds[doc], a[at], b[at]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4


def _bucket(window: int):
    """Rows (key, h, packed) sorted by key to (key, h, lo): windows that two strings of a bucket share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None

        def work(t: pa.Table) -> pa.RecordBatch:
            keys, h = t.column(0).to_numpy(), t.column(1).to_numpy()
            s, i, a, b = _windows(t.column(2).combine_chunks(), window)
            k = keys[s]
            order = np.lexsort((b, a, k))
            same = (k[order][1:] == k[order][:-1]) & (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
            hit = np.zeros(len(order), bool)
            hit[1:] |= same
            hit[:-1] |= same
            got = order[hit]
            return pa.RecordBatch.from_arrays([pa.array(keys[s[got]]), pa.array(h[s[got]]), pa.array(i[got].astype(np.int32))], ["key", "h", "lo"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t])
            keys = t.column(0).to_numpy()
            # Whole buckets only; the last may go on in the next batch.
            cut = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            if cut:
                yield work(t.slice(0, cut))
            left = t.slice(cut)
        if left is not None and left.num_rows:
            yield work(left)

    return run


def _single(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, i, a, b = _windows(batch.column(2), window)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s)), batch.column(1).take(pa.array(s)), pa.array(i.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["key", "h", "lo", "a", "b"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(rid, spans): of ``docs(rid, text)``, word ranges [lo, hi) covered by windows that start anywhere else too."""
    kmers = store.landed(docs.select("rid", "text"), "kmers", _list(window, gram), "key long, rid long, first int, n int")
    # Written, so that the join has a plain exchange on both sides, whose hot keys can be split.
    again = store.landed(kmers.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "again")
    found = kmers.join(again.hint("merge"), "key").groupBy("rid").agg(F.collect_set(F.struct("first", "n", "key")).alias("spans"))
    found = store.landed(found, "candidates")
    store.discard(kmers, again)
    packed = docs.select("rid", "text").join(found.hint("merge"), "rid").select("rid", "text", F.col("spans").cast(SPANS))
    places = store.landed(packed, "places", _pack(window), "key long, rid long, first int, n int, packed binary, h long")
    store.discard(found)
    strings = store.landed(places.groupBy("key", "h", "n", "packed").agg(F.count(F.lit(1)).alias("c")), "strings")
    sizes = store.landed(strings.groupBy("key").agg(F.count(F.lit(1)).alias("d")).filter("d > 1"), "sizes")
    met = strings.select("key", "h", "packed").join(sizes.hint("merge"), "key")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = met.filter(f"d <= {hot}").select("key", "h", "packed").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_bucket(window), "key long, h long, lo int")
    single = store.landed(met.filter(f"d > {hot}").select("key", "h", "packed"), "single", _single(window), "key long, h long, lo int, a long, b long")
    shared = single.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("a", "b")
    flagged = cold.union(single.join(shared, ["a", "b"]).select("key", "h", "lo")).withColumn("hi", F.col("lo") + 1)
    flagged = flagged.union(strings.filter("c > 1").select("key", "h", F.lit(0).alias("lo"), F.col("n").alias("hi")))
    flagged = store.landed(flagged.groupBy("key", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("windows")), "flagged")
    back = places.select("key", "h", "rid", "first").join(flagged.hint("merge"), ["key", "h"])
    spans = back.select("rid", F.explode(F.expr(f"transform(windows, w -> struct(first + w.lo as lo, first + w.hi + {window - 1} as hi))")).alias("s"))
    out = store.landed(spans.groupBy("rid").agg(F.collect_set("s").alias("spans")), "spans")
    store.discard(places, strings, sizes, single, flagged)
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        spans = batch.column(2)
        for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            tokens = (text or "").encode().split()
            n = len(tokens)
            if spans[k].is_valid:
                gone = np.zeros(n + 1, np.int32)
                inner = spans[k].values.flatten()
                np.add.at(gone, inner[0].to_numpy(), 1)
                np.add.at(gone, inner[1].to_numpy(), -1)
                keep = np.cumsum(gone[:n]) == 0
                tokens = [t for t, x in zip(tokens, keep.tolist(), strict=True) if x]
            kept = b" ".join(tokens)
            out.append((doc_id, n, n - len(tokens), hashlib.sha256(kept).hexdigest(), kept))
            held += len(kept)
            if held > 8 << 20:
                yield _rows(out)
                out, held = [], 0
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns[4] = tuple(x.decode() for x in columns[4])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What :func:`remove_repeats` returns but the texts, which stay in the worker."""
    for batch in _remove(batches):
        yield batch.select(["doc_id", "n_words", "n_removed", "kept_sha256"])


def _with_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(rows, window, gram, hot)
    return rows.join(spans.hint("merge"), "rid", "left").select("doc_id", "text", "spans")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (words joined by a space) of every row."""
    return _with_spans(docs, window, gram, hot).mapInArrow(_remove, f"{REMOVED}, kept_text string")


def op6_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated 35-word windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return store.landed(_with_spans(docs), "counts", _counts, REMOVED)


ORACLE_SQL = {
    "op6_super_kmers": r"""
with d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
k as (select r, i, word, count(*) over v as n, string_agg(word, ' ') over v as s from p window v as (partition by r order by i rows between current row and 34 following)),
h as (select r, i, word, case when n = 35 and count(*) over (partition by case when n = 35 then s end) > 1 then 1 else 0 end as hit from k),
g as (select r, i, word, max(hit) over (partition by r order by i rows between 34 preceding and current row) as gone from h),
e as (select r, count(*) as n, sum(gone) as removed, string_agg(word, ' ' order by i) filter (where gone = 0) as kept from g group by r)
select doc_id, coalesce(n, 0)::bigint as n_words, coalesce(removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join e using (r)
"""
}
