import hashlib
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tessella.llm import substrings

from .compare import agree


def brute(rows, k):
    docs = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    n = Counter(tuple(w[j : j + k]) for _, w in docs for j in range(len(w) - k + 1))
    out = []
    for i, w in docs:
        gone = {j + x for j in range(len(w) - k + 1) if n[tuple(w[j : j + k])] > 1 for x in range(k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def ours(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rid int")
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(df, **options).collect()), key=repr)


@pytest.mark.parametrize(("hot", "seed"), [(1000, 1), (2, 2)])
def test_random_texts(spark, hot, seed):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = [(None, None), (1, ""), (2, " \n"), (3, "a " * 300), (4, "a b " * 300), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "é\x0bb\tc " * 3)]
    for i in range(10, 60):
        words = [r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(0, 80))]
        if r.random() < 0.5:
            at, lo = r.randint(0, len(words)), r.randint(0, 20)
            words[at:at] = passage[lo : lo + r.randint(5, 20)]
        rows.append((i, r.choice([" ", "\n", "  "]).join(words)))
    rows += r.sample(rows, 5)
    assert ours(spark, rows, window=7, gram=3, hot=hot) == brute(rows, 7)


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"], strict=True))
    got = sorted((tuple(r) for r in substrings.op6_super_kmers(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == brute(rows, 35) and any(x[2] for x in got)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    agree(spark, substrings.op6_super_kmers, substrings.ORACLE_SQL["op6_super_kmers"], f"/root/testdata/{sf}")


def test_intermediates_start_no_process(spark):
    """Page faults of ended children of the JVM (proc(5), cminflt) grow with every process it starts, as its own file writer does."""
    jvm = spark._jvm.java.lang.ProcessHandle.current().pid()

    def children():
        with open(f"/proc/{jvm}/stat") as f:
            return int(f.read().rpartition(")")[2].split()[8])

    rows = spark.createDataFrame([(i, f"{'a b c d e f g ' * 3}{i}") for i in range(5)], "rid long, text string")
    rows.mapInArrow(lambda batches: batches, rows.schema).collect()  # starts the workers' daemon
    before = children()
    assert substrings.repeated_spans(rows, 7, 3).count() == 5
    assert children() == before
