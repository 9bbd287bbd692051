import math
import struct
from functools import reduce

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import log, search


def cos(a, b):
    if a is None or b is None or None in a or None in b or len(a) != len(b):
        return None
    dot = lambda x, y: reduce(lambda s, pq: s + pq[0] * pq[1], zip(x, y, strict=True), 0.0)
    c = None if 0 in (dot(a, a), dot(b, b)) else dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))
    return c if c is None or math.isnan(c) else max(-1.0, min(1.0, c))


def brute(queries, points, k, on):
    out = set()
    for i, q, s in queries:
        got = [(cos(q, p), j) for j, p, t in points if not on or (s is not None and s == t)]
        got.sort(key=lambda x: (x[0] is None, -math.inf if x[0] is not None and math.isnan(x[0]) else -(x[0] or 0), x[1]))
        out |= {(i, j, n + 1, None if c is None else "nan" if math.isnan(c) else struct.pack("d", c + 0.0)) for n, (c, j) in enumerate(got[:k])}
    return out


def vectors(n):
    r = np.random.default_rng(5)
    f = lambda x: [float(np.float32(v)) for v in x]
    rows = [f(r.normal(size=6)) for _ in range(n)]
    for i in range(0, n, 7):
        rows[i] = rows[0]
    for i, x in enumerate((None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [2 * x for x in rows[0]], [], f(3 * x for x in rows[8]), [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5)):
        rows[10 * i + 3] = x
    return rows


@pytest.mark.parametrize("on", [None, "session_id"])
def test_nearest_against_brute_force(spark, on):
    rows = [(f"p{i:03}", v, None if i % 11 == 0 else f"s{i % 4}") for i, v in enumerate(vectors(200))]
    queries = [(i, v, s) for i, (_, v, s) in enumerate(rows) if i % 3 == 0]
    points = spark.createDataFrame(rows, "point_id string, vector array<float>, session_id string").withColumn("content", F.concat(F.lit("of "), "point_id"))
    q = spark.createDataFrame(queries, "query_id long, query array<float>, session_id string")
    if not on:
        q = q.drop("session_id")
    for k in (1, 3, 70):
        got = log.nearest(q, points, k, on).select("query_id", "point_id", "rank", "score", "content").collect()
        assert all(r.content == "of " + r.point_id for r in got)
        assert {(r.query_id, r.point_id, r.rank, None if r.score is None else "nan" if math.isnan(r.score) else struct.pack("d", r.score + 0.0)) for r in got} == brute(queries, rows, k, on)
    assert log.nearest(q.limit(0), points, 2, on).count() == log.nearest(q, points.limit(0), 2, on).count() == 0


def test_nearest_makes_no_row_per_pair(spark):
    points = spark.range(500).select(F.col("id").alias("point_id"), F.array(F.sin("id"), F.cos("id")).alias("vector"), (F.col("id") % 2).alias("session_id"))
    q = points.select(F.col("point_id").alias("query_id"), F.col("vector").alias("query"), "session_id")
    for on in (None, "session_id"):
        plan = log.nearest(q if on else q.drop("session_id"), points, 2, on)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan


def test_tiles_and_groups(monkeypatch):
    monkeypatch.setattr(search, "QUERY_ROWS", 5)
    monkeypatch.setattr(search, "PAIRS", 7)
    rows = vectors(200)
    vs = search.Vectors(pa.array(rows, pa.list_(pa.float32())))
    everything = {None: np.arange(200)}
    want = brute([(i, v, 0) for i, v in enumerate(rows)], [(i, v, 0) for i, v in enumerate(rows)], 4, None)
    for group in (1, 3, 32, 500):
        monkeypatch.setattr(search, "GROUP", group)
        i, j, score, unknown = search.pairs(vs, everything, vs, everything, 4)
        by = {}
        for a, b, c, u in zip(i.tolist(), j.tolist(), score.tolist(), unknown.tolist(), strict=True):
            by.setdefault(a, []).append((u, -math.inf if math.isnan(c) else -c, b))
        got = {(a, b, n + 1, None if u else "nan" if c == -math.inf else struct.pack("d", -c + 0.0)) for a, x in by.items() for n, (u, c, b) in enumerate(sorted(x)[:4])}
        assert got == want


def test_cosine_has_the_bits_of_sql(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=64)], [float(np.float32(x)) for x in r.normal(size=64)]) for i in range(300)]
    rows += [(300 + i, a, [3 * x for x in a]) for i, (_, a, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "i long, a array<double>, b array<double>")
    got = {x.i: x.c for x in df.select("i", log.cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    c = duckdb.connect()
    t = pa.table({"i": [x[0] for x in rows], "a": [x[1] for x in rows], "b": [x[2] for x in rows]})  # noqa: F841
    assert got == dict(c.sql("select i, list_cosine_similarity(a, b) from t").fetchall())
