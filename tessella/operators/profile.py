"""Profiles of a table: shape, nulls, samples, statistics, histogram, schema card."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.NumericType,)
#: Bins of a span that quantiles counts at once, for up to 32 columns; fewer for more.
BINS = 1 << 13
# Type names on the schema card.
CARD_TYPES = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "double": "float64", "float": "float32", "string": "object", "boolean": "bool", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]"}


def _missing(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    return (F.col(c).isNull() | F.isnan(c)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c).isNull()


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def unpivoted(wide: DataFrame, columns: list[str], parts: list[tuple[str, str]], key: str = "column") -> DataFrame:
    """One row per column out of one wide row, whose fields are named ``<part>_<column>``."""
    rows = F.array(*[F.struct(F.lit(c).alias(key), *[F.col(f"{p}_{c}").cast(t).alias(p) for p, t in parts]) for c in columns])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n): nulls and NaNs, all columns in one pass."""
    wide = df.agg(*[F.coalesce(F.sum(_missing(df, c).cast("long")), F.lit(0)).alias(f"n_{c}") for c in df.columns])
    return unpivoted(wide, df.columns, [("n", "long")])


def sample_values(df: DataFrame, columns: list[str], order: str, k: int = 5) -> DataFrame:
    """(column, rank, value): the first k distinct known values of each column in ``order``."""
    long = df.select(F.col(order).alias("_o"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.when(~_missing(df, c), F.col(c).cast("string")).alias("value")) for c in columns])).alias("x")).select("_o", "x.*")
    first = long.filter("value is not null").groupBy("column", "value").agg(F.min("_o").alias("_o"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("_o", "value"))).filter(F.col("rank") <= k).select("column", "rank", "value")


def _keys(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros have one."""
    bits = (values + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(1 << 63)


def _value(key: int) -> float:
    bits = np.array([key ^ (1 << 63)], np.uint64).view(np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def _counted(spans: list[tuple[int, int, int]], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per span (column, least key, greatest key) and one of its 2^width bins: values, least and greatest of them as offsets from the span's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = [np.uint64(max(0, (hi - lo).bit_length() - width)) for _, lo, hi in spans]
        n, least, most = (np.full((len(spans), 1 << width), x, kind) for x, kind in ((0, np.int64), (2**64 - 1, np.uint64), (0, np.uint64)))
        for batch in batches:
            keys = [_keys(batch.column(c).drop_null().to_numpy()) if any(c == x for x, _, _ in spans) else None for c in range(batch.num_columns)]
            for s, (c, lo, hi) in enumerate(spans):
                at = keys[c][(keys[c] >= np.uint64(lo)) & (keys[c] <= np.uint64(hi))] - np.uint64(lo)
                bins = (at >> shifts[s]).astype(np.int64)
                n[s] += np.bincount(bins, minlength=1 << width)
                np.minimum.at(least[s], bins, at)
                np.maximum.at(most[s], bins, at)
        s, bins = np.nonzero(n)
        # the sign bit is turned, as Spark's integers are signed
        ends = [(x[s, bins] ^ np.uint64(1 << 63)).view(np.int64) for x in (least, most)]
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(bins), pa.array(n[s, bins]), *map(pa.array, ends)], ["span", "bin", "n", "least", "most"])

    return run


def quantiles(df: DataFrame, columns: list[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact linear quantiles of the known values of numeric columns; None without values.

    Each pass counts the values in bins of the doubles' bits and goes on with the bins that hold a wanted rank, until one value is left in each.
    A task sends at most ``BINS`` counts a pass and span, so memory and traffic do not grow with the rows; there are at most five passes of 13 bits."""
    values = df.select(*[F.when(~_missing(df, c), F.col(c)).cast("double").alias(c) for c in columns])
    ends = values.agg(*[f(F.col(f"`{c}`")) for c in columns for f in (F.count, F.min, F.max)]).first()
    width = max(4, min(BINS, 32 * BINS // len(columns)).bit_length() - 1)
    places, found, spans = {}, {}, []
    for i, c in enumerate(columns):
        n, lo, hi = ends[3 * i : 3 * i + 3]
        places[c] = [(n - 1) * x for x in shares] if n else []
        ranks = sorted({f(x) for x in places[c] for f in (math.floor, math.ceil)})
        if n:
            spans.append((i, *(int(_keys(np.array([x]))[0]) for x in (lo, hi)), 0, ranks))
    while spans:
        counted = values.mapInArrow(_counted([x[:3] for x in spans], width), "span long, bin long, n long, least long, most long")
        rows = counted.groupBy("span", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).toArrow().sort_by([("span", "ascending"), ("bin", "ascending")])
        span, n, least, most = (rows.column(x).to_numpy() for x in ("span", "n", "least", "most"))
        new = []
        for s, (c, start, _, before, ranks) in enumerate(spans):
            own = np.flatnonzero(span == s)
            upto = before + np.cumsum(n[own])
            inside: dict[int, list[int]] = {}
            for r in ranks:
                inside.setdefault(int(np.searchsorted(upto, r, side="right")), []).append(r)
            for k, mine in inside.items():
                lo, hi = (start + int(x[own[k]]) + (1 << 63) for x in (least, most))
                if lo == hi:
                    found |= {(c, r): _value(lo) for r in mine}
                else:
                    new.append((c, lo, hi, int(upto[k] - n[own[k]]), mine))
        spans = new
    out = {}
    for i, c in enumerate(columns):
        pairs = [(x, found[i, math.floor(x)], found[i, math.ceil(x)]) for x in places[c]]
        out[c] = [a if a == b else (math.ceil(x) - x) * a + (x - math.floor(x)) * b for x, a, b in pairs] or [None] * len(shares)
    return out


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, exact linear quartiles and max of numeric columns; the quartiles are found when this is called."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    aggs, quartiles = [], quantiles(df, columns, (0.25, 0.5, 0.75))
    for c in columns:
        v = F.when(~_missing(df, c), F.col(c)).cast("double")
        aggs += [F.count(v).alias(f"count_{c}"), F.avg(v).alias(f"mean_{c}"), F.stddev_samp(v).alias(f"std_{c}"), F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}")]
    wide = df.agg(*aggs).withColumns({f"q{i + 1}_{c}": F.lit(x).cast("double") for c in columns for i, x in enumerate(quartiles[c])})
    return unpivoted(wide, columns, [("count", "long"), *[(p, "double") for p in ("mean", "std", "min", "q1", "q2", "q3", "max")]])


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, lo, hi, n): equal-width bins between the extremes, empty ones included."""
    x = df.select(F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    ends = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    at = x.crossJoin(F.broadcast(ends)).select(F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("x") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)), F.lit(bins - 1))).otherwise(0).cast("int").alias("bin"))
    counts = at.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", "b")
    width = (F.col("b") - F.col("a")) / bins
    return grid.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    rows = df.filter(F.col(column).isNotNull()) if dropna else df
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def group_mean(df: DataFrame, key: str, value: str, dropna: bool = True) -> DataFrame:
    rows = df.filter(F.col(key).isNotNull()) if dropna else df
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def schema_card(df: DataFrame, order: str, title: str = "Dataset Schema:") -> str:
    """The card's text: shape, then name, type, nulls and first values of each column."""
    n = shape(df).first()
    nulls = {r["column"]: r["n"] for r in null_counts(df).collect()}
    samples: dict[str, list] = {}
    for r in sample_values(df, df.columns, order).orderBy("column", "rank").collect():
        samples.setdefault(r["column"], []).append(r["value"])
    lines = [title, f"Shape: {n['n_rows']} rows x {n['n_columns']} columns", ""]
    for name, kind in df.dtypes:
        lost = f", {nulls[name]} nulls" if nulls[name] else ""
        lines.append(f"- {name} ({CARD_TYPES.get(kind, kind)}{lost}): {', '.join(samples.get(name, []))}")
    return "\n".join(lines)


def schema_rows(df: DataFrame, order: str) -> DataFrame:
    """The card as rows: (name, type, nulls, samples)."""
    kinds = F.create_map(*[F.lit(x) for name, kind in df.dtypes for x in (name, CARD_TYPES.get(kind, kind))])
    firsts = sample_values(df, df.columns, order).groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), ", ").alias("samples"))
    out = null_counts(df).join(firsts, "column", "left")
    return out.select(F.col("column").alias("name"), kinds[F.col("column")].alias("type"), F.col("n").alias("nulls"), F.coalesce("samples", F.lit("")).alias("samples"))


def token_estimate(*texts: str) -> Column:
    """A quarter of each text's length, rounded down, summed over the columns; null counts 0."""
    return sum((F.coalesce(F.floor(F.length(F.col(t)) / 4), F.lit(0)) for t in texts), F.lit(0)).cast("long")


def health(df: DataFrame, key: str, status: str = "status") -> DataFrame:
    """(key, status, errors, components): healthy, degraded or unhealthy by how many are in error."""
    bad = F.sum((F.col(status) == "error").cast("long"))
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(bad.alias("errors"), n.alias("components"), F.when(bad == 0, "healthy").when(bad == n, "unhealthy").otherwise("degraded").alias("status"))
