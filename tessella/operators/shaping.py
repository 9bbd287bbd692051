"""Frame operations beside the SQL ones: tail, seeded samples, percentile bins, bias-corrected moments, functions of whole groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows in ``order``: a bounded top-n, no full sort."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def sampled(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """About ``fraction`` of the rows, chosen by a hash of their values: the same ones whatever the partitions."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1_000_000)) < int(fraction * 1_000_000))


def qcut(df: DataFrame, column: str, q: int) -> DataFrame:
    """``df`` and ``bin``: the number of inner ``q``-quantiles (exact, linear) below the value; null for a null."""
    edges = df.agg(F.percentile(F.col(column).cast("double"), F.array(*[F.lit(i / q) for i in range(1, q)])).alias("_edges"))
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.when(F.col(column).isNotNull(), F.size(F.filter("_edges", lambda e: F.col(column) > e)))).drop("_edges")


def skew(column: str) -> Column:
    """Bias-corrected sample skewness; null below three values."""
    n = F.count(column)
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(column: str) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(column)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6))


def apply_groups(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """``function(pandas frame) -> pandas frame`` of every group.  A group meets in one task's memory: for keys whose groups are known to fit."""
    return df.groupBy(*keys).applyInPandas(function, schema)


def pipe(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(lambda d, step: step(d), steps, df)


def table_function(handler: type, schema: str, name: str | None = None):
    """``handler`` (a class with ``eval``) as a table function; with ``name`` also for SQL text."""
    made = F.udtf(handler, returnType=schema)
    if name:
        from pyspark.sql import SparkSession

        SparkSession.active().udtf.register(name, made)
    return made
