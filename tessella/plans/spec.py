"""A structured query: what to read, derive, filter, group, order and limit, as data.

Expressions are SQL text over the table's columns; Spark's analyzer checks names and types.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Join:
    table: str
    on: list[str] | str
    how: str = "inner"


@dataclass
class QuerySpec:
    """Steps apply in the order of the fields."""

    table: str
    joins: list[Join] = field(default_factory=list)
    derive: dict[str, str] = field(default_factory=dict)
    where: list[str] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    agg: dict[str, str] = field(default_factory=dict)
    window: dict[str, str] = field(default_factory=dict)
    having: list[str] = field(default_factory=list)
    select: list[str] = field(default_factory=list)
    union: list[QuerySpec] = field(default_factory=list)
    distinct: bool = False
    order_by: list[str] = field(default_factory=list)
    limit: int | None = None
    keep_null_groups: bool = False


def build(spec: QuerySpec, tables: dict[str, DataFrame]) -> DataFrame:
    df = tables[spec.table]
    for j in spec.joins:
        on = F.expr(j.on) if isinstance(j.on, str) else j.on
        df = df.join(tables[j.table], on, j.how) if j.how != "cross" else df.crossJoin(tables[j.table])
    for name, text in spec.derive.items():
        df = df.withColumn(name, F.expr(text))
    for text in spec.where:
        df = df.filter(text)
    if spec.agg or spec.group_by:
        if not spec.keep_null_groups:
            for g in spec.group_by:
                df = df.filter(F.col(g).isNotNull())
        df = df.groupBy(*spec.group_by).agg(*[F.expr(t).alias(n) for n, t in (spec.agg or {"n": "count(1)"}).items()])
    for name, text in spec.window.items():
        df = df.withColumn(name, F.expr(text))
    for text in spec.having:
        df = df.filter(text)
    if spec.select:
        df = df.selectExpr(*spec.select)
    for other in spec.union:
        df = df.unionByName(build(other, tables))
    if spec.distinct:
        df = df.distinct()
    if spec.order_by:
        df = df.orderBy(*[F.expr(o[1:]).desc() if o.startswith("-") else F.expr(o).asc() for o in spec.order_by])
    return df if spec.limit is None else df.limit(spec.limit)
