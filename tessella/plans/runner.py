"""Runs a checked query under a time limit and row and text caps, and classifies what came of it.

A result that a cap cuts carries the mark ``TRUNCATED`` in its text and ``truncated``; the cut is made before rows reach the driver."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.gate import check_sql

# Limits, marks and the conditions after which another try makes sense.
TIMEOUT, CHART_TIMEOUT, MAX_CHARS = 5.0, 10.0, 100_000
TRUNCATED = "\n...[TRUNCATED]"
NO_RESULT = "No result produced."
RETRYABLE = ("UNRESOLVED_COLUMN", "DATATYPE_MISMATCH", "CAST_INVALID_INPUT", "CAST_OVERFLOW", "DIVIDE_BY_ZERO", "INVALID_ARRAY_INDEX", "MAP_KEY_DOES_NOT_EXIST", "FIELD_NOT_FOUND", "UNRESOLVED_ROUTINE", "WRONG_NUM_ARGS", "ARITHMETIC_OVERFLOW", "MISSING_AGGREGATION")


@dataclass
class Result:
    kind: str
    text: str = ""
    error: str | None = None
    retryable: bool = False
    rows: list | None = None
    columns: tuple[str, ...] = ()
    truncated: bool = False


def kind_of(rows: list, columns: list[tuple[str, str]]) -> str:
    """none, scalar, string, series or dataframe, by rows, columns and type."""
    if not rows:
        return "none"
    if len(columns) == 1:
        if len(rows) == 1:
            return "none" if rows[0][0] is None else "string" if columns[0][1] == "string" else "scalar"
        return "series"
    return "dataframe"


def classify(e: Exception) -> tuple[str, bool]:
    condition = e.getCondition() if isinstance(e, PySparkException) else None
    name = condition or type(e).__name__
    return f"{name}: {str(e).splitlines()[0] if str(e) else ''}", any(name.startswith(r) for r in RETRYABLE)


def cap(text: str, limit: int = MAX_CHARS) -> str:
    return text if len(text) <= limit else text[:limit] + TRUNCATED


def bounded(df: DataFrame, max_rows: int, max_chars: int = MAX_CHARS) -> DataFrame:
    """At most ``max_rows`` + 1 rows, and none after those whose texts fill ``max_chars``; a text longer than that is cut behind one more character."""
    short = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).limit(max_rows + 1)
    texts = [f.name for f in short.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType, T.NullType))]
    if not texts:
        return short
    size = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in texts), F.lit(0)).cast("long")
    cut = [F.substring(c, 1, max_chars + 1).alias(c) if isinstance(short.schema[c].dataType, T.StringType) else F.col(c) for c in short.columns]
    # The limit leaves one partition, in order: its rows are numbered as they come.
    before = F.sum("_size").over(Window.orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    return short.withColumns({"_row": F.monotonically_increasing_id(), "_size": size}).withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") <= max_chars).orderBy("_row").select(*cut)


def run(df_of, spark: SparkSession, timeout: float = TIMEOUT, max_rows: int = 1000) -> Result:
    """Collects at most ``max_rows`` of ``df_of()``; after ``timeout`` seconds its jobs are cancelled."""
    sc, group = spark.sparkContext, f"tessella-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(timeout, stop)
    timer.daemon = True
    sc.setJobGroup(group, "ad-hoc query", interruptOnCancel=True)
    timer.start()
    try:
        df: DataFrame = df_of()
        rows = bounded(df, max_rows).collect()
        whole = len(rows) <= max_rows and (len(rows) < 2 or sum(len(v) for r in rows for v in r if isinstance(v, str)) <= MAX_CHARS)
    except Exception as e:
        if late.is_set():
            return Result("error", error=f"TIMEOUT: stopped after {timeout:g} s")
        error, again = classify(e)
        return Result("error", error=error, retryable=again)
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    rows = rows[:max_rows]
    kind = kind_of(rows, df.dtypes)
    if kind == "none":
        text = NO_RESULT
    elif kind in ("scalar", "string"):
        text = str(rows[0][0])
    else:
        text = "\n".join(["\t".join(df.columns), *["\t".join("" if v is None else str(v) for v in r) for r in rows]])
    shown = cap(text)
    if not whole and shown == text:
        shown += TRUNCATED
    return Result(kind, shown, rows=rows, columns=tuple(df.columns), truncated=shown != text)


def run_sql(spark: SparkSession, sql: str, timeout: float = TIMEOUT, max_rows: int = 1000, columns: set[str] | None = None) -> Result:
    """``columns``: the known columns of the tables, if the query may read no others."""
    checked = check_sql(spark, sql, columns)
    if not checked.is_valid:
        return Result("error", error="; ".join(checked.violations), retryable=any(v.startswith(RETRYABLE) for v in checked.violations))
    return run(lambda: spark.sql(checked.sql), spark, timeout, max_rows)
