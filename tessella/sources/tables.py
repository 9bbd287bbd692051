"""Sources and sinks: typed CSV, Parquet tables, the message log, vector collections, text rendering."""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that pandas-like CSV reading takes as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
MESSAGES = "id string not null, session_id string not null, role string not null, content string not null, image_base64 string, timestamp timestamp not null, agent_trace string"
COLLECTIONS = ("execution_cache", "visualization_cache", "chat_history")
POINTS = "id string, embedding array<float>, session_id string, payload string"
#: Points lie in so many folders by a hash of the session: a session's search reads one of them.
SESSION_PARTS = 64
PASSENGERS = "PassengerId long, Survived long, Pclass long, Name string, Sex string, Age double, SibSp long, Parch long, Ticket string, Fare double, Cabin string, Embarked string"
NO_RESULT = "No result produced."
MORE = "\n...[TRUNCATED]"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str | None = None, schema: str = PASSENGERS, env: str = "TABLE_CSV_PATH") -> DataFrame:
    """A CSV with a header, quoted fields and a declared schema; missing-value texts become nulls.

    Without ``path`` the environment variable ``env`` names it.  A missing file raises FileNotFoundError; a cell that
    does not fit its type fails the read."""
    path = path or os.environ.get(env, "")
    if not path or not exists(spark, path):
        raise FileNotFoundError(path or env)
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in declared])).csv(path, header=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False, multiLine=True)
    known = lambda c: F.when(~F.col(c).isin(*MISSING), F.col(c))
    return raw.select(*[known(f.name).cast(f.dataType).alias(f.name) for f in declared])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def init_log(spark: SparkSession, path: str) -> None:
    """Creates the log if it is missing."""
    if not exists(spark, path):
        reset_log(spark, path)


def reset_log(spark: SparkSession, path: str) -> None:
    """Drops and recreates the log, empty."""
    spark.createDataFrame([], MESSAGES).write.mode("overwrite").parquet(path)


def save_messages(rows: DataFrame, path: str) -> None:
    """Appends rows (session_id, role, content and optionally the rest); id and UTC time are filled in."""
    given = set(rows.columns)
    part = lambda c, other: F.coalesce(F.col(c), other) if c in given else other
    null = F.lit(None).cast("string")
    rows.select(part("id", F.expr("uuid()")).alias("id"), "session_id", "role", "content", part("image_base64", null).alias("image_base64"), part("timestamp", F.current_timestamp()).alias("timestamp"), part("agent_trace", null).alias("agent_trace")).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGES).parquet(path)


def collection_path(folder: str, name: str) -> str:
    if name not in COLLECTIONS:
        raise ValueError(f"unknown collection {name}")
    return f"{folder}/{name}"


def init_collections(spark: SparkSession, folder: str, force: bool = False) -> None:
    for name in COLLECTIONS:
        if force or not exists(spark, collection_path(folder, name)):
            spark.createDataFrame([], POINTS + ", part int").write.mode("overwrite").parquet(collection_path(folder, name))


def upsert_points(rows: DataFrame, folder: str, name: str) -> None:
    """Appends points (embedding, session_id, payload struct or string) with ids of their own."""
    payload = F.col("payload") if dict(rows.dtypes)["payload"] == "string" else F.to_json("payload")
    rows.select(F.expr("uuid()").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("session_id").cast("string").alias("session_id"), payload.alias("payload"), _part(F.col("session_id")).alias("part")).write.mode("append").partitionBy("part").parquet(collection_path(folder, name))


def _part(session: Column) -> Column:
    return F.pmod(F.xxhash64(session.cast("string")), F.lit(SESSION_PARTS)).cast("int")


def read_points(spark: SparkSession, folder: str, name: str, session: str | None = None) -> DataFrame:
    """The collection, or only the points of ``session``; empty where it is missing."""
    path = collection_path(folder, name)
    if not exists(spark, path):
        return spark.createDataFrame([], POINTS)
    rows = spark.read.schema(POINTS + ", part int").parquet(path)
    if session is not None:
        part = spark.range(1).select(_part(F.lit(session))).first()[0]
        rows = rows.filter((F.col("part") == part) & (F.col("session_id") == session))
    return rows.drop("part")


def write_entries(entries: DataFrame, folder: str) -> None:
    """Appends rows (collection, embedding, session_id, payload) to their collections."""
    for name in COLLECTIONS:
        upsert_points(entries.filter(F.col("collection") == name), folder, name)


def probe(spark: SparkSession, checks: dict[str, Callable[[], object]]) -> DataFrame:
    """(component, status, detail) of each check: ok, or error with what it raised."""
    rows = []
    for name, check in checks.items():
        try:
            rows.append((name, "ok", str(check() or "")))
        except Exception as e:  # a probe reports whatever fails
            rows.append((name, "error", f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "component string, status string, detail string")


def embed(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], into: str = "embedding") -> DataFrame:
    """Adds vectors from a pluggable embedder, batch by batch."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder(texts.fillna("").tolist()))

    return df.withColumn(into, run(F.col(text)))


def render(df: DataFrame | None, limit: int = 1000) -> str:
    """A bounded number of rows as text, with a mark where there are more."""
    if df is None:
        return NO_RESULT
    rows = df.limit(limit + 1).toPandas()
    if not len(rows):
        return NO_RESULT
    return rows.head(limit).to_string() + (MORE if len(rows) > limit else "")


def sse_lines(steps: DataFrame, order: Column | str) -> DataFrame:
    """Step rows as ``data: {...}`` lines."""
    return steps.select(order, F.concat(F.lit("data: "), F.to_json(F.struct(*[c for c in steps.columns if c != order]))).alias("line"))


def parse_sse(lines: DataFrame, schema: str = "type string, name string, content string") -> DataFrame:
    """The events of ``lines(line)``: other lines and bad JSON are skipped."""
    raw = F.when(F.col("line").startswith("data: "), F.substring("line", 7, 2**31 - 1))
    event = F.from_json(raw, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("e", event).filter("e is not null and e._bad is null").select(*[c for c in lines.columns if c != "line"], "e.*").drop("_bad")
