"""Where intermediate tables go, and how an operator cuts its lineage.

Every intermediate is a Parquet table below ``spark.checkpoint.dir``, the folder all executors share.
A session without that setting (tests on one machine) gets a folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI.  Where the session has none, a fresh folder of this machine, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="tessella-")
        found = _own["dir"]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder: a rerun never meets an older run's files."""
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def put(spark: SparkSession, data: bytes, name: str) -> str:
    """Write ``data`` to a file in the shared folder; its URI."""
    uri = fresh_path(spark, name)
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(data)
    return uri


def get(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no upstream work."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    back = spark.read.schema(schema).parquet(path)
    back.stored_at = path
    return back


#: Arrow bytes that a task of :func:`landed` gathers for one row group.
GROUP_BYTES = 32 << 20


def _lander(path: str, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer, held, size = f"part-{uuid.uuid4().hex}.parquet", None, [], 0
        fs, at = pafs.FileSystem.from_uri(f"{path}/_{name}")
        for batch in made(batches) if made else batches:
            if not batch.num_rows:
                continue
            writer = writer or pq.ParquetWriter(at, batch.schema, filesystem=fs, compression="zstd", compression_level=3)
            held.append(batch)
            size += batch.nbytes
            if size >= GROUP_BYTES:
                writer.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if writer is None:
            return
        if held:
            writer.write_table(pa.Table.from_batches(held))
        writer.close()
        yield pa.RecordBatch.from_pydict({"file": [name]})

    return run


def landed(df: DataFrame, name: str, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = "") -> DataFrame:
    """As :func:`written`, of ``df`` or of the rows with ``schema`` that ``made`` makes of its batches, but the files are
    written by the Python workers: on a local file system without Hadoop's native library the JVM starts three processes
    (``chmod``) per file.  A file's name begins with an underscore, which Spark does not read, until its task counts."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(at, recursive=True)
    for r in df.mapInArrow(_lander(path, made), "file string").collect():
        fs.move(f"{at}/_{r.file}", f"{at}/{r.file}")
    gc.collect()  # the collected DataFrame lies in a cycle of Python's; until it goes, the JVM keeps its shuffle files
    release(spark)
    back = spark.read.schema(schema or df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` or :func:`landed` that nothing reads any more: what was made of them is written too."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Ids that a join may broadcast: 8 MB.
BROADCAST_IDS = 1_000_000


def by_id(docs: DataFrame, ids: DataFrame, key, how: str) -> DataFrame:
    """``docs`` joined (left_semi, left_anti) with a table of ids that is stored: broadcast if their count is at most
    ``BROADCAST_IDS``, so that no text is shuffled, else both sides are dealt by id."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), key, how)


def beside(names: tuple[str, ...], columns: list[str]) -> dict[str, str]:
    """The names that added columns get beside ``columns``: their own, with leading underscores where these are taken."""
    taken, out = {c.lower() for c in columns}, {}
    for name in names:
        out[name] = name
        while out[name].lower() in taken:
            out[name] = "_" + out[name]
        taken.add(out[name].lower())
    return out


def release(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of finished jobs now: Spark does so once the driver's JVM
    has collected what referred to them, which may otherwise come late.  Without a JVM at hand, a no-op."""
    jvm = getattr(getattr(spark, "_sc", None), "_jvm", None)
    if jvm is not None:
        jvm.System.gc()
