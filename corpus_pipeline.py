"""The corpus pipeline: toxicity, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each
stage's rows as Parquet in the shared folder and rereads them, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, minhash, mixing, shards, store, toxicity

#: Bytes a shard should hold.
SHARD_BYTES = 64 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 9, fitted on the labelled rows, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(toxicity.training_rows(docs, labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that operator 2 links: five-word shingles, similarity 0.8."""
    return minhash.one_of_each(docs, shingle=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which operator 3 finds no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of operator 8: the rows of file k stand before those of file k + 1."""
    mixed, names = mixing.mix(docs), mixing.added(docs.columns)
    order = (names["mix_slot"], names["mix_rank"])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return mixed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the shard and slot of operator 5; slots follow the mixture's order, which
    is the order of the files and of the rows in them."""
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    placed = docs.withColumn("_place", F.shiftleft(number, 40) + F.col("_metadata.row_index"))
    return shards.kd_shards(placed, target_bytes=SHARD_BYTES, order="_place", keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No stage but the last could be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, store.written(stage(spark, docs, sf_dir), name)
        if k:
            store.discard(before)
    return docs
