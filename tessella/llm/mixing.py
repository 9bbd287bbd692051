"""Operator 8: mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Rows of a source are cut into blocks of about ``block_bytes``; a slot takes one block.  With w(s) the share of source s, its block j
is released at slot floor(j / w) and due by slot ceil((j + 1) / w).  Every slot takes the released block with the earliest
deadline, so at any time every source is less than one block from its share.  Shares are whole multiples of 2**-40
(``UNITS``), and all times are exact integers; there is no rounding to a frame that could add up.

Scale: the slots are cut in stretches, which are scheduled apart from each other.  The blocks done at the boundary between
two stretches are found by earliest deadline first over the ``window`` slots before it, begun from the shares there rounded up for the sources
whose next deadlines are earliest.  A schedule can go on from such a start, since for any later slot y no more blocks are due by y than there are slots; and it can be
reached from any earlier such boundary, as the window is no shorter than the time from a block's release to its deadline.  So each
stretch is the blocks between two boundaries, taken earliest deadline first.  Blocks themselves are formed inside (source, part), where
parts are dealt by a hash and hold about ``PART_BLOCKS`` blocks, so no source, however large, meets in one task.
A stretch is at least as long as the longest window: a source of share 1/n makes stretches of n slots, which one task schedules.
The driver sees one row per source; more than ``MAX_SOURCES`` sources are refused.  A schedule has a row per block, and is joined by (source, block), not broadcast.

A phase ends when the next slots would need a block that a source no longer has; the weights of the others are scaled up and a new phase begins, so all rows are
placed.  ``on_target`` marks the first phase, which keeps to the full targets.

A null source is a source of its own; a null text has the bytes of an empty one; every row counts 8 bytes
more than its text.  Repeated rows are placed each.  Sources without a given weight get 0: they follow
when the others are dry.  Negative, infinite and NaN weights are refused; positive ones count one unit at least.  Empty tables give no rows.
A column of the input keeps its name and values; an added one whose name is taken gets leading underscores (``added``).
"""

from __future__ import annotations

import json
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import store

BLOCK_BYTES, PART_BLOCKS, MAX_SOURCES = 1 << 16, 64, 2000
UNITS, STRETCH = 1 << 40, 1024
ADDED = ("mix_slot", "mix_rank", "mix_block", "mix_phase", "on_target")


def shares(weights: list[float]) -> list[int]:
    """Shares in units: whole numbers, at least 1 for a positive weight; their sum is the unit total."""
    if any(not math.isfinite(w) or w < 0 for w in weights):
        raise ValueError("weights must be finite and not negative")
    exact = [Fraction(w) for w in weights]
    total = sum(exact)
    return [max(1, round(w * UNITS / total)) if w else 0 for w in exact]


def plan_phases(blocks: list[int], weights: list[float], stretch: int = STRETCH) -> list[dict]:
    """Phases that place all blocks of all sources: their first slot, length, window and stretch, and per source (those with
    a share) the share, the blocks before the phase and the blocks in it."""
    left, phases, slot = list(blocks), [], 0
    given = shares(weights)
    # The first phase ends before any source is short of a block; the later ones end with a source's last block.
    full = True
    while any(left):
        active = [s for s, n in enumerate(left) if n and given[s]] or [s for s, n in enumerate(left) if n]
        unit = {s: given[s] or 1 for s in active}
        total = sum(unit.values())
        if full:
            length = min(left[s] * total // unit[s] for s in active)
        else:
            length = min(-(-left[s] * total // unit[s]) for s in active)
        done = {s: unit[s] * length // total for s in active}
        # Blocks that are under way at the end: those released first are in the phase.
        under_way = sorted((s for s in active if unit[s] * length % total), key=lambda s: (done[s] * total // unit[s], s))
        for s in under_way[: length - sum(done.values())]:
            done[s] += 1
        done = {s: min(left[s], n) for s, n in done.items()}
        placed = sum(done.values())
        if placed:
            window = min(length, max(-(-total // u) for u in unit.values()) + 2)
            phases.append({"p": len(phases), "slot": slot, "length": length, "total": total, "window": window, "stretch": max(stretch, 2 * window), "on_target": full and bool(any(given)),
                           "s": active, "unit": [unit[s] for s in active], "first": [blocks[s] - left[s] for s in active], "done": [done[s] for s in active]})
        for s, n in done.items():
            left[s] -= n
        slot += placed
        full = False
    return phases


_KIND = "array<struct<p: int, slot: bigint, length: bigint, total: bigint, window: bigint, stretch: bigint, on_target: boolean, s: array<int>, unit: array<bigint>, first: array<bigint>, done: array<bigint>>>"


def _edf(length: str, start: str, rest: str, last: str, kept: bool) -> str:
    """SQL: earliest deadline first over ``length`` slots.  Of source i: ``unit[i]``; at the first slot ``start[i]`` blocks since the last whole one are done and
    ``rest[i]`` units are over; no block from number ``last[i]`` on (null: no limit).  Gives the blocks done, or, if ``kept``, the source of each slot.

    Where no block is released, which happens only after a source's last block, the one released first is taken."""
    pick = f"""array_min(transform(filter(sequence(0, size(unit) - 1), i -> a.done[i] < coalesce({last}[i], a.done[i] + 1)),
      i -> struct(
        if((a.done[i] * total - {rest}[i]) <= cast(t as bigint) * unit[i] + unit[i] - 1, 0, 1) as late,
        if((a.done[i] * total - {rest}[i]) <= cast(t as bigint) * unit[i] + unit[i] - 1, ((a.done[i] + 1) * total - {rest}[i] + unit[i] - 1) div unit[i], (a.done[i] * total - {rest}[i]) div unit[i]) as due,
        i as i))).i"""
    step = f"""transform(array({pick}), b -> named_struct('done', transform(a.done, (d, i) -> if(i = b, d + 1, d)), 'made', {"array_append(a.made, b)" if kept else "a.made"}))[0]"""
    # In runs of 512 slots, so that no long array is copied slot by slot.
    return f"""aggregate(
      if({length} > 0, sequence(0, ({length} - 1) div 512), cast(array() as array<bigint>)),
      named_struct('done', {start}, 'runs', cast(array() as array<array<int>>)),
      (o, r) -> transform(array(aggregate(
          sequence(r * 512, least({length}, (r + 1) * 512) - 1),
          named_struct('done', o.done, 'made', cast(array() as array<int>)),
          (a, t) -> {step})),
        x -> named_struct('done', x.done, 'runs', {"array_append(o.runs, x.made)" if kept else "o.runs"}))[0],
      o -> {"flatten(o.runs)" if kept else "o.done"})"""


def schedule(spark: SparkSession, phases: list[dict]) -> DataFrame:
    """(s, mix_block, mix_slot, mix_phase, on_target): a row per block."""
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(phases)), _KIND)).alias("x")).select("x.*")
    over = lambda at, i: f"(cast(unit[{i}] as decimal(20,0)) * {at})"
    # Boundaries: k * stretch, and the phase's end, whose blocks are given.
    edges = table.withColumn("k", F.explode(F.expr("sequence(0L, (length + stretch - 1) div stretch)"))).withColumn("at", F.expr("least(k * stretch, length)"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = edges.repartition(parts, "p", "k").withColumn("from", F.expr("greatest(0, at - window)"))

    def split(df: DataFrame, at: str, whole: str, rest: str) -> DataFrame:
        """Whole blocks and units over of every source at slot ``at``."""
        got = df.withColumn(whole, F.expr(f"transform(unit, (u, i) -> {over(at, 'i')} div total)"))
        return got.withColumn(rest, F.expr(f"transform(unit, (u, i) -> cast({over(at, 'i')} - cast({whole}[i] as decimal(20,0)) * total as bigint))"))

    edges = split(edges, "from", "whole", "rest")
    # The shares rounded up for those under way whose deadlines come first.
    ahead = """transform(slice(array_sort(transform(filter(sequence(0, size(unit) - 1), i -> rest[i] > 0), i -> struct((total - rest[i] + unit[i] - 1) div unit[i] as due, i as i))),
      1, cast(`from` - aggregate(whole, 0L, (x, y) -> x + y) as int)), x -> x.i)"""
    edges = edges.withColumn("ahead", F.expr(ahead)).withColumn("start", F.expr("transform(unit, (u, i) -> if(array_contains(ahead, i), 1L, 0L))"))
    edges = edges.withColumn("done_at", F.expr(f"case when at = length then done when at = 0 then transform(unit, u -> 0L) else zip_with(whole, {_edf('(at - `from`)', 'start', 'rest', 'transform(unit, u -> cast(null as bigint))', False)}, (x, y) -> x + y) end"))
    known = store.written(edges.select("p", "k", "at", "done_at"), "edges")
    after = known.select("p", (F.col("k") - 1).alias("k"), F.col("done_at").alias("until"))
    rows = known.filter("k >= 0").join(after, ["p", "k"]).join(F.broadcast(table), "p")
    rows = split(rows.repartition(parts, "p", "k"), "at", "whole", "rest")
    rows = rows.withColumn("begun", F.expr("zip_with(done_at, whole, (x, y) -> x - y)")).withColumn("last", F.expr("zip_with(until, whole, (x, y) -> x - y)"))
    rows = rows.withColumn("size", F.expr("aggregate(zip_with(until, done_at, (x, y) -> x - y), 0L, (x, y) -> x + y)"))
    rows = rows.withColumn("made", F.expr(_edf("size", "begun", "rest", "last", True)))
    # A block's number: the done ones of its source and its place among the source's slots of this stretch.
    rows = rows.withColumn("of", F.explode(F.expr("sequence(0, size(unit) - 1)")))
    rows = rows.withColumn("slots", F.expr("filter(transform(made, (b, x) -> if(b = of, x, null)), x -> x is not null)"))
    rows = rows.select("p", "slot", "on_target", F.expr("s[of]").alias("s"), F.expr("first[of] + done_at[of]").alias("_from"), "at", F.posexplode("slots").alias("j", "x"))
    return rows.select("s", (F.col("_from") + F.col("j")).alias("mix_block"), (F.col("slot") + F.col("at") + F.col("x")).alias("mix_slot"), F.col("p").alias("mix_phase"), "on_target")


def added(columns: list[str]) -> dict[str, str]:
    """The names that the added columns get beside ``columns``."""
    return store.beside(ADDED, columns)


def text_bytes() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, block_bytes: int = BLOCK_BYTES, stretch: int = STRETCH, n_bytes: Column | None = None, spread: Column | None = None) -> DataFrame:
    """``docs`` and mix_slot, mix_rank (their order is the mixture's), mix_block, mix_phase, on_target.

    ``weights``: by source; else bytes of the source to the power ``alpha``.  ``n_bytes`` and ``spread``, a row's bytes and what it is dealt by, are
    taken from doc_id and text unless given: a caller that needs no text can leave it out of the shuffle."""
    spark = docs.sparkSession
    size = (text_bytes() if n_bytes is None else n_bytes) + 8
    stats = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(size).alias("bytes")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    target = [float(weights.get(r.source, 0.0)) if weights is not None else float(r.bytes) ** alpha for r in stats]
    shares(target)
    names = [{"source": r.source, "s": i, "parts": max(1, r.bytes // (PART_BLOCKS * block_bytes))} for i, r in enumerate(stats)]
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(names)), "array<struct<source: string, s: int, parts: bigint>>")).alias("x")).select(F.col("x.source").alias("_name"), F.col("x.s").alias("_s"), F.col("x.parts").alias("_parts"))
    # The input's columns travel under names of their own.
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    dealt = F.xxhash64("doc_id", F.col("text") if spread is None else spread)
    rows = docs.select(*[F.col(c).alias(n) for c, n in own.items()], F.col("source").cast("string").alias("_source"), F.col("doc_id").alias("_id"), dealt.alias("_h"), size.alias("_size"))
    rows = rows.join(F.broadcast(table), F.col("_source").eqNullSafe(F.col("_name"))).withColumn("_part", F.pmod("_h", "_parts"))
    inside = W.partitionBy("_s", "_part").orderBy("_h", "_id")
    rows = rows.withColumn("_cell", F.floor((F.sum("_size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")) / block_bytes))
    rows = rows.withColumn("_local", F.dense_rank().over(W.partitionBy("_s", "_part").orderBy("_cell")) - 1)
    rows = rows.withColumn("mix_rank", F.row_number().over(W.partitionBy("_s", "_part", "_cell").orderBy("_h", "_id")) - 1)
    rows = store.written(rows.drop("_name", "_source", "_id", "_cell", "_parts", "_size", "_h"), "blocks")
    parts = rows.groupBy("_s", "_part").agg((F.max("_local") + 1).alias("_n"))
    before = store.written(parts.select("_s", "_part", "_n", (F.sum("_n").over(W.partitionBy("_s").orderBy("_part")) - F.col("_n")).alias("_before")), "parts")
    blocks = {r["_s"]: r["n"] for r in before.groupBy("_s").agg(F.sum("_n").alias("n")).collect()}
    # One row per block, keyed by the part it lies in: joined with the rows of a part in one step.
    slots = schedule(spark, plan_phases([blocks.get(i, 0) for i in range(len(stats))], target, stretch))
    numbered = before.select("_s", "_part", F.explode(F.expr("sequence(0L, _n - 1)")).alias("_local"), "_before").withColumn("mix_block", F.col("_before") + F.col("_local"))
    slots = store.written(numbered.join(slots.withColumnRenamed("s", "_s"), ["_s", "mix_block"]).drop("_before"), "slots")
    rows = rows.join(slots, ["_s", "_part", "_local"])
    return rows.select(*[F.col(n).alias(c) for c, n in own.items()], *[F.col(c).cast("boolean" if c == "on_target" else "long").alias(n) for c, n in added(docs.columns).items()])


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mixture; targets: bytes of the source to the power 0.5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", text_bytes().alias("n_bytes"), F.xxhash64("text").alias("text_hash"))
    return mix(docs, n_bytes=F.col("n_bytes"), spread=F.col("text_hash")).drop("n_bytes", "text_hash")
