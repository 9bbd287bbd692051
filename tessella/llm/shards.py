"""Operator 5: shards of near-equal bytes by a k-d tree over metadata.

Each document is a point: one coordinate per metadata dimension, ordered by (value, hash of the text,
hash of the id), so equal texts are neighbours along every dimension and a cut parts them only
where balance asks for it.  A node that has to become k shards is cut along its widest dimension
at the weighted quantile floor(k/2)/k of its bytes; leaves are the shards.  Quantiles are exact up
to ``TOLERANCE`` of a shard: each round counts bytes in ``BINS`` intervals of the interval that
still holds the cut, for all nodes of a level at once.  Down to ``CELLS`` nodes a row per node and interval reaches
the driver, and the cuts are constants in the plan; below, nodes and their cuts are a table, each level and round is a few joins and sums by node, and nothing
reaches the driver but a count.  Nodes of a level hold about equal bytes, so these joins have no hot key.  Neither the driver nor a plan grows with
the number of shards or documents.

``shards`` may be left out: then it follows from ``target_bytes``, the bytes a leaf should hold.
Sizes are UTF-8 bytes of the text (null: none) plus 8.  Null metadata sort first.  Repeated rows each
take a slot; empty tables give no rows.  Only doc_id, text and the dimensions are read.  Kept columns keep their names and values; an added one
whose name is taken gets leading underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import store

BINS, TOLERANCE = 1024, 0.0005
#: Bits of a coordinate for value, text hash and id hash.
VALUE_BITS, TEXT_BITS, ID_BITS = 20, 22, 20
SLOT_BUCKETS = 64
#: Nodes of a level that the driver cuts; rows of a table of nodes or slots that a join may broadcast.
CELLS, BROADCAST_ROWS = 256, 200_000


def default_dimensions() -> dict[str, Column]:
    """Values in 0..1: length on a logarithmic scale up to 1 TB, and source and language by hash."""
    named = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) / F.lit(2.0**32), F.lit(0.0))
    return {"size": F.log2(F.col("size")) / 40, "source": named("source"), "lang": named("lang")}


def _points(docs: DataFrame, dimensions: dict[str, Column], keep: list[tuple[str, str]]) -> DataFrame:
    """``keep``: columns of ``docs`` and their names in the result; no column of ``docs`` travels under its own name but doc_id and what the dimensions read."""
    read = ["doc_id", "text", "source", "lang"] if dimensions is None else docs.columns
    docs = docs.select(*[F.col(c) for c in docs.columns if c in read], *[F.col(c).alias(n) for c, n in keep])
    dimensions = dimensions or default_dimensions()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.withColumns({"size": F.octet_length(text).cast("long") + 8, "text_crc32": F.crc32(text.cast("binary")), "_text": F.xxhash64(text)})
    low = F.shiftleft(F.pmod("_text", F.lit(1 << TEXT_BITS)), ID_BITS) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))
    top = (1 << VALUE_BITS) - 1
    value = lambda c: F.least(F.greatest(F.floor(c * top), F.lit(0)), F.lit(top)).cast("long")
    keys = {f"k{i}": F.shiftleft(value(c), TEXT_BITS + ID_BITS) + low for i, c in enumerate(dimensions.values())}
    return sized.select("doc_id", "size", "text_crc32", *[n for _, n in keep], *[c.alias(k) for k, c in keys.items()])


def _of(nodes: list[dict], name: str) -> Column:
    """The value ``name`` of a row's node, out of a constant array over a level's nodes (consecutive
    numbers); null for rows in other nodes and for nodes without it.  No join: the plan's rows stay those of the table."""
    values = ", ".join("null" if n.get(name) is None else f"{n[name]}L" for n in nodes)
    return F.expr(f"get(cast(array({values}) as array<bigint>), cast(node as int) - {nodes[0]['node']})")


def _cuts(points: DataFrame, nodes: list[dict], dims: int) -> None:
    """Sets ``dim`` and ``cut`` (first key on the right) of every node; ``points`` has ``node``."""
    ranges = points.groupBy("node").agg(F.sum("size").alias("w"), *[f(f"k{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))])
    found = {r["node"]: r for r in ranges.collect()}
    open_nodes = []
    for n in nodes:
        r = found.get(n["node"])
        if r is None:
            n |= {"dim": 0, "cut": 0}
            continue
        n["dim"] = max(range(dims), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) >> (TEXT_BITS + ID_BITS), -i))
        n |= {"lo": r[f"lo{n['dim']}"], "hi": r[f"hi{n['dim']}"], "before": 0, "goal": r["w"] * n["left"] / n["k"], "slack": TOLERANCE * r["w"] / n["k"]}
        open_nodes.append(n)
    while open_nodes:
        active = {n["node"] for n in open_nodes}
        told = [{"node": n["node"]} | ({"dim": n["dim"], "lo": n["lo"], "hi": n["hi"], "width": (n["hi"] - n["lo"]) // BINS + 1} if n["node"] in active else {}) for n in nodes]
        at = points.withColumns({f"_{c}": _of(told, c) for c in ("dim", "lo", "hi", "width")}).filter("_dim is not null")
        key = F.coalesce(*[F.when(F.col("_dim") == i, F.col(f"k{i}")) for i in range(dims)])
        at = at.withColumn("_key", key).filter("_key between _lo and _hi").withColumn("bin", F.expr("(_key - _lo) div _width"))
        bins: dict[int, list] = {}
        for r in at.groupBy("node", "bin").agg(F.sum("size").alias("w")).collect():
            bins.setdefault(r["node"], []).append((r["bin"], r["w"]))
        again = []
        for n in open_nodes:
            width = (n["hi"] - n["lo"]) // BINS + 1
            for b, w in sorted(bins[n["node"]]):
                if n["before"] + w >= n["goal"] or b == max(x for x, _ in bins[n["node"]]):
                    break
                n["before"] += w
            lo = n["lo"] + b * width
            if w <= n["slack"] or width == 1:
                # The interval goes where it brings the left side nearer to its goal.
                n["cut"] = lo + width if n["before"] + w - n["goal"] < n["goal"] - n["before"] else lo
            else:
                n["lo"], n["hi"] = lo, lo + width - 1
                again.append(n)
        open_nodes = again


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int = 256 << 20, dimensions: dict[str, Column] | None = None, order: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, ``keep`` (other columns of ``docs``), shard, slot.

    Slots follow ``order`` (a long column of ``docs``) or else a hash of the id."""
    dims = len(dimensions or default_dimensions())
    used = [(order, "_order")] if order else []
    kept = {c: f"_x{i}" for i, c in enumerate(keep)}
    points = store.written(_points(docs, dimensions, used), "points")
    if shards is None:
        total = points.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    nodes = [{"node": 0, "k": shards, "left": shards // 2, "first": 0}] if shards > 1 else []
    cuts: dict[int, dict] = {}
    made = 0
    while nodes and len(nodes) <= CELLS:
        _cuts(_place(points, cuts), nodes, dims)
        below = []
        for n in nodes:
            ids = []
            for k, first in ((n["left"], n["first"]), (n["k"] - n["left"], n["first"] + n["left"])):
                if k > 1:
                    made += 1
                    below.append({"node": made, "k": k, "left": k // 2, "first": first})
                    ids.append(made)
                else:
                    ids.append(-1)
            cuts[n["node"]] = {"dim": n["dim"], "cut": n["cut"], "l": ids[0], "r": ids[1], "sl": n["first"], "sr": n["first"] + n["left"]}
        nodes = below
    at = F.col("_order") if order else F.xxhash64("doc_id")
    keys = [f"k{i}" for i in range(dims)]
    located = _place(points, cuts)
    if nodes:
        located = _below(located, nodes, shards, dims)
    narrow = store.written(located.withColumn("_at", at).select("doc_id", "size", "text_crc32", "shard", "_at", *(keys if nodes else [])), "placed")
    wide = narrow
    if keep:
        # Kept columns come from the documents anew.  Down to the driver's cells they are placed by the same cuts and shuffled once, for their slots.
        wide = _points(docs, dimensions, used + list(kept.items())).withColumn("_at", at)
        wide = wide.join(narrow.select(*keys, "shard").distinct(), keys) if nodes else _place(wide, cuts)
        wide = wide.select("doc_id", "size", "text_crc32", *kept.values(), "shard", "_at")
    names = store.beside(("size", "text_crc32", "shard", "slot"), ["doc_id", *keep])
    return _slots(narrow, wide, shards).select("doc_id", *[F.col(c).alias(names[c]) for c in ("size", "text_crc32")], *[F.col(n).alias(c) for c, n in kept.items()], *[F.col(c).alias(names[c]) for c in ("shard", "slot")])


def _few(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table.hint("merge")


def _below(located: DataFrame, nodes: list[dict], shards: int, dims: int) -> DataFrame:
    """Cuts the driver's last cells down to shards.  A node is the range of shards from ``shard``, ``_k`` of them."""
    # The driver's cells: at most twice ``CELLS``, as constants.
    count = F.coalesce(*[F.when(F.col("node") == n["node"], F.lit(n["k"])) for n in nodes], F.lit(1))
    first = F.coalesce(*[F.when(F.col("node") == n["node"], F.lit(n["first"])) for n in nodes], F.col("shard"))
    points = store.written(located.withColumns({"_k": count.cast("long"), "shard": first.cast("long")}).drop("node"), "cells")
    most = max(n["k"] for n in nodes)
    while most > 1:
        cells = _table_cuts(points, shards, dims)
        done = points.filter("_k = 1")
        key = F.element_at(F.array(*[f"k{i}" for i in range(dims)]), F.col("_dim") + 1)
        left = F.expr("_k div 2")
        cut = points.filter("_k > 1").join(_few(cells.select("shard", "_dim", "_cut"), shards), "shard").withColumn("_right", key >= F.col("_cut"))
        cut = cut.withColumn("shard", F.when(F.col("_right"), F.col("shard") + left).otherwise(F.col("shard"))).withColumn("_k", F.when(F.col("_right"), F.col("_k") - left).otherwise(left))
        before, points = points, store.written(done.select(*points.columns).union(cut.select(*points.columns)), "cells")
        store.discard(before, cells)
        most -= most // 2
    return points


def _table_cuts(points: DataFrame, shards: int, dims: int) -> DataFrame:
    """(shard, _dim, _cut) of every node with more than one shard: as ``_cuts``, with the nodes as a table."""
    each = lambda name: F.array(*[f"{name}{i}" for i in range(dims)])
    ranges = points.filter("_k > 1").groupBy("shard", "_k").agg(F.sum("size").alias("_w"), *[f(f"k{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))])
    wide = F.transform(F.arrays_zip(each("lo").alias("a"), each("hi").alias("b")), lambda x: F.shiftright(x["b"] - x["a"], TEXT_BITS + ID_BITS))
    ranges = ranges.withColumn("_dim", (F.array_position(wide, F.array_max(wide)) - 1).cast("int"))
    share = F.col("_w").cast("double") / F.col("_k")
    cells = store.written(
        ranges.select("shard", "_dim", F.element_at(each("lo"), F.col("_dim") + 1).alias("_lo"), F.element_at(each("hi"), F.col("_dim") + 1).alias("_hi"), F.lit(0).cast("long").alias("_before"), (F.expr("_w * (_k div 2)") / F.col("_k")).alias("_goal"), (TOLERANCE * share).alias("_slack"), F.lit(None).cast("long").alias("_cut")),
        "nodes",
    )
    key = F.element_at(F.array(*[f"k{i}" for i in range(dims)]), F.col("_dim") + 1)
    width = F.expr(f"(_hi - _lo) div {BINS} + 1")
    while not (left := cells.filter("_cut is null")).isEmpty():
        at = points.filter("_k > 1").select("shard", "size", *[f"k{i}" for i in range(dims)]).join(_few(left.select("shard", "_dim", "_lo", "_hi"), shards), "shard")
        at = at.withColumn("_key", key).filter("_key between _lo and _hi").withColumn("_bin", F.expr(f"(_key - _lo) div ((_hi - _lo) div {BINS} + 1)"))
        sums = at.groupBy("shard", "_bin").agg(F.sum("size").alias("_n"))
        sums = sums.withColumn("_sum", F.sum("_n").over(W.partitionBy("shard").orderBy("_bin"))).withColumn("_last", F.max("_bin").over(W.partitionBy("shard")))
        chosen = sums.join(_few(left.select("shard", "_before", "_goal"), shards), "shard").filter("_before + _sum >= _goal or _bin = _last")
        chosen = chosen.groupBy("shard").agg(F.min_by(F.struct("_bin", "_n", "_sum"), "_bin").alias("_x"))
        got = left.join(chosen, "shard").withColumns({"_width": width, "_before": F.col("_before") + F.expr("_x._sum - _x._n")}).withColumn("_lo", F.col("_lo") + F.expr("_x._bin * _width"))
        settled = F.expr("_x._n <= _slack or _width = 1")
        cut = F.when(F.expr("_before + _x._n - _goal < _goal - _before"), F.col("_lo") + F.col("_width")).otherwise(F.col("_lo"))
        got = got.withColumns({"_cut": F.when(settled, cut), "_hi": F.col("_lo") + F.col("_width") - 1})
        before, cells = cells, store.written(cells.filter("_cut is not null").union(got.select(*cells.columns)), "nodes")
        store.discard(before)
    return cells


def _place(points: DataFrame, cuts: dict[int, dict]) -> DataFrame:
    """Adds ``node`` (-1: a leaf) and ``shard``: one nested CASE over the tree, a branch per cut."""

    def at(node: int, shard: int, of_shard: bool) -> Column:
        c = cuts.get(node)
        if c is None:
            return F.lit(shard if of_shard else node)
        return F.when(F.col(f"k{c['dim']}") < c["cut"], at(c["l"], c["sl"], of_shard)).otherwise(at(c["r"], c["sr"], of_shard))

    return points.withColumns({"node": at(0, 0, False), "shard": at(0, 0, True)})


def _slots(rows: DataFrame, wide: DataFrame, shards: int) -> DataFrame:
    """Gapless slots: ranks inside (shard, range of the order), after the sizes of the ranges before."""
    span = rows.agg(F.min("_at").cast("decimal(38,0)").alias("lo"), F.max("_at").cast("decimal(38,0)").alias("hi")).first()
    lo, width = (int(span.lo), (int(span.hi) - int(span.lo)) // SLOT_BUCKETS + 1) if span.lo is not None else (0, 1)
    part = F.coalesce(((F.col("_at").cast("decimal(38,0)") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(-1))
    sizes = rows.withColumn("_part", part).groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("shard", "_part", (F.sum("_n").over(W.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = wide.withColumn("_part", part).withColumn("_rank", F.row_number().over(W.partitionBy("shard", "_part").orderBy("_at", "doc_id")))
    # One row per shard and range.
    return ranked.join(_few(before, shards * SLOT_BUCKETS), ["shard", "_part"]).select(*[c for c in wide.columns if c not in ("shard", "_at")], F.col("shard").cast("int").alias("shard"), (F.col("_before") + F.col("_rank") - 1).cast("int").alias("slot"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    got = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
