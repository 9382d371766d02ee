"""K-d tree sharding: weighted-median splits along the widest metadata dimension.

Rows of equal texts are one group and stay together. Groups are points (their metadata) with a weight (their bytes).
All open nodes of a level are split at once: their extents come from one aggregation; then a grid of ``CELLS``
cells over each node's widest dimension is summed, and the cell in which the wanted share of the weight falls is searched
again with a finer grid, until the cell holds no more than ``TOLERANCE`` of a shard or only one value. Ties of that value
are split by the group's hash in the same way. A node of n shards gives n//2 to the lower side, which gets that share of
the weight. Only grids and extents reach the driver, never rows.

A group that alone weighs a shard's target or more gets a shard of its own, and the rest is shared among the others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

CELLS, ROUNDS, TOLERANCE = 512, 8, 0.002
BUCKETS = 1024


@dataclass
class Node:
    """shards: how many are below; split: (dimension, value, hash) or None for a leaf; low and high: children."""
    shards: int
    shard: int | None = None
    split: tuple | None = None
    low: int | None = None
    high: int | None = None


def _goes_low(split: tuple) -> Column:
    dim, value, tie = split
    return (F.col(dim) < F.lit(value)) | ((F.col(dim) == F.lit(value)) & (F.col("tie") < F.lit(tie)))


def _node_of(nodes: list[Node], at: int = 0) -> Column:
    """The number of the leaf that a group falls into: a nested condition, as deep as the tree."""
    n = nodes[at]
    if n.split is None:
        return F.lit(at)
    return F.when(_goes_low(n.split), _node_of(nodes, n.low)).otherwise(_node_of(nodes, n.high))


def build_tree(groups: DataFrame, dims: list[str], shards: int) -> list[Node]:
    """Split ``groups`` (dims as doubles, tie double, w) into ``shards`` leaves."""
    nodes = [Node(shards)]
    base = groups.agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    span = {d: (base[f"hi_{d}"] or 0) - (base[f"lo_{d}"] or 0) for d in dims}
    while opened := [i for i, n in enumerate(nodes) if n.split is None and n.shards > 1]:
        placed = groups.withColumn("node", _node_of(nodes)).where(F.col("node").isin(opened))
        ext = {r["node"]: r for r in placed.groupBy("node").agg(
            F.sum("w").alias("w"), *[f(d).alias(f"{k}_{d}") for d in [*dims, "tie"]
                                     for k, f in (("lo", F.min), ("hi", F.max))]).collect()}
        for i in opened:
            if i not in ext:  # no group: all its shards but one stay empty
                nodes[i].split = (dims[0], 0.0, 0.0)
        search = {}
        for i, e in ext.items():
            dim = max(dims, key=lambda d: (e[f"hi_{d}"] - e[f"lo_{d}"]) / (span[d] or 1))
            want = e["w"] * (nodes[i].shards // 2) / nodes[i].shards
            search[i] = {"dim": dim, "lo": e[f"lo_{dim}"], "hi": e[f"hi_{dim}"], "below": 0, "want": want,
                         "slack": TOLERANCE * e["w"] / nodes[i].shards, "value": None, "tie": (e["lo_tie"], e["hi_tie"])}
            if search[i]["lo"] == search[i]["hi"]:
                _to_ties(search[i])
        for _ in range(2 * ROUNDS):
            active = {i: s for i, s in search.items() if "split" not in s}
            if not active:
                break
            _narrow(placed, active)
        for i, s in search.items():
            nodes[i].split = s.get("split") or _border(s, s["hi"])
        for i in opened:
            n = nodes[i]
            n.low, n.high = len(nodes), len(nodes) + 1
            nodes += [Node(n.shards // 2), Node(n.shards - n.shards // 2)]
    for k, i in enumerate(i for i, n in enumerate(nodes) if n.split is None):
        nodes[i].shard = k
    return nodes


def _to_ties(s: dict) -> None:
    """Go on inside the one value that is left, along the hash."""
    s["value"], (s["lo"], s["hi"]) = s["lo"], s["tie"]


def _border(s: dict, at: float) -> tuple:
    """The split that sends all below ``at`` to the lower side."""
    return (s["dim"], s["value"], at) if s["value"] is not None else (s["dim"], at, float("-inf"))


def _narrow(placed: DataFrame, active: dict[int, dict]) -> None:
    """One finer grid for every active node; ends a node's search by setting its split."""
    inside, cell, value = F.lit(False), F.lit(0), F.lit(None).cast("double")
    for i, s in active.items():
        v = F.col("tie") if s["value"] is not None else F.col(s["dim"])
        here = (F.col("node") == i) & (v >= s["lo"]) & (v <= s["hi"])
        if s["value"] is not None:
            here &= F.col(s["dim"]) == F.lit(s["value"])
        width = max((s["hi"] - s["lo"]) / CELLS, 1e-300)
        inside |= here
        cell = F.when(F.col("node") == i, F.least(F.lit(CELLS - 1), F.floor((v - F.lit(s["lo"])) / F.lit(width)))
                      ).otherwise(cell)
        value = F.when(F.col("node") == i, v).otherwise(value)
    rows = (placed.where(inside).withColumns({"cell": cell.cast("int"), "v": value}).groupBy("node", "cell")
            .agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("node", "cell").collect())
    for i, s in active.items():
        below, grid = s["below"], [r for r in rows if r["node"] == i]
        for k, r in enumerate(grid):
            if below + r["w"] >= s["want"] or k == len(grid) - 1:
                break
            below += r["w"]
        if r["w"] <= s["slack"] or (r["lo"] == r["hi"] and s["value"] is not None):
            # the nearer end of the cell; the upper end needs the next cell's first value
            if s["want"] - below <= below + r["w"] - s["want"]:
                s["split"] = _border(s, r["lo"])
            elif k + 1 < len(grid):
                s["split"] = _border(s, grid[k + 1]["lo"])
            else:  # just above the last value
                s["split"] = _border(s, math.nextafter(r["hi"], math.inf))
        else:
            s["below"], s["lo"], s["hi"] = below, r["lo"], r["hi"]
            if r["lo"] == r["hi"]:
                _to_ties(s)


def shard(docs: DataFrame, dims: dict[str, Column], shards: int = 24, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): shards of near equal bytes; slots count from 0 without gaps.

    size is the text's UTF-8 bytes (null: none) plus 8; null and empty texts are equal. ``dims`` are numeric
    columns of ``docs``; nulls lie below all values; a group of equal texts has the least of its rows'. A group of a
    shard's target or more fills a shard alone, so shards are only as equal as whole groups allow. Repeated rows and null
    ids each get a slot. With fewer groups than shards some shards stay empty; an empty table returns no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"dim{i}" for i in range(len(dims))]
    src = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
                      F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("g"),
                      *[F.coalesce(c.cast("double"), F.lit(float("-1e300"))).alias(n) for n, c in zip(names, dims.values())])
    src = cut_lineage(src)
    groups = cut_lineage(src.groupBy("g").agg(F.sum("size").alias("w"), *[F.min(n).alias(n) for n in names]).withColumn(
        "tie", F.shiftrightunsigned("g", 11).cast("double")))
    total = groups.agg(F.sum("w")).first()[0] or 0
    alone, rest = [], total
    for g, w in groups.orderBy(F.col("w").desc(), "g").select("g", "w").limit(shards).collect():
        if len(alone) == shards - 1 or w * (shards - len(alone)) < rest or not rest:
            break
        alone.append(g)
        rest -= w
    light = groups.where(~F.col("g").isin(alone)) if alone else groups
    tree = build_tree(light, names, shards - len(alone)) if light.take(1) else [Node(1, shard=0)]
    leaf = _node_of(tree)
    of_leaf = F.create_map(*[F.lit(x) for i, n in enumerate(tree) if n.split is None for x in (i, n.shard)])
    chosen = of_leaf[leaf]
    for k, g in enumerate(alone):
        chosen = F.when(F.col("g") == F.lit(g), F.lit(shards - len(alone) + k)).otherwise(chosen)
    placed = src.select("id", "size", "crc", "g").join(groups.select("g", chosen.cast("int").alias("shard")), "g")
    placed = cut_lineage(placed.withColumn("bucket", F.pmod(F.xxhash64("id", "g"), F.lit(BUCKETS)).cast("int")))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # shards x BUCKETS rows
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "g")) - 1
    return (placed.withColumn("nth", nth).join(F.broadcast(offset), ["shard", "bucket"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("nth") + F.col("before")).cast("bigint").alias("slot")))
