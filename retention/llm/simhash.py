"""SimHash near-duplicate groups by pigeonhole blocks.

1. Fingerprint: XXH64 (seed 42) of every word shingle; a bit is set if more than half the hashes set it.
2. Candidates: the 64 bits are split into ``blocks`` blocks. Two fingerprints that differ in at most d bits
   agree on at least ``blocks - d`` whole blocks, so each fingerprint is keyed by every choice of that many
   blocks and equal keys meet. With 6 blocks and d = 4 that is 15 keys of 21 or 22 bits; 8 blocks give
   70 keys of 32 bits, for corpora of billions of different fingerprints.
3. Links: only keys with two or more fingerprints go on. A key with many is cut into chunks, and every pair of
   chunks is a unit of work of its own, so a hot key is spread over many tasks. A unit compares all
   its fingerprints by Hamming distance and emits links that keep exactly the unit's connections: true pairs
   where the unit is small, one link per fingerprint to the first of its local component where it is large.
   No link between components is lost and the output grows with fingerprints, not with pairs.
4. Components: large-star/small-star over the links.

Equal fingerprints are one node from the start, so exact copies cost nothing beyond their own row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, free_name, map_texts
from .components import connected_components

SEED = 42
CHUNK = 1024
SMALL_RUN = 32


def fingerprint(text: str | None, words: int = 4) -> int:
    """Signed 64-bit fingerprint. Null or wordless text: 0; fewer than ``words`` words: one shingle of all."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        shingles = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
        starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
        shingles = [joined[s:e] for s, e in zip(starts, ends[words - 1:].tolist())]
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(x, SEED) for x in shingles]), dtype=">u8").astype(np.uint64)
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 255 * 64):  # sums of 255 rows fit a byte
        bits = np.unpackbits(h[i:i + 255 * 64].view(np.uint8), bitorder="little").reshape(-1, 64)
        full = len(bits) // 255 * 255
        count += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        count += bits[full:].sum(axis=0, dtype=np.uint8)
    value = np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)
    return int(value.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 4, **extra: Column) -> DataFrame:
    """(id, fp bigint) for every row, and ``extra`` columns of the row by name."""
    src = docs.select(F.struct(F.col(id_col).alias("id"), *[c.alias(k) for k, c in extra.items()]).alias("_at"),
                      F.col(text_col).alias("_text"))
    found = map_texts(src, "_at", "_text", "fp bigint",
                      lambda texts: [pa.array([fingerprint(t, words) for t in texts], pa.int64())])
    return found.select(F.col("_at.id").alias(id_col), *[F.col(f"_at.{k}").alias(k) for k in extra], "fp")


def block_keys(fp: str, max_bits: int, blocks: int) -> Column:
    """Array of the bigint keys of a fingerprint: one for each choice of blocks that a close pair may share."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - max_bits))
    keys = []
    for n, choice in enumerate(choices):
        parts, width = F.lit(0).cast("bigint"), 0
        for b in choice:
            size = edges[b + 1] - edges[b]
            part = F.shiftrightunsigned(F.col(fp), edges[b]).bitwiseAND(F.lit((1 << size) - 1).cast("bigint"))
            parts, width = parts + F.shiftleft(part, width), width + size
        keys.append(parts + F.lit(n << 48 if width <= 48 else n).cast("bigint"))
    return F.array(*keys)


def _local_labels(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """For each fingerprint the index of the first one of its component among these."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= max_bits
    label = np.arange(len(fp))
    while True:
        new = np.where(near, label[None, :], len(fp)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(unit: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal unit number (rows sorted by unit)."""
    cut = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    size = np.diff(np.r_[cut, len(unit)])
    a, b = [], []
    small = np.repeat(size <= SMALL_RUN, size)
    sf, su = fp[small], unit[small]
    for d in range(1, min(SMALL_RUN, len(sf))):
        hit = np.flatnonzero((su[d:] == su[:-d]) & (np.bitwise_count(sf[d:] ^ sf[:-d]) <= max_bits))
        a.append(sf[d:][hit])
        b.append(sf[:-d][hit])
    for i in np.flatnonzero(size > SMALL_RUN):
        own = fp[cut[i]:cut[i] + size[i]]
        label = _local_labels(own, max_bits)
        hit = np.flatnonzero(label != np.arange(len(own)))
        a.append(own[hit])
        b.append(own[label[hit]])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(fps: DataFrame, max_bits: int = 4, blocks: int = 6, chunk: int = CHUNK) -> DataFrame:
    """(a, b) links between different fingerprints (column fp, distinct) that keep all connections."""
    keyed = fps.select("fp", F.explode(block_keys("fp", max_bits, blocks)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    met = (keyed.join(sizes, "key").withColumn("parts", parts)
           .withColumn("c", F.pmod(F.xxhash64("fp", "key"), F.col("parts")).cast("int"))
           .select("key", "fp", "c", F.explode(F.expr("sequence(0, parts - 1)")).alias("o"))
           .select("key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "fp"))
    met = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            cols = [np.concatenate(x) for x in zip(kept, new)]
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
                                    | (cols[2][1:] != cols[2][:-1]))
            done = change[-1] + 1 if len(change) else 0
            kept = [c[done:] for c in cols]
            yield from found([c[:done] for c in cols])
        yield from found(kept)

    def found(cols: list) -> Iterator[pa.RecordBatch]:
        if len(cols[0]):
            change = np.zeros(len(cols[0]), dtype=np.int64)
            change[1:] = ((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
                          | (cols[2][1:] != cols[2][:-1]))
            a, b = _links(np.cumsum(change), cols[3].view(np.uint64), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint")


def _groups(own: DataFrame, id_col: str, max_bits: int, blocks: int) -> DataFrame:
    """fp -> label (a fingerprint that names the group) and component (the smallest id of the group)."""
    distinct = own.groupBy("fp").agg(F.min(id_col).alias("first"))
    label = connected_components(links(distinct.select("fp"), max_bits, blocks))
    named = distinct.join(label, distinct.fp == label.node, "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label"))
    # checkpointed: the join then has an exchange on both sides, and the skew join can split a large group
    smallest = cut_lineage(named.groupBy("label").agg(F.min("first").alias("component")))
    return named.join(smallest, "label").select("fp", "label", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                    max_bits: int = 4, blocks: int = 6) -> DataFrame:
    """(id, fp bigint, component): component is the smallest id that links of at most ``max_bits`` bits reach.

    Null text counts as empty (fingerprint 0, linked like any other). Repeated rows each return a row. Null ids
    belong to their component but never name it, unless no id of it is set. An empty table returns no rows.
    """
    own = cut_lineage(fingerprints(docs, id_col, text_col, words))
    of = _groups(own, id_col, max_bits, blocks).select("fp", "component")
    return own.join(of, "fp").select(id_col, "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
               max_bits: int = 4, blocks: int = 6) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id, whole; of repeated rows, one.

    Rows are told apart by 128 bits of hashes of id and text, so the chosen rows meet the table on an even key.
    A group without any id keeps its row of the lowest hash.
    """
    # hashes pass over nulls, so what is null is part of the key
    null = F.when(F.col(id_col).isNull(), 1).otherwise(0) + F.when(F.col(text_col).isNull(), 2).otherwise(0)
    k1 = F.xxhash64(null, F.col(id_col), F.col(text_col))
    k2 = F.xxhash64(F.lit("second"), F.col(text_col), F.col(id_col), null)
    own = cut_lineage(fingerprints(docs, id_col, text_col, words, k1=k1, k2=k2))
    of = _groups(own, id_col, max_bits, blocks)
    c1, c2, nth = (free_name(n, docs.columns) for n in ("_k1", "_k2", "_nth"))
    chosen = (own.join(of, "fp").groupBy("label")
              .agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "k1", "k2"))
                   .alias("c")).select(F.col("c.k1").alias(c1), F.col("c.k2").alias(c2)))
    rows = docs.withColumns({c1: k1, c2: k2}).join(chosen, [c1, c2], "left_semi")
    # maps have no hash of their own
    plain = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
    order = Window.partitionBy(c1, c2).orderBy(F.xxhash64(*plain))
    return rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*docs.columns)
