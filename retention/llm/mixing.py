"""Mixing sources to target weights by the cube method.

Each source gets a share of a budget of words by weight, no more than ``most`` times its own words; what lies above is
shared among the others. A document is then wanted target / source words times: that many whole copies, and one more with the
probability that is left. The cube method decides the last copies. Probabilities move together along directions in the
null-space of the constraints (words and documents of the source), so both totals stay as they are; every move settles at least one
document at 0 or 1. A move turns one document, the largest first, against all the others of its block. Blocks are dealt by
hash and work side by side. Each leaves its few smallest documents open; these form the blocks of the next round, until a source
is one block. There the last ones are settled as the corner of the cube that comes nearest to the totals.

Only sums per source meet; documents are never joined with each other, and a large source is many blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, stored

#: documents in a block (about), and open ones that it hands on or settles by trying all corners
BLOCK, OPEN = 1024, 12
EDGE = 1e-9
#: sources up to this number are broadcast to the documents
BROADCAST_SOURCES = 100_000
#: buckets that sources are numbered in
BUCKETS = 4096


def words(text: str) -> Column:
    r"""Number of runs of characters other than \x20 and \x09-\x0D; null: 0."""
    return F.coalesce(F.size(F.expr(f"regexp_extract_all(`{text}`, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")).cast("bigint"), F.lit(0))


def _numbered(sources: DataFrame) -> DataFrame:
    """Add ``place``: 0 for the first source by code point, null last."""
    ranges = sources.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # ranges of sources are numbered on their own, each behind the rows of those before it
    dealt = cut_lineage(sources.repartitionByRange(max(1, min(BUCKETS, int(ranges))), F.asc_nulls_last("source")).withColumn(
        "range", F.spark_partition_id()))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("k"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    offset = sizes.select("range", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_last("source"))) - 1
    return dealt.withColumn("nth", nth).join(F.broadcast(offset), "range").select(
        *sources.columns, (F.col("nth") + F.col("before")).alias("place"))


def _level(sources: DataFrame, total: int, budget: Fraction, most: int) -> Fraction:
    """The words per unit of weight at which targets, each stopped at ``most`` times its source, add up to the budget."""
    want = budget * total
    level = Fraction(0)
    while True:
        # a source is full where most * words <= level * weight
        full = F.expr(f"cast(words as decimal(19,0)) * {most * level.denominator}BD <= "
                      f"cast(weight as decimal(9,0)) * {level.numerator}BD")
        r = sources.agg(F.sum(F.when(full, F.col("words").cast("decimal(38,0)"))).alias("held"),
                        F.sum(F.when(~full, F.col("weight").cast("decimal(38,0)"))).alias("open")).first()
        if not r["open"]:
            return level
        now = (want - most * int(r["held"] or 0)) / int(r["open"])
        if now <= level:
            return level
        level = now


def targets(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """(source, words, n, place, target): ``docs`` holds source and size; sources by code point take the weights in turn."""
    sources = docs.groupBy("source").agg(F.sum("size").cast("bigint").alias("words"), F.count("*").alias("n"),
                                         F.sum((F.col("size") > 0).cast("bigint")).alias("filled"))
    sources = _numbered(sources)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    sources = cut_lineage(sources.withColumn("weight", weight))
    total = int(sources.agg(F.sum(F.col("words").cast("decimal(38,0)"))).first()[0] or 0)
    level = _level(sources, total, budget, most)
    return sources.withColumn("target", F.least(F.lit(float(level)) * F.col("weight"), F.col("words").cast("double") * most))


def flight(size: np.ndarray, chance: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """Settle all but about ``left`` chances at 0 or 1 and keep the sums of chance and of size x chance as they are.

    ``size`` falls. Each move turns the largest open document against all other open ones: its unit vector, projected onto
    the null-space of the two constraints. Both ways lead to a face of the cube; they are taken with the odds that keep every
    chance's mean. When the other open ones cannot balance the document any more, the next one is turned.
    """
    chance = chance.copy()
    at = np.flatnonzero((chance > EDGE) & (chance < 1 - EDGE))
    turn = 0
    while len(at) > max(left, 2) and turn < len(at):
        s = size[at].astype(np.float64)
        s -= s.mean()
        spread = s @ s
        way = np.full(len(at), -1.0 / len(at))
        if spread > 0:
            way -= s * (s[turn] / spread)
        way[turn] += 1
        if way[turn] < 1e-12 or not np.isfinite(way).all():  # bound by the constraints alone
            turn += 1
            continue
        p = chance[at]
        moving = np.abs(way) > 1e-15
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(way > 0, (1 - p) / way, p / -way)[moving])
            down = np.min(np.where(way > 0, p / way, (1 - p) / -way)[moving])
        step = up if rng.random() * (up + down) < down else -down
        p = np.clip(p + step * way, 0.0, 1.0)
        p[p < EDGE], p[p > 1 - EDGE] = 0.0, 1.0
        still = (p > 0) & (p < 1)
        chance[at] = p
        if still.all():  # a step that rounding made void
            turn += 1
            continue
        turn = int(still[:turn].sum())
        at = at[still]
    return chance


def landing(size: np.ndarray, chance: np.ndarray, owed: float) -> np.ndarray:
    """The corner whose words, beside ``owed`` from rounding, come nearest to the open ones'; then its documents."""
    at = np.flatnonzero((chance > 0) & (chance < 1))
    corners = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    words_off = np.abs(corners @ size[at].astype(np.float64) - size[at] @ chance[at] - owed)
    docs_off = np.abs(corners.sum(axis=1) - chance[at].sum())
    out = chance.copy()
    out[at] = corners[np.lexsort((docs_off, words_off))[0]]
    return out


def settle(size: np.ndarray, chance: np.ndarray, last: bool, seed: int) -> np.ndarray:
    """One block: about OPEN chances stay open, or none if it is the ``last`` block of its source."""
    order = np.argsort(-size, kind="stable")
    s, p = size[order], chance[order]
    moved = flight(s, p, OPEN, np.random.default_rng(seed))
    if last:
        if _open(moved) <= OPEN:
            moved = landing(s, moved, float(s @ p - s @ moved))
        else:  # rounding has stopped the flight early: the nearer of both numbers, one document after the other
            moved = _in_turn(s, moved, float(s @ p))
    out = np.empty_like(chance)
    out[order] = moved
    return out


def _open(chance: np.ndarray) -> int:
    return int(((chance > 0) & (chance < 1)).sum())


def _in_turn(size: np.ndarray, chance: np.ndarray, want: float) -> np.ndarray:
    out, have = chance.copy(), float(size @ chance)
    for i in np.flatnonzero((chance > 0) & (chance < 1)):
        one = have + size[i] * (1 - out[i])
        none = have - size[i] * out[i]
        out[i], have = (1.0, one) if abs(one - want) < abs(none - want) else (0.0, none)
    return out


_COLUMNS = ["id", "place", "size", "base", "chance", "h", "block", "blocks"]


def _round(number: int):
    """Settle the blocks of sorted rows; a block is read whole, however the batches cut it."""
    def block(rows: pa.Table) -> pa.RecordBatch:
        last = rows.column("blocks")[0].as_py() == 1
        seed = zlib.crc32(f"{number}/{rows.column('place')[0].as_py()}/{rows.column('block')[0].as_py()}".encode())
        chance = settle(rows.column("size").to_numpy(), rows.column("chance").to_numpy(), last, seed)
        out = rows.set_column(rows.column_names.index("chance"), "chance", pa.array(chance))
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            if not b.num_rows:
                continue
            place, name = b.column("place").to_numpy(), b.column("block").to_numpy()
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(name) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                now = (place[i], name[i])
                if held and now != key:
                    yield block(pa.Table.from_batches(held))
                    held = []
                key = now
                held.append(b.slice(i, j - i))
        if held:
            yield block(pa.Table.from_batches(held))

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: Fraction = Fraction(3, 2), most: int = 2,
        id_col: str = "doc_id", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """(id, size, source_size, target, taken): how many words of each document the mix takes, copies counted.

    ``size`` defaults to the words of column ``text`` (null: 0). Null is a source of its own, after all others. ``taken`` is
    size times the copies, at most ceil(target / source_size) of them, so at most ``most``. A source's total keeps to
    its target up to what the last open documents can reach; a source of few documents is only as near as
    whole documents allow. Empty documents take part in nothing and have 0 taken; a source without words has target 0.
    Repeated rows and null ids are documents each. An empty table returns no rows. The same rows give the same mix,
    however they are stored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                      (words("text") if size is None else size).cast("bigint").alias("size"))
    src = stored(src, "sizes")
    sources = cut_lineage(targets(src, weights, budget, most))
    few = sources.count() <= BROADCAST_SOURCES
    per_source = F.broadcast(sources) if few else sources
    same = src["source"].eqNullSafe(per_source["source"])
    wanted = F.col("target") / F.col("words")
    whole = F.when(F.col("size") > 0, F.floor(wanted + EDGE)).otherwise(0)
    chance = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), wanted - F.floor(wanted + EDGE))).otherwise(F.lit(0.0))
    rows = src.join(per_source, same).select("id", "place", "size", whole.cast("int").alias("base"),
                                             F.when(chance < 2 * EDGE, 0.0).otherwise(chance).alias("chance"), "filled")
    # rows alike in all columns are told apart, so that blocks do not grow with copies of a row
    alike = F.row_number().over(Window.partitionBy("id", "place", "size").orderBy(F.lit(0)))
    rows = stored(rows.where("chance > 0").withColumn("h", F.xxhash64("id", "size", alike)).union(
        rows.where("chance = 0").withColumn("h", F.lit(0).cast("bigint"))), "wanted")
    done = [rows.where("chance = 0").select("id", "place", "size", "base", "chance")]
    todo = rows.where("chance > 0").withColumn("blocks", F.ceil(F.col("filled") / BLOCK)).drop("filled")
    number = 0
    while True:
        todo = todo.withColumn("block", F.pmod(F.xxhash64(F.lit(number), "h"), F.col("blocks"))).select(*_COLUMNS)
        dealt = todo.repartition("place", "block").sortWithinPartitions("place", "block", "size", "h", "id")
        now = stored(dealt.mapInArrow(_round(number), todo.schema), f"round-{number}")
        settled = (F.col("chance") == 0) | (F.col("chance") == 1)
        done.append(now.where(settled).select("id", "place", "size", "base", "chance"))
        todo = now.where(~settled)
        counts = todo.groupBy("place").agg(F.count("*").alias("k"))
        if not todo.take(1):
            break
        per_place = F.broadcast(counts) if few else counts
        todo = todo.drop("blocks").join(per_place, "place").withColumn("blocks", F.ceil(F.col("k") / BLOCK))
        number += 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    by_place = sources.select("place", "words", "target")
    out = out.join(F.broadcast(by_place) if few else by_place, "place")
    return out.select(F.col("id").alias(id_col), "size", F.col("words").alias("source_size"), "target",
                      ((F.col("base") + F.col("chance").cast("bigint")) * F.col("size")).cast("bigint").alias("taken"))
