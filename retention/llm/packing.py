"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are cut to pieces of at most the largest permitted sequence length and counted by length, so the plan
depends on that histogram alone: at most ``max(capacities)`` rows whatever the corpus holds. The plan packs lengths in
descending order. All pieces of one length go to the fullest bins they fit, whole groups of equal bins
at a time; when no open bin fits, bins of the least-cost size are opened. After the last piece each
bin is downsized to the smallest permitted length that holds its contents.

The plan is a short table of rules (length, first piece, pieces per bin, first bin). Pieces are numbered within their length by
two-level counts (length and hash bucket, then a window inside a bucket) and meet their rule by a join, so a
length that a third of all pieces share is spread over all buckets.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

CAPACITIES = (1024, 2048, 4096, 8192)
OVERHEAD = 64  # cost of any sequence beside its length
BUCKETS = 1024


def byte_length(text_col: str) -> Column:
    """Tokens of a byte-level vocabulary: the UTF-8 bytes and one end mark (null text: the mark alone)."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 1


@dataclass
class Bins:
    """Equal bins with consecutive numbers."""
    first: int
    count: int
    capacity: int
    used: int


@dataclass
class Plan:
    #: length, first piece, end piece, pieces per bin, first bin, offset in it, the bins' capacity and contents
    rules: list[tuple] = field(default_factory=list)
    bins: list[Bins] = field(default_factory=list)


def open_size(length: int, capacities: tuple[int, ...], overhead: int, left: list[tuple[int, int]]) -> int:
    """The permitted size of least cost for a new bin that begins with a piece of ``length``.

    The cost is (size + overhead) per packed unit, where the room beside the piece counts as filled as far as the
    pieces still to come (``left``: descending lengths and how many) can fill it, greedily.
    """
    best = None
    for size in capacities:
        if size < length:
            continue
        room = size - length
        for other, n in left:
            if other <= room:
                room -= other * min(n, room // other)
                if not room:
                    break
        cost = (size + overhead) / (size - room)
        if best is None or cost < best[0] - 1e-12:
            best = (cost, size)
    return best[1]


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> Plan:
    """Best-fit decreasing over the counts of each length."""
    capacities = tuple(sorted(capacities))
    out, free, groups, next_bin = Plan(), [], {}, 0  # free: sorted (room, number) of open groups
    number = 0

    def put(b: Bins) -> None:
        nonlocal number
        if b.used < b.capacity:
            groups[number] = b
            insort(free, (b.capacity - b.used, number))
            number += 1
        else:
            out.bins.append(b)

    order = sorted((x for x in histogram.items() if x[1]), reverse=True)
    for k, (length, n) in enumerate(order):
        done = 0

        def fill(b: Bins) -> None:
            """As many pieces as fit into the bins of the group, which falls into filled, one partly filled and rest."""
            nonlocal done
            per = min((b.capacity - b.used) // length, n - done)
            whole = min(b.count, (n - done) // per)
            out.rules.append((length, done, done + whole * per, per, b.first, b.used))
            done += whole * per
            put(Bins(b.first, whole, b.capacity, b.used + per * length))
            first, count = b.first + whole, b.count - whole
            if count and done < n:  # fewer left than one bin takes
                out.rules.append((length, done, n, n - done, first, b.used))
                put(Bins(first, 1, b.capacity, b.used + (n - done) * length))
                first, count, done = first + 1, count - 1, n
            if count:
                put(Bins(first, count, b.capacity, b.used))

        while done < n:
            at = bisect_left(free, (length, -1))
            if at < len(free):
                fill(groups.pop(free.pop(at)[1]))
                continue
            size = open_size(length, capacities, overhead, [(length, n - done - 1), *order[k + 1:]])
            per = size // length
            new = Bins(next_bin, max(1, (n - done) // per), size, 0)
            next_bin += new.count
            fill(new)
    out.bins += groups.values()
    for b in out.bins:  # downsizing
        b.capacity = next(c for c in capacities if c >= b.used)
    out.bins.sort(key=lambda b: b.first)
    out.rules = list(_cut(out))
    return out


def _cut(made: Plan) -> Iterator[tuple]:
    """The rules, cut where one spans several groups of bins, with the capacity and contents of their group."""
    firsts = [b.first for b in made.bins]
    for length, first, end, per, first_bin, used in made.rules:
        at, bin_ = bisect_right(firsts, first_bin) - 1, first_bin
        while first < end:
            b = made.bins[at]
            to = min(end, first + (b.first + b.count - bin_) * per)
            yield length, first, to, per, bin_, used, b.capacity, b.used
            first, bin_, at = to, b.first + b.count, at + 1


def pieces(docs: DataFrame, id_col: str, length: Column, longest: int) -> DataFrame:
    """(id, piece, start, length): each document cut into pieces of at most ``longest``; zero length has none."""
    return (docs.select(F.col(id_col).alias("id"), length.cast("bigint").alias("n")).where("n > 0")
            .select("id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {longest}"))).alias("piece"))
            .select("id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"),
                    F.least(F.lit(longest).cast("bigint"), F.col("n") - F.col("piece") * longest).alias("length")))


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None,
         capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """(id, piece, start, length, bin, bin_capacity, bin_used, offset): where every piece of every document lies.

    ``length`` is any column of whole token counts (default: byte_length of ``text``). start is the piece's place in its
    document, offset its place in the bin. Null, zero and negative lengths have no piece; repeated rows are
    packed each for itself; null ids keep their pieces. Pieces of one length are interchangeable:
    their order is that of a hash of id and piece.
    """
    spark, longest = docs.sparkSession, max(capacities)
    cut = pieces(docs, id_col, byte_length("text") if length is None else length, longest)
    cut = cut.withColumn("h", F.xxhash64("id", "piece", "length"))
    cut = cut_lineage(cut.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")))
    per_bucket = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in per_bucket.groupBy("length").agg(F.sum("n")).collect()}  # <= longest rows
    made = plan(histogram, capacities, overhead)
    # lengths x buckets rows at most, in a window per length; checkpointed, else the join below would take over its
    # partitioning by length alone and put all pieces of a common length in one task
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cut_lineage(per_bucket.select("length", "bucket",
                                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("h", "id", "piece")) - 1
    numbered = cut.withColumn("nth", nth).join(before, ["length", "bucket"]).withColumn(
        "number", F.col("nth") + F.col("before"))
    rules = spark.createDataFrame(made.rules, "length bigint, first bigint, end bigint, per bigint, first_bin bigint, "
                                              "used bigint, bin_capacity int, bin_used bigint")
    # bounded by the longest capacity: a few rules for each length
    by_length = F.broadcast(rules.groupBy("length").agg(F.collect_list(F.struct(*rules.columns[1:])).alias("rules")))
    placed = numbered.join(by_length, "length").select(
        "*", F.filter("rules", lambda r: (r["first"] <= F.col("number")) & (F.col("number") < r["end"]))[0].alias("r"))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length",
                         (F.col("r.first_bin") + F.expr("(number - r.first) div r.per")).alias("bin"),
                         F.col("r.bin_capacity").alias("bin_capacity"), F.col("r.bin_used").alias("bin_used"),
                         (F.col("r.used") + F.expr("(number - r.first) % r.per") * F.col("length")).alias("offset"))
