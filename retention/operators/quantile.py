"""Exact interpolated quantiles of large columns without a one-task merge over the values.

1. A sketch per group brackets every wanted quantile; its rank error is below 1/ACCURACY of the rows, and the
   bracket is taken two errors wide on each side. Groups of up to SMALL rows are their own bracket.
2. One aggregation counts the rows below each bracket.
3. Only the rows inside (a few ten-thousandths of a large group) are collapsed to distinct values and summed in
   order, by a window per group and quantile, which sorts and can spill.

The two order statistics around position p * (n - 1) are then interpolated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
SMALL = 20_000


def exact_quantiles(df: DataFrame, value: Column, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., q0, q1, ...) for every group with a non-null value; without ``by`` one row, nulls if there is none.

    ``by`` must have few groups (columns, segments): their brackets are broadcast.
    """
    by = by or []
    rows = df.select(*by, value.cast("double").alias("_v")).where("_v is not null")
    edge = 2.0 / ACCURACY
    at = [x for p in probs for x in (max(0.0, p - edge), min(1.0, p + edge))]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                   F.percentile_approx("_v", F.array(*map(F.lit, at)), ACCURACY).alias("_s"))
    small = F.col("_n") <= SMALL
    brackets = sketch.select(*by, "_n", F.posexplode(F.array(*[
        F.struct(F.lit(p).alias("p"), F.when(small, F.col("_min")).otherwise(F.col("_s")[2 * i]).alias("lo"),
                 F.when(small, F.col("_max")).otherwise(F.col("_s")[2 * i + 1]).alias("hi"))
        for i, p in enumerate(probs)])).alias("_i", "_b"))
    brackets = F.broadcast(brackets)  # groups x quantiles rows
    met = rows.join(brackets, by) if by else rows.crossJoin(brackets)
    inside = met.where("_v <= _b.hi").select(*by, "_i", "_n", "_b.p", F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v"))
    # one row per distinct value inside, and one (null) for all that lie below
    counts = inside.groupBy(*by, "_i", "_n", "p", "_v").agg(F.count("*").alias("_w"))
    order = Window.partitionBy(*by, "_i").orderBy(F.col("_v").asc_nulls_first())
    placed = counts.withColumn("_end", F.sum("_w").over(order))  # the rows up to and with this value
    pos = F.col("p") * (F.col("_n") - 1)
    low, high = F.floor(pos), F.ceil(pos)

    def stat(k: Column) -> Column:
        return F.max(F.when((F.col("_end") - F.col("_w") <= k) & (k < F.col("_end")), F.col("_v")))

    found = placed.groupBy(*by, "_i").agg(stat(low).alias("_lo"), stat(high).alias("_hi"), F.max(pos - low).alias("_f"))
    # a sketch that misses its bracket must not pass as a missing value
    missed = F.col("_lo").isNull() | F.col("_hi").isNull()
    q = F.when(missed, F.raise_error(F.lit("quantile outside its bracket: raise quantile.ACCURACY")).cast("double")).when(F.col("_f") == 0, F.col("_lo")).otherwise((1 - F.col("_f")) * F.col("_lo") + F.col("_f") * F.col("_hi"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, q)).alias(f"q{i}") for i in range(len(probs))])
