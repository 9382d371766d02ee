"""Customer-lifetime-value segments and reports.

Quartile edges and segment medians are exact linear-interpolated quantiles (``quantile.exact_quantiles``).
The three edges are computed once and enter as literals, so reports over segments neither shuffle rows to assign them nor
plan the edges again. A customer without a value has no segment and is in no report by segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .quantile import exact_quantiles

SEG_LOW, SEG_MEDIUM, SEG_HIGH, SEG_PREMIUM = K.CLV_SEGMENTS


def quartile_edges(df: DataFrame, col: str = "clv") -> DataFrame:
    """1 row: q1, q2, q3 (A4)."""
    q = exact_quantiles(df, F.col(col), [0.25, 0.5, 0.75])
    return q.select(F.col("q0").alias("q1"), F.col("q1").alias("q2"), F.col("q2").alias("q3"))


def segment_expr(edges: tuple, col: str = "clv"):
    """The segment's name; ``edges``: the three quartile edges (None: no customer has a value)."""
    c, out = F.col(col), F.lit(None).cast("string")
    if edges[0] is not None:
        out = F.when(c.isNotNull(), F.lit(SEG_PREMIUM))
        for edge, name in zip(reversed(edges), (SEG_HIGH, SEG_MEDIUM, SEG_LOW)):
            out = F.when(c <= F.lit(edge), F.lit(name)).otherwise(out)
    return out


def segment_pos_expr(seg: str = "clv_quartile"):
    s = F.col(seg)
    return (F.when(s == SEG_LOW, 1).when(s == SEG_MEDIUM, 2).when(s == SEG_HIGH, 3)
            .when(s == SEG_PREMIUM, 4))


def assign_quartiles(df: DataFrame, col: str = "clv") -> DataFrame:
    """Add ``clv_quartile`` and ``segment_pos``. Ties stay in one segment; an empty
    interval (equal edges) yields an empty segment instead of an error (T11, T12)."""
    e = quartile_edges(df, col).first()
    edges = (e["q1"], e["q2"], e["q3"]) if e else (None, None, None)
    return (df.withColumn("clv_quartile", segment_expr(edges, col))
            .withColumn("segment_pos", segment_pos_expr()))


def churn_by_clv(seg: DataFrame, label: str = "label", col: str = "clv") -> DataFrame:
    """Churn per CLV segment (A6, A9): rates rounded half-even to 4, pct to 2."""
    seg = seg.where(F.col("clv_quartile").isNotNull())
    stats = seg.groupBy("clv_quartile", "segment_pos").agg(
        F.avg(label).alias("_rate"), F.sum(label).cast("bigint").alias("churned_count"),
        F.count(F.lit(1)).alias("total_customers"), F.avg(col).alias("_avg"))
    med = exact_quantiles(seg, F.col(col), [0.5], ["clv_quartile"]).withColumnRenamed("q0", "_med")
    rate = F.bround(F.col("_rate"), 4)
    return (stats.join(med, "clv_quartile", "left")
            .select("clv_quartile", "segment_pos", rate.alias("churn_rate"), "churned_count",
                    "total_customers", F.bround("_avg", 4).alias("avg_clv"),
                    F.bround("_med", 4).alias("median_clv"),
                    F.bround(rate * 100, 2).alias("churn_rate_pct"),
                    (F.col("total_customers") - F.col("churned_count")).alias("retained_count")))


def clv_summary(df: DataFrame, col: str = "clv") -> DataFrame:
    """count, min, max, mean, sum of clv (A3)."""
    return df.agg(F.count(col).alias("customers"), F.min(col).alias("min_clv"), F.max(col).alias("max_clv"),
                  F.bround(F.avg(col), 4).alias("avg_clv"), F.bround(F.sum(col), 4).alias("total_clv"))


def quartile_bounds(seg: DataFrame, col: str = "clv") -> DataFrame:
    """min / max / mean clv per non-empty segment (A5)."""
    return seg.where(F.col("clv_quartile").isNotNull()).groupBy("clv_quartile", "segment_pos").agg(
        F.min(col).alias("min_clv"), F.max(col).alias("max_clv"), F.bround(F.avg(col), 4).alias("mean_clv"))


def overall_churn(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("customers"), F.sum(label).cast("bigint").alias("churned"),
                  F.avg(label).alias("churn_rate"))


def segment_clv_share(seg: DataFrame, col: str = "clv") -> DataFrame:
    """CLV sum per segment and its percent of the total."""
    per = seg.where(F.col("clv_quartile").isNotNull()).groupBy("clv_quartile", "segment_pos").agg(F.sum(col).alias("_s"))
    total = F.sum("_s").over(Window.partitionBy(F.lit(0)))  # four rows
    return per.select("clv_quartile", "segment_pos", F.bround("_s", 4).alias("segment_clv"),
                      F.bround(F.col("_s") / total * 100, 4).alias("share_pct"))


def clv_histogram(df: DataFrame, col: str = "clv", bins: int = 50) -> DataFrame:
    """Exactly ``bins`` equal-width bins between min and max, empty ones too; the max falls in the last bin (A10).
    Without any value there are no bins."""
    rng = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    binned = (df.where(F.col(col).isNotNull()).select(col).crossJoin(F.broadcast(rng))  # 1-row side
              .select(b.alias("bin"), "_lo", "_hi"))
    counts = binned.groupBy("bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("customers"))
    # at most ``bins`` rows from here on: empty bins are rows too
    found = counts.groupBy("_lo", "_hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "customers"))).alias("n"))
    rows = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return rows.select("bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"),
                       F.coalesce(F.col("n")[F.col("bin")], F.lit(0)).alias("customers"))


def revenue_at_risk(cbc: DataFrame) -> DataFrame:
    """customers x churn_pct / 100 x avg_clv per segment (B1)."""
    return cbc.select("clv_quartile", "segment_pos", "total_customers", "churn_rate_pct", "avg_clv",
                      "churned_count",
                      F.bround(F.col("total_customers") * (F.col("churn_rate_pct") / 100) * F.col("avg_clv"), 2)
                      .alias("revenue_at_risk"))


def _trunc_long(x):
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("bigint")


def premium_takeaway(cbc: DataFrame) -> DataFrame:
    """Premium revenue at risk and savings, truncated to integers."""
    p = cbc.where(F.col("clv_quartile") == SEG_PREMIUM)
    return p.select(
        F.col("total_customers").alias("premium_customers"), "churn_rate_pct", "avg_clv",
        _trunc_long(F.col("total_customers") * (F.col("churn_rate_pct") / 100) * F.col("avg_clv"))
        .alias("premium_at_risk"),
        _trunc_long(F.col("churned_count") * 0.10 * F.col("avg_clv")).alias("saving_10pct_churn_cut"),
        _trunc_long(F.col("total_customers") * 0.01 * F.col("avg_clv")).alias("saving_per_1pct"))


def clv_insights(df: DataFrame, cbc: DataFrame, col: str = "clv") -> DataFrame:
    """Insight numbers as a long table (pos, name, value)."""
    s = df.agg(F.count(F.lit(1)).cast("double").alias("total_customers"), F.bround(F.avg(col), 4).alias("avg_clv"),
               F.min(col).alias("min_clv"), F.max(col).alias("max_clv"),
               F.max("expected_tenure").cast("double").alias("expected_tenure"))
    head = s.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("pos"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value"))
        for i, n in enumerate(["total_customers", "avg_clv", "min_clv", "max_clv", "expected_tenure"])]))
        .alias("r")).select("r.*")
    per = cbc.select(F.explode(F.array(
        F.struct((F.lit(10) + F.col("segment_pos") * 2).alias("pos"),
                 F.concat(F.lower("clv_quartile"), F.lit("_churn_rate_pct")).alias("name"),
                 F.col("churn_rate_pct").cast("double").alias("value")),
        F.struct((F.lit(11) + F.col("segment_pos") * 2).alias("pos"),
                 F.concat(F.lower("clv_quartile"), F.lit("_avg_clv")).alias("name"),
                 F.col("avg_clv").cast("double").alias("value")))).alias("r")).select("r.*")
    saving = premium_takeaway(cbc).select(F.lit(30).alias("pos"), F.lit("premium_saving_10pct").alias("name"),
                                          F.col("saving_10pct_churn_cut").cast("double").alias("value"))
    return head.unionByName(per).unionByName(saving)
