"""Coefficient explanations and importance reports.

Per-customer work is done on arrays inside the row: the contribution array of a
row is sorted and sliced in place (``sort_array`` / ``slice`` / ``aggregate``), so
top-k factors and waterfall running sums need no window, no shuffle and cannot be
skewed by a hot customer key. Cross-row work (std devs, mean |contribution|,
model comparison) is one grouped aggregate each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .score import LinearScorer

DIGITS = 9


def _r(c, digits: int = DIGITS):
    """Half-even rounding; adding 0.0 turns a negative zero into 0.0."""
    return F.bround(c, digits) + F.lit(0.0)


def linear_importance(train: DataFrame, *scorers: LinearScorer) -> DataFrame:
    """importance = |coef x population std of the transformed feature| (I1, A16), for all scorers in one pass."""
    stds = train.agg(*[F.stddev_pop(s.scaled(f)).alias(f"{i}_{f}") for i, s in enumerate(scorers) for f in K.FEATURES])
    rows = stds.select(F.explode(F.array(*[
        F.struct(F.lit(s.name).alias("model"), F.lit(f).alias("feature"),
                 F.lit(float(s.coef.get(f, 0.0))).alias("coefficient"), F.col(f"{i}_{f}").alias("std_dev"))
        for i, s in enumerate(scorers) for f in K.FEATURES])).alias("r")).select("r.*")
    return rows.select("model", "feature",
                       F.bround(F.abs(F.col("coefficient") * F.col("std_dev")), DIGITS).alias("importance"),
                       "coefficient", F.bround("std_dev", DIGITS).alias("std_dev"))


def contributions(df: DataFrame, scorer: LinearScorer, id_col: str = K.ID_COL) -> DataFrame:
    """Long table (customerID, model, feature, value, coefficient, contribution); value is the raw value."""
    return df.select(id_col, F.explode(scorer.contributions()).alias("c")).select(
        id_col, F.lit(scorer.name).alias("model"), "c.feature",
        _r("c.value").alias("value"), "c.coefficient", _r("c.contribution").alias("contribution"))


def _sorted_top(scorer: LinearScorer, k: int | None = None):
    """Row-local: contributions sorted by |contribution| desc, then feature; first k (None: all)."""
    keyed = F.transform(scorer.contributions(), lambda x: F.struct(
        (-F.abs(x["contribution"])).alias("neg_abs"), x["feature"].alias("feature"),
        x["value"].alias("value"), x["coefficient"].alias("coefficient"), x["contribution"].alias("contribution")))
    return F.slice(F.sort_array(keyed), 1, k) if k else F.sort_array(keyed)


def top_factors(df: DataFrame, scorer: LinearScorer, k: int = 15, id_col: str = K.ID_COL) -> DataFrame:
    """Top-k features per customer by |contribution|."""
    return df.select(id_col, F.posexplode(_sorted_top(scorer, k)).alias("pos", "c")).select(
        id_col, F.lit(scorer.name).alias("model"), (F.col("pos") + 1).alias("rank"), "c.feature",
        _r("c.value").alias("value"), "c.coefficient", _r("c.contribution").alias("contribution"))


def waterfall(df: DataFrame, scorer: LinearScorer, k: int = 15, id_col: str = K.ID_COL) -> DataFrame:
    """Base value, the k-1 largest contributions and the sum of all others, with running totals; the last
    running total is the scorer's margin (I7)."""
    base = scorer.intercept if isinstance(scorer.intercept, Column) else F.lit(float(scorer.intercept))
    first = F.struct(F.lit(0).alias("rank"), F.lit("base_value").alias("feature"),
                     base.alias("contribution"), base.alias("running"))

    def step(acc, name, value):
        return F.array_append(acc, F.struct((F.element_at(acc, -1)["rank"] + 1).alias("rank"), name.alias("feature"),
                                            value.alias("contribution"),
                                            (F.element_at(acc, -1)["running"] + value).alias("running")))

    ranked = df.select("*", _sorted_top(scorer).alias("_all"))
    # one pass over the sorted array: each step appends (rank, feature, c, running + c)
    top = F.aggregate(F.slice("_all", 1, k - 1), F.array(first), lambda acc, x: step(acc, x["feature"], x["contribution"]))
    rest = F.aggregate(F.slice("_all", k, len(K.FEATURES)), F.lit(0.0), lambda acc, x: acc + x["contribution"])
    return ranked.select(id_col, F.explode(step(top, F.lit("other_features"), rest)).alias("s")).select(
        id_col, F.lit(scorer.name).alias("model"), "s.rank", "s.feature",
        _r("s.contribution").alias("contribution"), _r("s.running").alias("running"))


def mean_abs_contribution(contrib: DataFrame) -> DataFrame:
    """Global importance as mean |contribution| per (model, feature)."""
    return contrib.groupBy("model", "feature").agg(
        F.bround(F.avg(F.abs("contribution")), DIGITS - 2).alias("importance"))


def top_importance(importance: DataFrame, n: int = 15) -> DataFrame:
    """Top-n features per model (K1). The importance table is models x features rows."""
    w = Window.partitionBy("model").orderBy(F.col("importance").desc(), F.col("feature"))
    return (importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("model", "rank", "feature", "importance"))


def compare_importance(importance: DataFrame, models: list[str], top_n: int = 15) -> DataFrame:
    """Union of each model's top-n features, one column per model (absent -> 0), ordered by
    the average, first top_n (I8, U2, J4, K4)."""
    feats = top_importance(importance, top_n).select("feature").distinct()
    piv = (importance.join(feats, "feature", "left_semi")
           .groupBy("feature").pivot("model", models).agg(F.first("importance")).fillna(0.0, subset=models))
    avg = sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models)
    out = piv.withColumn("avg_importance", F.bround(avg, DIGITS))
    return out.orderBy(F.col("avg_importance").desc(), "feature").limit(top_n)
