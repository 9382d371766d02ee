"""Deterministic stratified split, folds, sampling and class balance.

The reference uses a seeded random generator; its exact rows cannot be reproduced,
so choices are made by the md5 of ``customerID/seed`` (same hex in every engine):
within each class, rows ordered by that hash are cut at exact counts

    test = ceil(n/5), val = ceil((n - test)/4), train = rest      (60/20/20)

and train rows get ``fold = position mod k``. Copies of one customerID share one
hash, so they always land on the same side (no leakage between train and test).
Positions come from the two-level prefix sum (``rank.hash_positions``), never
from a window over the whole class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from .rank import hash_positions

SEED = 42


def split_assignment(df: DataFrame, seed: int = SEED, folds: int = 5,
                     id_col: str = K.ID_COL) -> DataFrame:
    """(label, _key) -> split, fold: one row per distinct customer key and class."""
    keyed = df.select(C.churn_label(K.TARGET).alias("label"),
                      C.seeded_hash(id_col, seed).alias("_key"))
    pos = hash_positions(keyed, ["label"], "_key")
    n, before = F.col("w_total"), F.col("w_before")
    n_test = F.expr("(w_total + 4) div 5")
    n_val = (n - n_test + 3).cast("bigint") / 4
    n_val = F.floor(n_val).cast("bigint")
    split = (F.when(before < n_test, F.lit("test"))
             .when(before < n_test + n_val, F.lit("val"))
             .otherwise(F.lit("train")))
    fold = F.when(split == "train", F.pmod(before - n_test - n_val, F.lit(folds)).cast("int"))
    return pos.select("label", "_key", split.alias("split"), fold.alias("fold"))


def stratified_split(df: DataFrame, seed: int = SEED, folds: int = 5, id_col: str = K.ID_COL) -> DataFrame:
    """Add ``label`` (0/1), ``split`` (train/val/test) and ``fold`` (train rows only)."""
    keyed = df.withColumns({"label": C.churn_label(K.TARGET), "_key": C.seeded_hash(id_col, seed)})
    assign = split_assignment(df, seed, folds, id_col)
    return keyed.join(assign, on=["label", "_key"], how="inner").drop("_key")


def seeded_sample(df: DataFrame, n: int, seed: int = SEED, id_col: str = K.ID_COL) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), chosen by hash order: a distributed top-k
    (each partition keeps n rows, the merge keeps n)."""
    return df.orderBy(C.seeded_hash(id_col, seed), F.col(id_col)).limit(n)


def split_report(split_df: DataFrame) -> DataFrame:
    """Class counts and shares per split."""
    counts = split_df.groupBy("split", K.TARGET).agg(F.count(F.lit(1)).alias("n"))
    totals = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("split_total"))
    return (counts.join(totals, "split")
            .select("split", K.TARGET, "n", "split_total",
                    F.bround(F.col("n") / F.col("split_total"), 6).alias("share")))


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_c) per class (X5); k = number of classes present."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return (counts.crossJoin(F.broadcast(tot))  # 1-row side
            .select(label, "n_c", (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight")))


def scale_pos_weight(train: DataFrame, label: str = "label", truncate: bool = True) -> DataFrame:
    """neg / pos, truncated to an integer by default."""
    agg = train.agg(F.sum((F.col(label) == 0).cast("long")).alias("neg"),
                    F.sum((F.col(label) == 1).cast("long")).alias("pos"))
    ratio = F.col("neg") / F.col("pos")
    return agg.select("neg", "pos", (F.floor(ratio) if truncate else ratio).cast("double").alias("scale_pos_weight"))


def weighted(df: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Attach a ``weight`` column from a per-class table (2 rows: broadcast)."""
    return df.join(F.broadcast(weights.select(label, "weight")), on=label, how="left")
