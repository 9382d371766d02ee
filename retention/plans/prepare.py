"""Data preparation flow (the batch pipeline's first stage, SURVEY §3 E-1).

customers -> clean -> stratified split -> [lineage cut] -> fitted state (median,
encoder) -> engineered features -> encoded features.

The split customer table is checkpointed (reliable checkpoint into
``spark.checkpoint.dir``) because every later step reads it several times: the
state fits, the feature projection, and the model fits. Without the cut each read
would re-scan lineitem/orders and re-run the split's shuffles.

State is fitted on the train split by default (no leakage, T14); ``fit_on='all'``
reproduces the reference, which fits encoders and the median before splitting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import encode as EN
from ..operators import features as FE
from ..operators.split import stratified_split
from ..session import cut_lineage
from ..sources.tables import customers


@dataclass
class Prepared:
    split: DataFrame          # cleaned raw columns + label, split, fold
    features: DataFrame       # + 9 engineered columns
    encoded: DataFrame        # categories replaced by codes
    median: float
    encoder: EN.EncoderState
    fit_on: str
    mode: str

    def fit_rows(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("split") == "train") if self.fit_on == "train" else df


# by application and path: a session of another application never sees these frames; data rewritten under a
# path needs prepare(..., refresh=True)
_CACHE: dict[tuple, Prepared] = {}


def clear_cache() -> None:
    _CACHE.clear()


def split_customers(spark: SparkSession, sf_dir: str, checkpoint: bool = True) -> DataFrame:
    rows = FE.clean(customers(spark, sf_dir))
    if not checkpoint:
        return stratified_split(rows)
    # the split reads its rows three times (keys, buckets, rows): the view over the big tables runs once
    return cut_lineage(stratified_split(cut_lineage(rows)))


def prepare(spark: SparkSession, sf_dir: str, fit_on: str = "train", mode: str = "score",
            checkpoint: bool = True, refresh: bool = False) -> Prepared:
    key = (spark.sparkContext.applicationId, sf_dir, fit_on, mode, checkpoint)
    if key in _CACHE and not refresh:
        return _CACHE[key]
    sp = split_customers(spark, sf_dir, checkpoint)
    fit = sp.where(F.col("split") == "train") if fit_on == "train" else sp
    median = FE.fit_median(fit, "MonthlyCharges")
    feats = FE.engineer(sp, median, mode)
    fit_feats = feats.where(F.col("split") == "train") if fit_on == "train" else feats
    enc = EN.fit_encoder(fit_feats, K.CATEGORICAL)
    encoded = EN.encode(feats, enc)
    p = Prepared(sp, feats, encoded, median, enc, fit_on, mode)
    _CACHE[key] = p
    return p
