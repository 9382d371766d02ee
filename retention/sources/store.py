"""Versioned store of fitted state: encoder, medians, feature order, models and metrics.

Everything of a version is written below its own folder; last of all comes its manifest, one small table that names the
parts. A version without a manifest was never published: a writer that died leaves nothing that a reader would
pick up, and a published version is never changed. Readers pin one version (default: the highest) and take all parts from it.

Missing parts fall back, as scoring without them must: no medians - the batch's own median; no encoder - one fitted on the
batch; no feature order - the trained one; no store - all of these.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import encode as EN
from ..operators import features as FE
from ..operators import models as MD
from ..operators import score as SC

MANIFEST = "version bigint, parts array<string>, models array<string>"


@dataclass
class State:
    """One version as read: ``version`` None and all parts empty if nothing is published."""
    version: int | None = None
    encoder: EN.EncoderState | None = None
    medians: dict[str, float] = field(default_factory=dict)
    features: list[str] = field(default_factory=lambda: list(K.FEATURES))
    models: dict[str, object] = field(default_factory=dict)
    metrics: DataFrame | None = None


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, rising. Faults other than an absent store are raised."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/*").select("version").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r["version"] for r in rows)


def publish(spark: SparkSession, path: str, encoder: DataFrame | None = None, medians: dict[str, float] | None = None,
            features: list[str] | None = None, models: list | None = None, metrics: DataFrame | None = None) -> int:
    """Write the given parts as a new version and publish it; returns its number. What is None is not part of it."""
    version = (versions(spark, path) or [0])[-1] + 1
    base, parts = f"{path}/versions/{version}", []
    if encoder is not None:
        encoder.write.mode("overwrite").parquet(f"{base}/encoder")
        parts.append("encoder")
    for name, value in (("medians", medians), ("features", features)):
        if value is not None:
            spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/{name}")
            parts.append(name)
    for m in models or []:
        m.save(f"{base}/models")
    if metrics is not None:
        metrics.write.mode("overwrite").parquet(f"{base}/metrics")
        parts.append("metrics")
    row = spark.createDataFrame([(version, parts, [m.name for m in models or []])], MANIFEST)
    row.coalesce(1).write.parquet(f"{path}/manifest/{version}")  # fails if another writer has published it meanwhile
    return version


def read(spark: SparkSession, path: str, version: int | None = None) -> State:
    """The parts of one version, all of it; an unpublished ``version`` raises, an empty store gives the defaults."""
    known = versions(spark, path)
    if version is None and not known:
        return State()
    if version is not None and version not in known:
        raise ValueError(f"version {version} is not published; published: {known}")
    version = known[-1] if version is None else version
    base = f"{path}/versions/{version}"
    listed = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{version}").first()
    parts = set(listed["parts"])
    state = State(version)
    if "encoder" in parts:
        state.encoder = EN.EncoderState.from_table(spark.read.parquet(f"{base}/encoder"))
    if "medians" in parts:
        state.medians = json.loads(spark.read.text(f"{base}/medians").first()[0])
    if "features" in parts:
        state.features = json.loads(spark.read.text(f"{base}/features").first()[0])
    state.models = {m: MD.load(f"{base}/models", m) for m in listed["models"]}
    if "metrics" in parts:
        state.metrics = spark.read.parquet(f"{base}/metrics")
    return state


def encoded(state: State, raw: DataFrame) -> DataFrame:
    """Raw customers as encoded features by the state, by the batch itself where a part is missing."""
    median = state.medians.get("MonthlyCharges")
    encoder = state.encoder
    if encoder is None:
        cleaned = FE.clean(raw)
        mid = FE.fit_median(cleaned, "MonthlyCharges") if median is None else median
        encoder = EN.fit_encoder(FE.engineer(cleaned, mid, "score"), K.CATEGORICAL)
    return SC.features_for_scoring(raw, median, encoder)


def score(state: State, raw: DataFrame) -> DataFrame:
    """(customerID, model_used, churn_prediction, churn_probability) of every customer by every model of the state."""
    if not state.models:
        raise ValueError("the state has no model")
    rows = encoded(state, raw)
    return MD.score_all(list(state.models.values()), rows, keep=["customerID"])
