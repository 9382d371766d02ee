"""File sources and sinks.

* customer table: CSV with header or parquet, read with a fixed schema (no inference);
* splits: ONE parquet dataset partitioned by ``split`` (features and label stay
  together); reading one split is partition pruning, not a file choice;
* fitted state: small parquet tables ``encoder(column, value, code)``,
  ``medians(column, value)``, ``features(pos, name)``;
* predictions: ``.parquet`` -> parquet, anything else -> CSV with header;
* importance tables: CSV partitioned by ``model``.

Writers never coalesce to one file: output parallelism follows the data.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K

_INT_COLS = {"SeniorCitizen", "tenure"}
_DOUBLE_COLS = {"MonthlyCharges"}

RAW_SCHEMA = T.StructType([
    T.StructField(c, T.IntegerType() if c in _INT_COLS else T.DoubleType() if c in _DOUBLE_COLS else T.StringType(),
                  True)
    for c in K.RAW_COLUMNS])


def read_customers(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Raw 21-column customer table (S1). TotalCharges stays text; cleaning is a separate step."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "csv":
        return spark.read.schema(RAW_SCHEMA).option("header", True).csv(path)
    return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in RAW_SCHEMA.fields])


def write_customers_csv(df: DataFrame, path: str) -> None:
    df.select(*K.RAW_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    """All splits in one dataset, partitioned by ``split`` (S3)."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split via partition pruning."""
    return spark.read.parquet(path).where(F.col("split") == split)


def write_state(spark: SparkSession, path: str, encoder_table: DataFrame, medians: dict[str, float],
                features: list[str] = K.FEATURES) -> None:
    """Fitted state as three small tables."""
    encoder_table.write.mode("overwrite").parquet(f"{path}/encoder")
    spark.createDataFrame([(k, float(v)) for k, v in medians.items()], "column string, value double") \
        .write.mode("overwrite").parquet(f"{path}/medians")
    spark.createDataFrame(list(enumerate(features)), "pos int, name string") \
        .write.mode("overwrite").parquet(f"{path}/features")


def read_state(spark: SparkSession, path: str):
    """(encoder table or None, medians dict, feature list); missing parts fall back to
    defaults: no encoder, no medians (the caller then uses the batch median), trained order (S5)."""
    def _try(p):
        try:
            return spark.read.parquet(p)
        except AnalysisException as e:  # absent state is a supported case; other faults are not
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
    enc = _try(f"{path}/encoder")
    med_df = _try(f"{path}/medians")
    feat_df = _try(f"{path}/features")
    medians = {r["column"]: r["value"] for r in med_df.collect()} if med_df is not None else {}  # <= 28 rows
    feats = [r["name"] for r in feat_df.orderBy("pos").collect()] if feat_df is not None else list(K.FEATURES)
    return enc, medians, feats


def save_predictions(df: DataFrame, path: str) -> str:
    """``.parquet`` suffix -> parquet; any other suffix -> CSV with header (S8). Returns the format."""
    if path.rstrip("/").endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
        return "parquet"
    df.write.mode("overwrite").option("header", True).csv(path)
    return "csv"


def save_importance(df: DataFrame, path: str) -> None:
    """One CSV folder per model."""
    df.write.mode("overwrite").partitionBy("model").option("header", True).csv(path)


def save_metrics(metrics: DataFrame, path: str) -> None:
    """The long metrics table (validation and test rows alike), one folder per split."""
    metrics.write.mode("overwrite").partitionBy("split").parquet(path)


def save_best_params(best: DataFrame, path: str) -> None:
    """(model, param_id, params as JSON, mean_test_auc), the chosen map of each model."""
    best.write.mode("overwrite").json(path)
