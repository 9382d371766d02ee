"""Label encoding, standardisation and the feature matrix.

Encoder fit: the category columns are unpivoted once and made distinct (map-side
combine), then ``dense_rank() - 1`` over the sorted values of each column gives
the codes (alphabetical, as the reference). Missing values are the class 'nan'.

Encoder transform: a column of few classes (up to ``MAX_LITERAL``) becomes a literal ``map`` expression - the lookup
is a projection inside whole-stage codegen, no join and no shuffle. A column of more classes is left-joined with its
part of the fitted table; its classes never reach the driver or the plan. Both give the same codes.
Unseen values (and, in ``null_as='first'`` parity mode, missing ones) get code 0,
the first class (T5, T6).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import cut_lineage

MAX_LITERAL = 1_000
NAN_CLASS = "nan"


def _stack_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(NAN_CLASS)).alias("value"))
        for c in present])).alias("s")).select("s.column", "s.value"))


def encoder_table(df: DataFrame, columns: list[str] = K.CATEGORICAL) -> DataFrame:
    """(column, value, code): sorted distinct values per column -> 0..k-1."""
    distinct = _stack_categories(df, columns).distinct()
    w = Window.partitionBy("column").orderBy("value")
    return distinct.select("column", "value", (F.dense_rank().over(w) - 1).cast("int").alias("code"))


def encoder_table_by_ranges(df: DataFrame, columns: list[str] = K.CATEGORICAL) -> DataFrame:
    """The table of ``encoder_table`` for columns of any number of classes: ranges of the sorted values are numbered each on
    its own, from the number of classes in the ranges before it. No task holds a column's classes. Materialised."""
    spread = (_stack_categories(df, columns).distinct().repartitionByRange("column", "value")
              .withColumn("part", F.spark_partition_id()))
    ranged = cut_lineage(spread)
    before = Window.partitionBy("column").orderBy("part")  # a row for each range
    sizes = ranged.groupBy("column", "part").agg(F.count("*").alias("n"))
    starts = sizes.select("column", "part", (F.sum("n").over(before) - F.col("n")).alias("start"))
    own = Window.partitionBy("column", "part").orderBy("value")
    placed = ranged.withColumn("nth", F.row_number().over(own)).join(starts, ["column", "part"])
    return cut_lineage(placed.select("column", "value", (F.col("start") + F.col("nth") - 1).cast("int").alias("code")))


@dataclass
class EncoderState:
    """Fitted codes: column -> {value: code}, and (value, code) tables of the columns with many classes."""
    codes: dict[str, dict[str, int]] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def from_table(cls, table: DataFrame, max_literal: int = MAX_LITERAL) -> "EncoderState":
        sizes = {r["column"]: r["n"] for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        few = [c for c, n in sizes.items() if n <= max_literal]
        codes: dict[str, dict[str, int]] = {}
        for r in table.where(F.col("column").isin(few)).collect():  # at most max_literal rows a column
            codes.setdefault(r["column"], {})[r["value"]] = r["code"]
        return cls(codes, {c: table.where(F.col("column") == c).select("value", "code") for c in sizes if c not in codes})

    def to_table(self, spark) -> DataFrame:
        rows = [(c, v, k) for c, m in self.codes.items() for v, k in m.items()]
        out = spark.createDataFrame(rows, "column string, value string, code int")
        for c, t in self.tables.items():
            out = out.unionByName(t.withColumn("column", F.lit(c)))
        return out

    def classes(self, column: str) -> list[str]:
        m = self.codes.get(column, {})
        return sorted(m, key=m.get)


def fit_encoder(df: DataFrame, columns: list[str] = K.CATEGORICAL) -> EncoderState:
    return EncoderState.from_table(encoder_table(df, columns))


def encode(df: DataFrame, state: EncoderState, null_as: str = "nan") -> DataFrame:
    """Replace each fitted category column by its int code; unseen -> 0.

    ``null_as='nan'``: a missing value is the class 'nan' (training behaviour);
    ``null_as='first'``: a missing value is treated as unseen -> code 0 (scoring parity, T5)."""
    out = {}
    for col, mapping in state.codes.items():
        if col not in df.columns:
            continue
        m = F.create_map(*chain.from_iterable((F.lit(v), F.lit(k)) for v, k in mapping.items()))
        v = F.col(col).cast("string")
        if null_as == "nan":
            v = F.coalesce(v, F.lit(NAN_CLASS))
        out[col] = F.coalesce(F.element_at(m, v) if mapping else F.lit(None), F.lit(0)).cast("int")
    df = df.withColumns(out) if out else df
    for col, table in state.tables.items():
        if col in df.columns:
            v = F.col(col).cast("string")
            keyed = df.withColumn("_value", F.coalesce(v, F.lit(NAN_CLASS)) if null_as == "nan" else v)
            codes = table.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            df = (keyed.join(codes, "_value", "left").withColumn(col, F.coalesce("_code", F.lit(0)).cast("int"))
                  .drop("_value", "_code").select(*df.columns))
    return df


def encode_selffit(df: DataFrame, columns: list[str] = K.CATEGORICAL) -> DataFrame:
    """No saved state: fit the codes on the batch itself, then encode it."""
    return encode(df, fit_encoder(df, columns))


def unseen_categories(df: DataFrame, table: DataFrame, columns: list[str] = K.CATEGORICAL) -> DataFrame:
    """(column, value, rows): values absent from the fitted encoder.
    Anti join; AQE picks a broadcast at runtime only when the measured side is small."""
    seen = _stack_categories(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    return seen.join(table.select("column", "value"), on=["column", "value"], how="left_anti")


def missing_features(df: DataFrame, features: list[str] = K.FEATURES) -> list[str]:
    """Trained features absent from the input (U3) - a schema-level set difference."""
    return [f for f in features if f not in df.columns]


def align_features(df: DataFrame, features: list[str] = K.FEATURES, keep: list[str] | None = None) -> DataFrame:
    """Drop id/target, add absent features as 0, order as trained."""
    keep = [c for c in (keep or []) if c in df.columns]
    cols = [F.col(f) if f in df.columns else F.lit(0).alias(f) for f in features]
    return df.select(*keep, *cols)


def fit_standardizer(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Population mean and std of each column, in ONE aggregate."""
    aggs = []
    for c in columns:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def standardize_expr(c: str, mean, std):
    """(x - mean) / std_pop; a zero-variance column becomes 0."""
    x = F.col(c).cast("double")
    if isinstance(mean, (int, float)) or mean is None:
        mean, std = F.lit(mean), F.lit(std)
    return F.when(std == 0, F.lit(0.0)).otherwise((x - mean) / std)


def standardize(df: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """Standardise with statistics of ``train`` (default: ``df``), lazily via a 1-row join."""
    src = train if train is not None else df
    stats = src.agg(*chain.from_iterable(
        (F.avg(F.col(c).cast("double")).alias(f"_m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"_s_{c}"))
        for c in columns))
    j = df.crossJoin(F.broadcast(stats))  # 1-row side
    return j.withColumns({c: standardize_expr(c, F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}) \
            .drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def assemble(df: DataFrame, features: list[str] = K.FEATURES, output: str = "features") -> DataFrame:
    """Feature vector for Spark ML; invalid (NULL/NaN) values raise, as the matrix must be clean."""
    return VectorAssembler(inputCols=features, outputCol=output, handleInvalid="error").transform(
        df.withColumns({f: F.col(f).cast("double") for f in features}))
