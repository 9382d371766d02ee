"""Small helpers shared by the operators: table access, lineage cuts, bounded labelled samples, Arrow output."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

__all__ = ["read", "cut_lineage", "stored", "labelled_sample", "fold_remainder", "map_texts", "filter_texts", "free_name",
           "Platt", "sigmoid"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` as a Parquet table in the shared checkpoint folder and read it again; cuts the lineage.

    For tables read several times of which Parquet takes much less disk than a checkpoint's plain rows.
    """
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def fold_remainder(id_col: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k (null id: the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col, F.lit(""))) % k


def labelled_sample(docs: DataFrame, marks: DataFrame | None, id_col: str, text: str, label: str, per_label: int,
                    labels: Iterable | None = None) -> dict:
    """Training texts by label: about ``per_label`` rows of each label at most, those of the lowest hash of the id.

    ``marks`` holds (id, label); None: ``docs`` has the label itself. The rows of each label are counted, a
    threshold on the hash then lets through the wanted share, and only those few rows meet their texts (a broadcast of at
    most ``per_label`` ids for each label). A text is drawn whole and whatever its length; null texts, ids and labels are
    not drawn.
    """
    rows = (docs if marks is None else marks).select(F.col(id_col).alias("_id"), F.col(label).alias("_label"))
    rows = rows.where("_id is not null and _label is not null").withColumn(
        "_h", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / (1 << 30))
    count = {r[0]: r[1] for r in rows.groupBy("_label").agg(F.count("*")).collect()}
    out: dict = {x: [] for x in (sorted(count) if labels is None else labels)}
    share = F.lit(0.0)
    for x in out:
        share = F.when(F.col("_label") == F.lit(x), F.lit(1.1 * per_label / max(1, count.get(x, 0)))).otherwise(share)
    chosen = rows.where(F.col("_h") < share).select("_id", "_label", "_h").distinct()
    texts = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    # one text of each drawn id, however often the id is repeated
    drawn = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label", "_h").agg(F.min("_text").alias("_text"))
    for x, t in sorted((r["_label"], (r["_h"], r["_text"])) for r in drawn.collect()):
        if x in out and len(out[x]) < per_label:
            out[x].append(t[1])
    return out


def map_texts(rows: DataFrame, id_col: str, text_col: str, schema: str,
              kernel: Callable[[list], list], id_type: str | None = None) -> DataFrame:
    """One output row per input row: the id and the columns that ``kernel`` returns for the list of texts.

    Only the id and the text are read, so other columns of the input may have any name.
    ``schema`` names the kernel's columns, in order.
    """
    src = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out_type = id_type or dict(rows.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                cols = kernel(part.column(1).to_pylist())
                yield record([part.column(0), *cols])

    def record(cols: list) -> pa.RecordBatch:
        arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in cols]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["_id", *[x.split()[0] for x in schema.split(",")]]
    return src.mapInArrow(run, f"_id {out_type}, {schema}").withColumnRenamed("_id", id_col)


def pieces(b: pa.RecordBatch, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of about ``most_bytes`` so that Python objects of few texts exist at a time."""
    if not b.num_rows:
        return
    step = max(1, int(b.num_rows * most_bytes / max(b.nbytes, most_bytes)))
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)


def filter_texts(rows: DataFrame, text_col: str, keep: Callable[[list], np.ndarray]) -> DataFrame:
    """The rows, whole and unchanged, whose text ``keep`` accepts; no shuffle and no join."""
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                yield part.filter(pa.array(np.asarray(keep(part.column(at).to_pylist()), dtype=bool)))

    return rows.mapInArrow(run, rows.schema)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Platt:
    """Logistic calibration of a few standardised features, fitted with Newton steps and a small ridge."""

    def __init__(self, ridge: float = 1e-3):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 30) -> Platt:
        x = np.asarray(x, dtype=np.float64)
        x = x.reshape(len(y), x.shape[1] if x.ndim > 1 else 1)
        self.mean, self.std = (x.mean(0), x.std(0) + 1e-9) if len(y) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = np.c_[(x - self.mean) / self.std, np.ones(len(y))]
        w = self.w = np.zeros(z.shape[1])
        if len(set(np.asarray(y).tolist())) < 2:  # one label, or none, has no curve
            w[-1] = np.log((1 + np.sum(y)) / (1 + len(y) - np.sum(y)))
            return self
        ridge = np.diag([self.ridge * max(1, len(y))] * x.shape[1] + [1e-9])
        for _ in range(steps):
            p = sigmoid(z @ w)
            h = (z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w))
            w -= np.linalg.solve(h, z.T @ (p - y) + ridge @ w)
        self.w = w
        return self

    def towards(self, share: float | None, of_sample: float) -> Platt:
        """Move the intercept from the sample's share of label 1 to the share among all labelled rows."""
        if share and 0 < share < 1 and 0 < of_sample < 1:
            self.w[-1] += np.log(share / (1 - share)) - np.log(of_sample / (1 - of_sample))
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64).reshape(-1, len(self.mean))
        return sigmoid(np.c_[(x - self.mean) / self.std, np.ones(len(x))] @ self.w)
