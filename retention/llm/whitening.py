"""Embedding whitening: components by contour integration (feast.py), rows projected and scaled to unit variance.

Vectors become whole numbers first, so counts, sums and deviations are exact. The fit list holds each distinct vector once;
it is written to the shared checkpoint folder because three passes read it: the sums, the covariance, centred at the exact
means before anything is multiplied, and the check of the whitened values. Every task reduces its rows to
one matrix, and the matrices are summed by row in groups; what reaches the driver depends on the number of dimensions and not on
the number of vectors. Rows are projected where they are read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .feast import largest_pairs

#: partial matrices at most; more tasks than this would only make more to add up
PARTS = 4096
#: entries beyond this have no long code
LARGEST = 2.0 ** 62


@dataclass
class Whitening:
    """n vectors were fitted; sums: per dimension; values, vectors: eigenvalues, falling, and their vectors as columns."""
    scale: int
    offset: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _deviations(x, self.n, self.sums).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - S)^2 of each row; None if it has no long."""
        y = _deviations(x, self.n, self.sums)
        if y.dtype != object and np.abs(y).max(initial=0) < 3.0e9 / np.sqrt(max(1, self.dims)):
            return (y * y).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in y]
        return [v if v < 1 << 63 else None for v in exact]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: longs where they fit, Python numbers elsewhere."""
    if np.abs(x.astype(np.float64)).max(initial=0) * n < 4e18 and max(map(abs, sums), default=0) < 4e18:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def codes(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * c) + offset of each entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint") + F.lit(offset))


def usable(vector: Column, scale: int) -> Column:
    """Vectors without null, NaN or infinite entries, and without entries too large for a long code."""
    ok = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double") * F.lit(float(scale))) < F.lit(LARGEST)))
    return F.coalesce(ok, F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _per_task(rows: DataFrame, dims: int, init: Callable[[], object], step: Callable, finish: Callable, schema: str) -> DataFrame:
    """One record batch per task: ``step`` folds each matrix of codes into the state that ``finish`` turns into columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = init()
        for b in batches:
            if b.num_rows:
                state = step(state, _matrix(b.column(0), dims))
        yield finish(state)

    # fewer tasks only where there are more than PARTS of them
    return rows.coalesce(PARTS).mapInArrow(run, schema)


def _sums(fit_list: DataFrame, dims: int) -> tuple[int, list[int]]:
    def step(state, x):
        exact = x if np.abs(x.astype(np.float64)).max(initial=0) * len(x) < 4e18 else x.astype(object)
        return state[0] + len(x), [a + int(b) for a, b in zip(state[1], exact.sum(axis=0))]

    def finish(state):
        return pa.RecordBatch.from_pydict({"i": pa.array(range(-1, dims), pa.int32()), "s": [str(v) for v in (state[0], *state[1])]})

    rows = _per_task(fit_list, dims, lambda: (0, [0] * dims), step, finish, "i int, s string")
    total = {r["i"]: int(r["s"]) for r in rows.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return total.get(-1, 0), [total.get(i, 0) for i in range(dims)]


def _add_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")  # one order of the sum, whatever the order of arrival
    return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0).tolist()]})


def _products(fit_list: DataFrame, dims: int, width: int, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of y'y over the fit list, y = values(x): a width x width matrix."""
    def finish(state):
        return pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "v": state.tolist()})

    def step(state, x):
        y = values(x)
        return state + y.T @ y

    rows = _per_task(fit_list, dims, lambda: np.zeros((width, width)), step, finish, "i int, v array<double>")
    total = (rows.withColumn("part", F.spark_partition_id()).groupBy("i").applyInPandas(_add_rows, "i int, v array<double>"))
    out = np.zeros((width, width))
    for r in total.collect():
        out[r["i"]] = r["v"]
    return out


def fit(rows: DataFrame, vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000,
        components: int = 16, dims: int | None = None) -> Whitening:
    """Components of the distinct codes of all usable vectors.

    Null and empty vectors, and those with a null, NaN or infinite entry, or one too large for a long code, do not
    count. ``dims`` is the length that vectors must have; None: the commonest length, the longer of equally common ones.
    Repeated vectors count once. No usable vector, or only one distinct, gives a fit without components; so does every
    direction whose variance is zero up to rounding (1e-13 of the trace).
    """
    good = rows.select(F.col(vector_col).alias("v")).where(usable(F.col("v"), scale) & (F.size("v") > 0))
    if dims is None:
        first = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        if first is None:
            return Whitening(scale, offset, 0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
        dims = first["d"]
    fit_list = stored(good.where(F.size("v") == dims).select(codes(F.col("v"), scale, offset).alias("x")).distinct(), "fit-list")
    n, sums = _sums(fit_list, dims)
    if not n:
        return Whitening(scale, offset, 0, sums, np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0)
    covariance = _products(fit_list, dims, dims, lambda x: _deviations(x, n, sums).astype(np.float64) / n) / n
    values, vectors = largest_pairs(covariance, components)
    model = Whitening(scale, offset, n, sums, values, vectors, float(np.trace(covariance)), 0.0)
    if len(values):
        k = len(values)
        middle = _products(fit_list, dims, k + 1, lambda x: np.c_[model.whitened(x), np.ones(len(x))])[k, :k] / n
        spread = _products(fit_list, dims, k, lambda x: model.whitened(x) - middle) / n
        model.identity_error = float(np.abs(spread - np.eye(k)).max())
    return model


def transform(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component.

    Vectors that ``fit`` would not use, and those of another length than the fitted one, have no rows. Repeated rows and
    null ids each have theirs. ``deviation`` is null where it has no long. Only the id and the vector are read.
    """
    id_type = dict(rows.select(id_col).dtypes)[id_col]
    k = len(model.values)
    names = ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not k:
                continue
            x = _matrix(b.column(1), model.dims)
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(at)),
                pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.values / model.trace, len(x))),
                pa.array(np.full(len(at), model.identity_error))], names=names)

    src = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    src = src.where(usable(F.col("_v"), model.scale) & (F.size("_v") == max(1, model.dims)))
    src = src.select("_id", codes(F.col("_v"), model.scale, model.offset).alias("_x"))
    return src.mapInArrow(run, f"_id {id_type}, component int, n bigint, deviation bigint, whitened double, "
                               "explained double, identity_error double").withColumnRenamed("_id", id_col)
