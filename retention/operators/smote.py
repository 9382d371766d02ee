"""SMOTE oversampling of the minority class on the training rows.

Exact k-nearest minority neighbours without comparing all pairs:

1. Points of equal features are one vector, which names its first k + 1 row keys: no other copy can be among the k nearest
   of any point. A hot vector is therefore searched once and answered k + 1 times, whatever its copies.
2. Space is cut into cells (one for about ``CELL`` vectors, at most ``MAX_CELLS``, which bounds what the tasks are sent): the
   vectors of the lowest hashes, ``SEEN`` for each cell, are halved again and again along the feature in which they differ most.
   Each vector walks down these cuts to its cell; a cell knows the box around its vectors.
3. Neighbours within the own cell give each vector an upper bound on its k-th distance.
4. Another cell is searched only if its box comes as near as that bound, widened by more than the rounding of the distances.
   Vectors that differ in flags lie in cells of their own, so a vector meets few cells however many there are.
5. Compared are chunks of about ``BLOCK`` rows of each side, in numpy: a matrix product gives rough distances, and those that
   the rounding lets be among the nearest are summed feature by feature, so they are the same everywhere. No pair of points
   is ever a row, a large cell is many units.

How much is skipped depends on how far the points cluster; nothing is compared that an all-pairs search would not compare.
``max_fit_rows`` bounds the points of a fit: beyond it the points of the lowest hash stand for the class, both as seeds and
as neighbours (None: all points, the default).

Points are told apart by a row key, not by the id: copies of an id are points of their own. Points with a missing feature
are nobody's neighbours and have none.

Synthesis is deterministic: the n_new synthetic rows are dealt round-robin over the minority points in hash order (exact
counts, no driver loop); the neighbour and the gap u in [0, 1) come from the md5 of (row key, t).
New point = x + u * (neighbour - x).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..session import cut_lineage
from .rank import hash_positions

DIGITS = 9
SEED = 42
BLOCK = 2048
CELL = 1024
MAX_CELLS = 4096
SEEN = 16
STRIP = 256
SLACK = 1e-7
KEY = "_row_key"


def _vector(features: list[str]):
    return F.array(*[F.bround(F.col(f).cast("double"), DIGITS) for f in features])


def with_row_key(df: DataFrame, id_col: str = K.ID_COL, features: list[str] = K.FEATURES) -> DataFrame:
    """Add the row key: the id, with ~2, ~3, ... for further rows of that id."""
    if KEY in df.columns:
        return df
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(*features))
    key = F.concat_ws("~", F.col(id_col).cast("string"), F.when(nth > 1, nth.cast("string")))
    return df.withColumn(KEY, key)


def _strips(n: int) -> Iterator[slice]:
    return (slice(i, i + STRIP) for i in range(0, n, STRIP))


@dataclass
class Cells:
    """Cuts of space: a row with x[feature] <= cut goes to the first child, else to the second; feature -1: the cell."""
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray       # first child; the second is the next one
    cell: np.ndarray        # number of a cell, -1 for a cut

    def __len__(self) -> int:
        return int((self.feature < 0).sum())

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int) -> Cells:
        """At most ``cells`` cells: the fullest one is cut in two, next to the median of its widest feature."""
        feature, cut, child = [-1], [0.0], [-1]
        heap = [(-len(sample), 0, sample)]  # the node's number comes before its rows: no two are equal
        while heap and len(feature) < 2 * cells - 1:
            _, node, rows = heapq.heappop(heap)
            f = int(rows.var(axis=0).argmax())
            value, count = np.unique(rows[:, f], return_counts=True)
            if len(value) < 2:
                continue
            at = value[np.abs(count.cumsum()[:-1] - len(rows) / 2).argmin()]
            feature[node], cut[node], child[node] = f, float(at), len(feature)
            low = rows[:, f] <= at
            for part in (rows[low], rows[~low]):
                heapq.heappush(heap, (-len(part), len(feature), part))
                feature.append(-1)
                cut.append(0.0)
                child.append(-1)
        ends = np.array(feature) < 0
        return cls(np.array(feature), np.array(cut), np.array(child), np.where(ends, ends.cumsum() - 1, -1))

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            f = self.feature[at]
            if (f < 0).all():
                return self.cell[at].astype(np.int32)
            at = np.where(f < 0, at, self.child[at] + (x[rows, np.maximum(f, 0)] > self.cut[at]))


def _assign(cells: Cells):
    """Adds the cell."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=cells.of(np.stack(batch["v"])))

    return run


def _to_boxes(low: np.ndarray, high: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """How far each row of [low, high] is at least from each of the boxes (2 x boxes x features)."""
    d = np.zeros((len(low), boxes.shape[1]))
    for f in range(low.shape[1]):
        gap = np.maximum(boxes[0, None, :, f] - high[:, f, None], low[:, f, None] - boxes[1, None, :, f])
        np.maximum(gap, 0.0, out=gap)
        d += gap * gap
    return np.sqrt(d)


def _survivors(boxes: np.ndarray):
    """One row for each other cell that may hold a vector within ``u`` of the row's. boxes: least and greatest values of the cells."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.iloc[np.argsort(batch["cell"].to_numpy(), kind="stable")]  # rows of a cell see the same cells
            for at in _strips(len(batch)):
                part = batch.iloc[at]
                x, u, own = np.stack(part["v"]), part["u"].to_numpy(), part["cell"].to_numpy()
                apart = _to_boxes(x.min(axis=0)[None], x.max(axis=0)[None], boxes)[0]
                some = np.flatnonzero(np.isfinite(apart) & (apart <= u.max() + SLACK * (1 + apart)))
                d = _to_boxes(x, x, boxes[:, some])
                row, cell = np.nonzero((d <= u[:, None] + SLACK * (1 + d)) & (some[None, :] != own[:, None]))
                yield part.iloc[row][["vid", "v", "u"]].assign(cell=some[cell].astype(np.int32))

    return run


def _nearest(most: int):
    """Kernel of one unit: of each left vector the nearest right rows, ``most`` of them and none beyond its bound."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"vid": [], "nkey": [], "distance": []})
        x, y, u = np.stack(left["v"]), np.stack(right["w"]), left["u"].to_numpy()
        ids, others = left["vid"].to_numpy(), right["key"].to_numpy()
        by_name = np.argsort(others, kind="stable")  # equal distances fall in the order of the keys
        y, others = y[by_name], others[by_name]
        square = (y * y).sum(axis=1)
        wide = np.c_[y, np.ones(len(y)), -square / 2].T
        out = []
        for at in _strips(len(x)):
            part = x[at]
            own = (part * part).sum(axis=1)[:, None]
            slack = SLACK * (own + square.max())  # far more than the rounding of the product
            bound, ranked = u[at, None] ** 2 + slack, len(y) > most
            if np.isfinite(bound).all():  # what lies within the bound, by the sign of one product
                near = np.c_[part, (bound - own) / 2, np.ones(len(part))] @ wide >= 0
                ranked &= np.count_nonzero(near) > 4 * most * len(part)  # few are left: no need to rank all
            else:
                near = np.ones((len(part), len(y)), dtype=bool)
            if ranked or not np.isfinite(bound).all():
                rough = own + square - 2.0 * (part @ y.T)
                least = np.partition(rough, most - 1, axis=1)[:, most - 1:most] if ranked else np.inf
                near &= rough <= np.minimum(least, u[at, None] ** 2) + slack
            row, col = np.nonzero(near)
            d = np.zeros(len(row))
            for f in range(x.shape[1]):
                gap = part[row, f] - y[col, f]
                d += gap * gap
            d = np.sqrt(d)
            order = np.lexsort((col, d, row))
            row, col, d = row[order], col[order], d[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            keep = (nth < most) & (d <= u[at][row])
            out.append(pd.DataFrame({"vid": ids[at][row[keep]], "nkey": others[col[keep]], "distance": d[keep]}))
        return pd.concat(out)

    return run


def _compare(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(vid, nkey, distance): the nearest rows of ``right`` in the cell of each row of ``left``, chunk against chunk."""
    def chunks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    spark = left.sparkSession
    met = chunks(left, "nl").join(chunks(right, "nr"), "cell").select("cell", "nl", "nr").collect()  # at most MAX_CELLS rows
    plan = F.broadcast(spark.createDataFrame(met, "cell int, nl int, nr int"))
    lefts = left.join(plan, "cell").select("vid", "v", "u", "cell", F.pmod(F.xxhash64("vid"), "nl").cast("int").alias("i"),
                                           F.explode(F.expr("sequence(0, nr - 1)")).alias("j"))
    rights = right.join(plan, "cell").select("key", F.col("v").alias("w"), F.col("cell").alias("c"),
                                             F.explode(F.expr("sequence(0, nl - 1)")).alias("i"),
                                             F.pmod(F.xxhash64("key"), "nr").cast("int").alias("j"))
    # a given number of partitions: units are small in bytes and long in time, and must not be coalesced into few tasks
    units = sum(r["nl"] * r["nr"] for r in met)
    parts = max(1, min(units, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    lefts, rights = lefts.repartition(parts, "cell", "i", "j"), rights.repartition(parts, "c", "i", "j")
    return (lefts.groupBy("cell", "i", "j").cogroup(rights.groupBy("c", "i", "j"))
            .applyInPandas(_nearest(most), "vid string, nkey string, distance double"))


def _first(near: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest rows of every vector."""
    order = Window.partitionBy("vid").orderBy("distance", "nkey")  # ``most`` rows a unit in which the vector was compared
    return near.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most).drop("_nth")


def _searched(pts: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows of ``pts`` that can be answers, with vector and cell; (vid, v, u, cell) searched in the own cell; the same for
    other cells, None if there is one cell)."""
    by_key = Window.partitionBy("v").orderBy("key")
    rows = pts.select("v", "key", F.row_number().over(by_key).alias("nth")).where(F.col("nth") <= most)
    rows = cut_lineage(rows)
    vectors = rows.where("nth = 1").select(F.col("key").alias("vid"), "v")
    cells = min(MAX_CELLS, max(1, math.ceil(vectors.count() / CELL)))
    if cells == 1:
        placed = rows.withColumn("cell", F.lit(0))
        return placed, vectors.select("vid", "v", F.lit(float("inf")).alias("u"), F.lit(0).alias("cell")), None
    seen = vectors.orderBy(C.seeded_hash("vid", SEED), "vid").limit(SEEN * cells).select("v").toArrow()  # at most SEEN * MAX_CELLS
    cuts = Cells.fit(np.array(seen.column("v").to_pylist(), dtype=float), cells)
    placed = cut_lineage(rows.mapInPandas(_assign(cuts), "v array<double>, key string, nth int, cell int"))
    own = placed.where("nth = 1").select(F.col("key").alias("vid"), "v", F.lit(float("inf")).alias("u"), "cell")
    return placed, own, cuts


def _other_cells(placed: DataFrame, own: DataFrame, near: DataFrame, cuts: Cells, most: int) -> DataFrame:
    """(vid, v, u, cell): what is still to be searched once the own cells are. u: no answer lies farther away."""
    k = placed.select(F.size("v")).first()[0]
    ends = placed.groupBy("cell").agg(*[f(F.col("v")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(k)])
    boxes = np.stack([np.full((len(cuts), k), v) for v in (np.inf, -np.inf)])  # a cell without rows is never searched
    for r in ends.collect():  # a row a cell
        boxes[:, r["cell"]] = np.reshape(r[1:], (2, k))
    full = near.groupBy("vid").agg(F.when(F.count("*") == most, F.max("distance")).alias("_u"))
    bounded = own.drop("u").join(full, "vid", "left").select("vid", "v", F.coalesce("_u", F.lit(float("inf"))).alias("u"), "cell")
    return bounded.mapInPandas(_survivors(boxes), "vid string, v array<double>, u double, cell int")


def knn(points: DataFrame, k: int = 5, id_col: str = K.ID_COL, features: list[str] = K.FEATURES) -> DataFrame:
    """(id, row key, rank, neighbor_id, neighbor_key, distance, neighbor_vec) for the k nearest other points."""
    pts = cut_lineage(with_row_key(points, id_col, features).select(
        F.col(KEY).alias("key"), F.col(id_col).alias("id"), _vector(features).alias("v"))
        .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))))
    most = k + 1  # a point is an answer to its own vector
    placed, own, cuts = _searched(pts, most)
    near = _first(_compare(own, placed, most), most)
    if cuts is not None:
        near = cut_lineage(near)
        rest = cut_lineage(_other_cells(placed, own, near, cuts, most))
        near = _first(near.unionByName(_compare(rest, placed, most)), most)
    others = placed.select(F.col("key").alias("nkey"), F.col("v").alias("nv")).join(
        pts.select(F.col("key").alias("nkey"), F.col("id").alias("nid")), "nkey")
    answers = (near.join(others, "nkey").groupBy("vid")
               .agg(F.sort_array(F.collect_list(F.struct("distance", "nkey", "nid", "nv"))).alias("near")))  # k + 1 a vector
    named = own.select("vid", "v").join(answers, "vid").select("v", "near")
    mine = F.slice(F.filter("near", lambda x: x["nkey"] != F.col("key")), 1, k)
    return (pts.join(named, "v").select("id", "key", F.posexplode(mine).alias("_at", "_n"))
            .select(F.col("id").alias(id_col), F.col("key").alias(KEY), (F.col("_at") + 1).alias("rank"),
                    F.col("_n.nid").alias("neighbor_id"), F.col("_n.nkey").alias("neighbor_key"),
                    F.bround("_n.distance", DIGITS).alias("distance"), F.col("_n.nv").alias("neighbor_vec")))


def _classes(base: DataFrame, label: str):
    counts = {r[label]: r["n"] for r in base.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 rows
    if len(counts) < 2:
        return counts, None, None
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    return counts, minority, majority


def minority_neighbours(train: DataFrame, k: int = 5, label: str = "label", id_col: str = K.ID_COL,
                        features: list[str] = K.FEATURES, max_fit_rows: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(materialised training rows, k-NN table of the minority class) - the part of SMOTE
    that does not depend on the sampling ratio."""
    base = cut_lineage(with_row_key(train, id_col, features).select(id_col, KEY, label, *features))
    counts, minority, _ = _classes(base, label)
    if minority is None or counts[minority] < 2:
        return base, None
    points = base.where(F.col(label) == minority)
    if max_fit_rows and counts[minority] > max_fit_rows:
        points = points.orderBy(C.seeded_hash(KEY, SEED), KEY).limit(max_fit_rows)
    # k rows per minority point, read by every synthesis that reuses it: materialise once
    return base, cut_lineage(knn(points, k, id_col, features))


def oversample(train: DataFrame, ratio: float = 1.0, k: int = 5, label: str = "label",
               id_col: str = K.ID_COL, features: list[str] = K.FEATURES, seed: int = SEED,
               neighbours: DataFrame | None = None, max_fit_rows: int | None = None) -> DataFrame:
    """Training rows plus synthetic minority rows so that minority = ratio x majority.
    Only ``id_col``, ``label`` and the feature columns are kept. ``neighbours`` (from
    ``minority_neighbours`` on the same rows) skips the neighbour search."""
    if neighbours is None:
        base, nn = minority_neighbours(train, k, label, id_col, features, max_fit_rows)
    else:
        base, nn = with_row_key(train, id_col, features).select(id_col, KEY, label, *features), neighbours
    counts, minority, majority = _classes(base, label)
    rows = base.drop(KEY).withColumns({f: F.col(f).cast("double") for f in features})
    if minority is None or nn is None:
        return base.drop(KEY)
    n_new = int(ratio * counts[majority]) - counts[minority]
    if n_new <= 0:
        return rows
    seeds = nn.groupBy(KEY).agg(F.max("rank").alias("kk"))  # the points of the fit, and their neighbours
    n_min = seeds.count()
    mins = base.where(F.col(label) == minority).join(seeds, KEY)
    per, extra = divmod(n_new, n_min)
    pos = hash_positions(seeds.select(C.seeded_hash(KEY, seed).alias("_key"), F.lit(0).alias("_g")), ["_g"], "_key")
    keyed = mins.withColumn("_key", C.seeded_hash(KEY, seed)).join(pos.select("_key", "w_before"), "_key")
    reps = F.lit(per) + (F.col("w_before") < extra).cast("int")
    gen = (keyed.where(reps > 0).select(KEY, "kk", _vector(features).alias("vec"),
                                        F.explode(F.sequence(F.lit(0), reps - 1)).alias("t")))
    h = F.md5(F.concat(F.col(KEY), F.lit("/"), F.col("t").cast("string"), F.lit(f"/{seed}")))
    gen = gen.withColumns({
        "rank": (F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.col("kk")) + 1).cast("int"),
        "u": F.conv(F.substring(h, 9, 8), 16, 10).cast("double") / float(2 ** 32)})
    syn = gen.join(nn.select(KEY, "rank", "neighbor_vec"), [KEY, "rank"])
    new_vec = F.zip_with("vec", "neighbor_vec", lambda a, b: a + F.col("u") * (b - a))
    syn = syn.select(F.concat(F.col(KEY), F.lit("#smote"), F.col("t").cast("string")).alias(id_col),
                     F.lit(minority).cast(base.schema[label].dataType).alias(label), new_vec.alias("v"))
    syn = syn.select(id_col, label, *[F.col("v")[i].alias(f) for i, f in enumerate(features)])
    return rows.unionByName(syn)


def smote_counts(train: DataFrame, oversampled: DataFrame, label: str = "label") -> DataFrame:
    before = train.groupBy(label).agg(F.count(F.lit(1)).alias("before"))
    after = oversampled.groupBy(label).agg(F.count(F.lit(1)).alias("after"))
    return before.join(after, label, "full")
