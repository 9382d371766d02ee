"""Tree-model explanations: path-dependent TreeSHAP, default importance, sampled
Shapley values (I2-I5, I9).

The values are those of path-dependent TreeSHAP (Lundberg, Erion, Lee 2018, "Consistent
individualized feature attribution for tree ensembles"), computed leaf by leaf (``_path_shap``). The model is its node table, one row per node, which
the tasks read: rows are dealt into row blocks and trees into tree blocks, every pair of blocks is one task's work, and
the partial attributions of a row are summed over the tree blocks. No node reaches the driver and nothing is
broadcast, so neither the number of trees nor their depth is bounded by one process. Inside a task the walk over a tree is
shared by all rows of the block. What a leaf adds to a row depends only on which features of its path let the row through, so
it is computed once for each such pattern, and a row costs O(depth) lookups a leaf.

Attributions stay one array per customer (``Attributions``): ranking them and their running sums are row-local.

Explained value: random forest -> P(churn) (sum of the trees' leaf shares); boosted trees -> the margin.
Local accuracy holds: base value + sum(phi) = explained value.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..session import cut_lineage
from . import grow as GR
from .rank import hash_positions

ROW_BLOCK, SMALL_BLOCK, TREE_BLOCK = 16384, 1024, 32
DIGITS = 9


@dataclass
class TreeArrays:
    left: np.ndarray        # child index or -1
    right: np.ndarray
    feature: np.ndarray     # split feature or -1
    threshold: np.ndarray   # go left when x <= threshold
    value: np.ndarray       # leaf value (already multiplied by the tree weight / 1/numTrees)
    cover: np.ndarray       # weighted training count at the node


def _trees(nodes: pd.DataFrame) -> list[TreeArrays]:
    """The trees of a node table (tree, node, feature, threshold, left, right, value, cover)."""
    out = []
    for _, g in nodes.sort_values(["tree", "node"]).groupby("tree"):
        out.append(TreeArrays(*[g[c].to_numpy() for c in ("left", "right", "feature", "threshold", "value", "cover")]))
    return out


def _expected(t: TreeArrays, j: int = 0) -> float:
    if t.left[j] < 0:
        return t.value[j]
    lc, rc = t.left[j], t.right[j]
    cl, cr = t.cover[lc], t.cover[rc]
    tot = cl + cr
    if tot <= 0:
        return 0.5 * (_expected(t, lc) + _expected(t, rc))
    return (cl * _expected(t, lc) + cr * _expected(t, rc)) / tot


def _path_shap(z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Shapley values (features of the path x patterns) of a leaf of value 1; z: the share of the training rows that each feature
    lets through, o: whether it lets the row through.

    The game of a leaf is a product, one factor a feature, o with the feature known and z without. Its Shapley values are
    (o - z) times the integral over t in [0, 1] of the other features' o t + z (1 - t): a polynomial of a degree below the number
    of features, which Gauss-Legendre nodes, half as many, integrate exactly.
    """
    at, weights = np.polynomial.legendre.leggauss((len(z) + 1) // 2)
    out, z = np.zeros(o.shape), z[:, None]
    for t, w in zip((at + 1) / 2, weights / 2):
        factors = o * t + z * (1 - t)
        # a factor of 0 belongs to a feature of o = z = 0, whose value is 0; that of all others has the factor
        out += w * factors.prod(axis=0) / np.where(factors == 0, 1.0, factors)
    return (o - z) * out


@functools.lru_cache(maxsize=64)
def _patterns(d: int) -> np.ndarray:
    return ((np.arange(1 << d) >> np.arange(d)[:, None]) & 1).astype(float)


def _tree_shap(t: TreeArrays, X: np.ndarray, phi: np.ndarray) -> None:
    """Add the SHAP values of one tree for all rows into phi; X and phi hold one row for each feature, one column for each row.

    What a leaf gives to a row depends only on which of the path's features let the row through: one bit for each feature. The
    values of all patterns are computed once for the leaf and looked up for the rows.
    """
    n = X.shape[1]

    def leaf(v, path, code):
        d = len(path)
        z = np.array([share for _, share in path])
        if 1 << d <= max(n, 2):
            table = _path_shap(z, _patterns(d))
        else:  # more patterns than rows: only those that occur
            found, code = np.unique(code, return_inverse=True)
            table = _path_shap(z, ((found >> np.arange(d)[:, None]) & 1).astype(float))
        for (f, _), values in zip(path, table * v):
            phi[f] += values.take(code)

    def recurse(j, path, code):
        if t.left[j] < 0:
            if path:
                leaf(t.value[j], path, code)
            return
        f, lc, rc = t.feature[j], t.left[j], t.right[j]
        low = X[f] <= t.threshold[j]
        cj = t.cover[lc] + t.cover[rc]
        place = next((i for i, (g, _) in enumerate(path) if g == f), len(path))
        if place > 62:
            raise ValueError("a path of more than 63 different features")
        for child, goes in ((lc, low), (rc, ~low)):
            share = t.cover[child] / cj if cj > 0 else 0.5
            if place < len(path):  # the feature again: a row passes if it passed before
                below = path[:place] + [(f, path[place][1] * share)] + path[place + 1:]
                recurse(child, below, code & ~((~goes).astype(np.int64) << place))
            else:
                recurse(child, [*path, (f, share)], code | (goes.astype(np.int64) << place))

    recurse(0, [], np.zeros(n, dtype=np.int64))


def shap_values(trees: list[TreeArrays], X: np.ndarray) -> tuple[np.ndarray, float]:
    columns = np.ascontiguousarray(X.T)
    phi = np.zeros(columns.shape)
    for t in trees:
        _tree_shap(t, columns, phi)
    return phi.T, float(sum(_expected(t) for t in trees))


def attribute(nodes: DataFrame, rows: DataFrame, features: list[str], id_col: str = K.ID_COL, base: float = 0.0,
              row_block: int = ROW_BLOCK, tree_block: int = TREE_BLOCK) -> DataFrame:
    """(id, base, x, phi): base value, feature values and their attributions as arrays in the order of ``features`` (I4).

    ``nodes`` is a node table, whose values add up to the model's output less ``base``. Customers with equal id and values are
    computed once and returned as often as they occur. An ensemble without trees attributes nothing.
    """
    x = F.array(*[F.col(f).cast("double") for f in features])
    own = rows.select(F.col(id_col).cast("string").alias("id"), x.alias("x")).groupBy("id", "x").agg(F.count("*").alias("copies"))
    counts = own.agg(F.count("*")).first()[0], nodes.agg(F.max("tree")).first()[0]
    tree_blocks = 1 if counts[1] is None else counts[1] // tree_block + 1
    # a large block shares the work for a leaf; a few rows are dealt into smaller ones, two pairs of blocks a core
    spread = math.ceil(2 * rows.sparkSession.sparkContext.defaultParallelism / tree_blocks)
    row_blocks = max(1, math.ceil(counts[0] / row_block), min(spread, math.ceil(counts[0] / SMALL_BLOCK)))
    k = len(features)

    def some(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = own.select("*", F.pmod(F.xxhash64("id", "x"), F.lit(row_blocks)).cast("int").alias("rb"), some(tree_blocks).alias("tb"))
    right = nodes.select("*", F.floor(F.col("tree") / tree_block).cast("int").alias("tb"), some(row_blocks).alias("rb"))

    def kernel(some_rows: pd.DataFrame, some_nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(some_rows):
            return pd.DataFrame({"id": [], "x": [], "copies": [], "part": []})
        values = np.stack(some_rows["x"].to_list())
        phi, expected = shap_values(_trees(some_nodes), values)
        parts = np.c_[phi, np.full(len(phi), expected)]
        return some_rows[["id", "x", "copies"]].assign(part=list(parts))

    # a given number of partitions: pairs of blocks are small in bytes and long in time, and must not be coalesced into few tasks
    tasks = max(1, min(row_blocks * tree_blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    left, right = left.repartition(tasks, "rb", "tb"), right.repartition(tasks, "rb", "tb")
    parts = left.groupBy("rb", "tb").cogroup(right.groupBy("rb", "tb")).applyInPandas(
        kernel, "id string, x array<double>, copies bigint, part array<double>")
    total = parts.groupBy("id", "x").agg(F.first("copies").alias("copies"), *[F.sum(F.col("part")[i]).alias(f"p{i}") for i in range(k + 1)])
    found = total.select(F.col("id").alias(id_col), (F.lit(float(base)) + F.col(f"p{k}")).alias("base"), "x",
                         F.array(*[F.col(f"p{i}") for i in range(k)]).alias("phi"), "copies")
    return found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies")


@dataclass
class Attributions:
    """``table`` (id, base, x, phi) in the form that ``explain.top_factors`` and ``explain.waterfall`` take as a scorer."""
    name: str
    features: list[str]
    table: DataFrame

    @property
    def intercept(self) -> Column:
        return F.col("base")

    def contributions(self) -> Column:
        names = F.array(*[F.lit(f) for f in self.features])
        pairs = F.arrays_zip(names.alias("feature"), F.col("x").alias("value"), F.col("phi").alias("contribution"))
        return F.transform(pairs, lambda p: F.struct(
            p["feature"].alias("feature"), p["value"].alias("value"), F.lit(None).cast("double").alias("coefficient"),
            (F.bround(p["contribution"], DIGITS) + F.lit(0.0)).alias("contribution")))

    def long(self, id_col: str = K.ID_COL) -> DataFrame:
        """(id, model, feature, value, contribution) and one ``base_value`` row per customer."""
        first = F.array(F.struct(F.lit("base_value").alias("feature"), F.lit(float("nan")).alias("value"),
                                 F.col("base").alias("contribution")))
        names = F.array(*[F.lit(f) for f in self.features])
        rest = F.transform(F.arrays_zip(names.alias("feature"), F.col("x").alias("value"), F.col("phi").alias("contribution")),
                           lambda p: F.struct(p["feature"].alias("feature"), p["value"].alias("value"),
                                              p["contribution"].alias("contribution")))
        return self.table.select(id_col, F.explode(F.concat(first, rest)).alias("c")).select(
            id_col, F.lit(self.name).alias("model"), "c.feature", "c.value", "c.contribution")


def attributions(fitted, df: DataFrame, id_col: str = K.ID_COL) -> Attributions:
    """Attributions of a fitted ensemble for every row of ``df``."""
    e = fitted.ensemble
    table = attribute(e.table(df.sparkSession), fitted.prepare(df), e.features, id_col, e.base)
    return Attributions(fitted.name, e.features, table)


def tree_contributions(fitted, df: DataFrame, id_col: str = K.ID_COL) -> DataFrame:
    """Long table (customerID, model, feature, value, contribution) plus one ``base_value`` row per customer (I4)."""
    return attributions(fitted, df, id_col).long(id_col)


def default_importance(fitted) -> DataFrame:
    """Model-native importance: tree gains, or |coefficient| for linear models; zeros when the model exposes neither."""
    from pyspark.sql import SparkSession
    ss = SparkSession.getActiveSession()
    if hasattr(fitted, "ensemble"):
        imp = fitted.ensemble.importance()
    else:
        clf = fitted.pipeline.stages[-1]
        imp = np.abs(clf.coefficients.toArray()) if hasattr(clf, "coefficients") else np.zeros(len(K.FEATURES))
    imp = list(imp[:len(K.FEATURES)]) + [0.0] * max(0, len(K.FEATURES) - len(imp))
    return ss.createDataFrame([(fitted.name, f, float(v)) for f, v in zip(K.FEATURES, imp)],
                              "model string, feature string, importance double")


def predictor(fitted, margin: bool = False):
    """A numpy function of prepared feature rows: the probability of churn (or the margin)."""
    if hasattr(fitted, "ensemble"):
        arrays, base, forest = fitted.ensemble.arrays(), fitted.ensemble.base, fitted.ensemble.kind == "forest"

        def trees(x: np.ndarray) -> np.ndarray:
            out = GR.outputs(arrays, base, x)
            return out if forest or margin else 1 / (1 + np.exp(-out))
        return trees
    lr = fitted.pipeline.stages[-1]
    weights, start = lr.coefficients.toArray(), float(lr.intercept)

    def linear(x: np.ndarray) -> np.ndarray:
        out = x @ weights + start
        return out if margin else 1 / (1 + np.exp(-out))
    return linear


def _numbered(rows: DataFrame, id_col: str, seed: int) -> tuple[DataFrame, int]:
    """(at, b): the feature vectors of ``rows``, numbered 0, 1, ... in hash order of the id, and how many they are."""
    keyed = rows.withColumn("_key", C.seeded_hash(id_col, seed))
    place = hash_positions(keyed.select("_key", F.lit(0).alias("_g")), ["_g"], "_key").select("_key", "w_before")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("b")) - 1  # copies of an id
    out = cut_lineage(keyed.join(place, "_key").select((F.col("w_before") + nth).alias("at"), "b"))
    return out, out.count()


def sampled_shapley(fitted, df: DataFrame, background: DataFrame, draws: int = 24, id_col: str = K.ID_COL, seed: int = 42,
                    margin: bool = False) -> DataFrame:
    """(id, model, feature, contribution, std_error): model-agnostic Shapley values with their error.

    Each draw of a row is one background row, dealt by a hash from all rows of ``background`` through a join, and one
    permutation of the features walked forwards and backwards (antithetic). Along it the row's values replace the background's
    one by one, and a feature's effect is the change of the model's output. The draw is one row, whose coalitions are scored and
    differenced in one batch; its values are averaged over the draws, and their spread gives the standard error. The feature
    ``base_value`` is the mean output of the drawn background rows: with it a row's values add up to its own output.
    All rows of ``df`` are explained; an empty background explains none.
    """
    feats, d = list(K.FEATURES), len(K.FEATURES)
    vector = F.array(*[F.col(f).cast("double") for f in feats])
    pool, n = _numbered(fitted.prepare(background).select(id_col, vector.alias("b")), id_col, seed)
    rows = fitted.prepare(df).select(F.col(id_col).cast("string").alias(id_col), vector.alias("x"))
    unit = F.pmod(F.xxhash64(F.lit(seed), id_col, "x", "draw"), F.lit(max(1, n)))
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("at", unit)
    met = drawn.join(pool, "at").select(id_col, "x", "b", F.xxhash64(F.lit(seed), id_col, "draw").alias("h"))
    predict = predictor(fitted, margin)

    @F.pandas_udf("array<double>")
    def effects(x: pd.Series, b: pd.Series, h: pd.Series) -> pd.Series:
        """The effects of all features in one draw, then the background row's output."""
        out = []
        for i in range(0, len(x), 256):
            xs, bs = np.stack(x.iloc[i:i + 256].to_list()), np.stack(b.iloc[i:i + 256].to_list())
            order = np.stack([np.random.default_rng(int(v) & (2 ** 63 - 1)).permutation(d) for v in h.iloc[i:i + 256]])
            total = np.zeros((len(xs), d + 1))
            for way in (order, order[:, ::-1]):
                place = np.argsort(way, axis=1)
                mixed = np.where(place[:, None, :] < np.arange(d + 1)[None, :, None], xs[:, None, :], bs[:, None, :])
                value = predict(mixed.reshape(-1, d)).reshape(len(xs), d + 1)
                np.put_along_axis(total, way, np.take_along_axis(total, way, 1) + np.diff(value, axis=1) / 2, 1)
                total[:, d] += value[:, 0] / 2
            out += list(total)
        return pd.Series(out)

    per_draw = met.select(id_col, effects("x", "b", "h").alias("e"))
    means = per_draw.groupBy(id_col).agg(*[f(F.col("e")[i]).alias(f"{c}{i}") for i in range(d + 1)
                                           for c, f in (("m", F.avg), ("s", F.stddev_samp))], F.count("*").alias("k"))
    return means.select(id_col, F.lit(fitted.name).alias("model"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("contribution"),
                 (F.col(f"s{i}") / F.sqrt("k")).alias("std_error")) for i, f in enumerate([*feats, "base_value"])])).alias("c")
    ).select(id_col, "model", "c.*")


# FIXED VALUES of this library (not from the reference): a frozen ensemble over encoded features, a deterministic
# stand-in for fitted trees. (tree, node, feature, threshold, left, right, value, cover); no feature: a leaf.
FROZEN_TREES = [
    (0, 0, "tenure", 12.0, 1, 2, 0.0, 1000.0), (0, 1, "Contract", 0.0, 3, 4, 0.0, 500.0), (0, 2, "MonthlyCharges", 70.0, 5, 6, 0.0, 500.0),
    (0, 3, None, 0.0, -1, -1, 0.62, 310.0), (0, 4, None, 0.0, -1, -1, 0.21, 190.0), (0, 5, None, 0.0, -1, -1, -0.35, 270.0),
    (0, 6, None, 0.0, -1, -1, -0.08, 230.0),
    (1, 0, "internet_no_tech_support", 0.0, 1, 2, 0.0, 1000.0), (1, 1, None, 0.0, -1, -1, -0.17, 600.0),
    (1, 2, "tenure", 24.0, 3, 4, 0.0, 400.0), (1, 3, None, 0.0, -1, -1, 0.43, 260.0), (1, 4, None, 0.0, -1, -1, 0.05, 140.0),
    (2, 0, "Contract", 1.0, 1, 2, 0.0, 1000.0), (2, 1, "PaymentMethod", 1.0, 3, 4, 0.0, 620.0), (2, 2, None, 0.0, -1, -1, -0.4, 380.0),
    (2, 3, None, 0.0, -1, -1, 0.02, 220.0), (2, 4, "Contract", 0.0, 5, 6, 0.0, 400.0), (2, 5, None, 0.0, -1, -1, 0.31, 240.0),
    (2, 6, None, 0.0, -1, -1, -0.12, 160.0),
    (3, 0, "clv", 2500.0, 1, 2, 0.0, 1000.0), (3, 1, "services_count", 3.0, 3, 4, 0.0, 500.0), (3, 2, "TotalCharges", 1000.0, 5, 6, 0.0, 500.0),
    (3, 3, None, 0.0, -1, -1, 0.07, 330.0), (3, 4, None, 0.0, -1, -1, -0.03, 170.0), (3, 5, None, 0.0, -1, -1, 0.19, 210.0),
    (3, 6, None, 0.0, -1, -1, -0.22, 290.0),
]


def frozen_attributions(df: DataFrame, id_col: str = K.ID_COL) -> Attributions:
    """Attributions of the frozen ensemble; a missing value counts as 0."""
    feats = list(K.FEATURES)
    rows = [(t, n, -1 if f is None else feats.index(f), thr, low, high, v, c) for t, n, f, thr, low, high, v, c in FROZEN_TREES]
    nodes = df.sparkSession.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, "
                                                  "value double, cover double")
    filled = df.select(id_col, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in feats])
    return Attributions("frozen_trees", feats, attribute(nodes, filled, feats, id_col))
