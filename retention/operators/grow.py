"""Tree ensembles grown level by level from grouped histograms (M2, M3).

Training rows are binned once and stored: one byte for each feature, and for every tree the number of times the row is in its
bag, a Poisson count taken from md5(key/tree). So whether a row is out of a tree's bag can be told at any time, from the
row alone. One level of all trees is one job: each task walks its rows down the trees grown so far and adds up
(tree, node, feature, bin) cells in numpy; the cells are summed by Spark, and window sums over the bins give the best
split of each node in SQL. Chosen splits reach the driver: as many as the model has nodes. Where there are few cells, of all
tasks or of their sums (an eighth of ``PER_TASK``), the cells do, and numpy picks the same splits.

A node of a forest with few rows and many levels to go (``LOCAL``, ``LEVELS``) is not taken further that way, where a level would
be a job over all rows and the driver would draw for every node: its rows are sent to one task, which grows all that is below it
by the same rule (``grow_below``).

Cells are whole numbers (counts, or gradients in units of 2^-24), so sums do not depend on their order and refits agree.

* forest: Gini impurity, class weights balanced within each bag, a random subset of features for each node
* boosted: second-order logistic loss; gain and leaves from gradient sums G and hessian sums H with L1 (alpha), L2 (lambda)
  and a price per split (gamma); rows and features are drawn for each tree

Several boosted ensembles of the same rows grow side by side, as a search needs them: one level of the current tree of all of
them is one job. The rows carry each ensemble's margin, brought up to date every ``STORED`` rounds, so a round costs as much at
the end as at the start.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .draws import permutations

BINS = 64
UNIT = 1 << 24
#: cells of one job at most (a task holds three sums of each); more open nodes are taken in several jobs
CELLS = 1 << 22
#: cells of all tasks that one task sums; the driver gets an eighth of that at most, of all tasks or of their sums
PER_TASK = 1 << 20
#: rows times ensembles that one task of a boosting round takes at least: below, starting the task takes longer than its work
ROWS_PER_TASK = 4096
#: a node of at most so many rows in the bag, and with at least so many levels to go, is grown to its end in one task
LOCAL = 16384
LEVELS = 5
#: bytes of rows that a task sends on at a time
SENT = 1 << 24
#: rows that walk down the trees at a time: what they look at stays in the processor's cache
STRIP = 1024
#: rounds of boosting between two times that the rows' margins are stored
STORED = 10
ACCURACY = 10_000


def hash_unit(key: str | Column, tree: Column, seed: int) -> Column:
    """Eight hex digits of md5(key/tree/seed) as a number below 2^32."""
    key = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat_ws("/", key.cast("string"), tree.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def poisson_steps(most: int = 8) -> list[int]:
    """Upper ends, in units of 2^-32, of the ranges of a uniform number that stand for Poisson(1) counts 0, 1, ..."""
    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(math.floor(total * 2 ** 32))
    return out


def bag_count(unit: Column) -> Column:
    """The Poisson(1) count of a hash below 2^32."""
    out = F.lit(0)
    for end in poisson_steps():
        out = out + (unit >= F.lit(end)).cast("int")
    return out


def bags(key: str, trees: int, seed: int, share: float | list[float] | None = None) -> Column:
    """For each tree how often the row is in its bag; with ``share`` 1 for that share of the rows, else 0; of several shares
    how many hold the row."""
    shares = share if isinstance(share, list) else [] if share is None else [share]

    def one(unit: Column) -> Column:
        held = [(unit < F.lit(math.floor(s * 2 ** 32))).cast("int") for s in shares]
        return (reduce(add, held) if held else bag_count(unit)).cast("tinyint")

    if shares and min(shares) >= 1:  # every hash is below every end
        return F.array_repeat(F.lit(len(shares)).cast("tinyint"), trees)
    # the hashes first: a lambda computes its expression anew wherever it stands, and a count looks at its hash eight times
    hashes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: hash_unit(key, t, seed))
    return F.transform(hashes, one)


def bin_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> dict[str, np.ndarray]:
    """Where each feature may be cut (x <= edge): between all its values if they are at most ``bins``, else at quantiles."""
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v"))
                                             for f in features])).alias("c")).select("c.f", "c.v")
    # at most bins + 1 values of a feature are kept in each partial sum
    few = values.distinct().groupBy("f").agg(F.count("*").alias("n"))
    small = [r["f"] for r in few.collect() if r["n"] <= bins]
    edges: dict[str, list[float]] = {f: [] for f in features}
    if small:
        for r in values.where(F.col("f").isin(small)).groupBy("f").agg(F.sort_array(F.collect_set("v")).alias("v")).collect():
            edges[r["f"]] = r["v"][:-1]
    large = [f for f in features if f not in small]
    if large:
        at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        r = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), at, ACCURACY).alias(f) for f in large]).first()
        edges |= {f: sorted(set(r[f] or [])) for f in large}
    return {f: np.array(edges[f], dtype=np.float64) for f in features}


@dataclass
class Ensemble:
    """Node arrays of all trees; feature -1: a leaf. Rows with x <= threshold go left. The output is base + sum of leaves.

    Lists while the trees grow; numpy arrays once subtrees that tasks have grown are hung in (``hang_in``)."""
    kind: str
    features: list[str]
    base: float = 0.0
    roots: list[int] = field(default_factory=list)
    tree: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    total: np.ndarray | None = None  # of a forest that was grown here: the size of each tree's bag

    def add(self, tree: int) -> int:
        for name, v in (("tree", tree), ("feature", -1), ("cut", -1), ("threshold", 0.0), ("left", -1), ("right", -1),
                        ("value", 0.0), ("cover", 0.0), ("gain", 0.0)):
            getattr(self, name).append(v)
        return len(self.tree) - 1

    def extend(self, part: Ensemble, number: dict[int, int]) -> None:
        """Take over the trees of ``part`` that ``number`` has a new number for."""
        place = {i: self.add(number[t]) for i, t in enumerate(part.tree) if t in number}
        for i, at in place.items():
            for name in ("feature", "cut", "threshold", "value", "cover", "gain"):
                getattr(self, name)[at] = getattr(part, name)[i]
            for name in ("left", "right"):
                getattr(self, name)[at] = place.get(getattr(part, name)[i], -1)
        self.roots += [place[r] for r in part.roots if r in place]

    def arrays(self) -> dict[str, np.ndarray]:
        kinds = {"feature": np.int32, "cut": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32,
                 "value": np.float64}
        return {k: np.array(getattr(self, k), dtype=t) for k, t in kinds.items()} | {"roots": np.array(self.roots, dtype=np.int32)}

    def table(self, spark) -> DataFrame:
        """(tree, node, feature, threshold, left, right, value, cover); nodes are numbered within their tree, 0 is the root."""
        tree, at = np.array(self.tree, dtype=np.int32), np.arange(len(self.tree))
        inner = np.ones(len(tree), dtype=bool)
        inner[np.array(self.roots, dtype=int)] = False
        order = np.lexsort((at, inner, tree))
        place = np.empty(len(tree), dtype=np.int32)
        place[order] = at - np.searchsorted(tree[order], tree[order])

        def child(of) -> np.ndarray:
            of = np.array(of, dtype=int)
            return np.where(of >= 0, place[of], -1).astype(np.int32) if len(of) else of.astype(np.int32)

        numbers = {k: np.array(getattr(self, k), dtype=np.float64) for k in ("threshold", "value", "cover")}
        columns = {"tree": tree, "node": place, "feature": np.array(self.feature, dtype=np.int32), "threshold": numbers["threshold"],
                   "left": child(self.left), "right": child(self.right), "value": numbers["value"], "cover": numbers["cover"]}
        return spark.createDataFrame(pa.table(columns), "tree int, node int, feature int, threshold double, left int, right int, "
                                                        "value double, cover double")

    @classmethod
    def from_rows(cls, kind: str, features: list[str], base: float, rows: list) -> Ensemble:
        """The ensemble of a node table's rows; thresholds only, without bins and gains."""
        out = cls(kind, features, base)
        rows = sorted(rows, key=lambda r: (r["tree"], r["node"]))
        at = {(r["tree"], r["node"]): i for i, r in enumerate(rows)}
        for r in rows:
            i = out.add(r["tree"])
            if r["node"] == 0:
                out.roots.append(i)
            for name in ("feature", "threshold", "value", "cover"):
                getattr(out, name)[i] = r[name]
            for name in ("left", "right"):
                getattr(out, name)[i] = at.get((r["tree"], r[name]), -1)
        return out

    def hang_in(self, below: dict[int, dict[str, np.ndarray]]) -> None:
        """Hang in subtrees by the node that each grows from; their nodes are numbered within them, 0 is that node."""
        names = ("tree", "feature", "cut", "threshold", "left", "right", "value", "cover", "gain")
        held = {k: [np.array(getattr(self, k), dtype=np.int32 if k in names[:3] + names[4:6] else np.float64)] for k in names}
        size = len(self.tree)
        for node, part in sorted(below.items()):
            place = lambda c: np.where(c > 0, c + (size - 1), -1).astype(np.int32)
            moved = part | {"left": place(part["left"]), "right": place(part["right"]),
                            "tree": np.full(len(part["feature"]), self.tree[node], dtype=np.int32)}
            for k in names:
                held[k][0][node] = moved[k][0]
                held[k].append(moved[k][1:])
            size += len(part["feature"]) - 1
        for k in names:
            setattr(self, k, np.concatenate(held[k]))

    def cut_off(self, params: dict) -> Ensemble:
        """The forest of fewer trees, a smaller depth or a larger least gain that draws alike: its first trees, each up to where
        it stops."""
        a = {k: np.array(getattr(self, k)) for k in ("tree", "feature", "cut", "threshold", "left", "right", "value", "cover", "gain")}
        trees, most, least = int(params["numTrees"]), int(params["maxDepth"]), float(params["minInfoGain"])
        out, at, kept, depth = Ensemble(self.kind, self.features, self.base, params=dict(params)), np.array(self.roots[:trees], dtype=int), [], 0
        place, stops = np.full(len(a["tree"]), -1), a["gain"] / self.total[a["tree"]] < least
        while len(at):
            place[at] = sum(map(len, kept)) + np.arange(len(at))
            kept.append(at)
            if depth >= most:
                stops[at] = True
            inner = at[(a["feature"][at] >= 0) & ~stops[at]]
            at, depth = np.c_[a["left"][inner], a["right"][inner]].ravel(), depth + 1
        order = np.concatenate(kept) if kept else at
        leaf = (a["feature"][order] < 0) | stops[order]
        for k, v in a.items():
            v = v[order]
            if k in ("left", "right"):
                v = np.where(leaf, -1, place[v])
            elif k != "tree" and k not in ("value", "cover"):
                v = np.where(leaf, -1 if k in ("feature", "cut") else 0.0, v)
            setattr(out, k, v.astype(a[k].dtype))
        out.value = out.value * (len(self.roots) / trees)  # a tree's part of the mean
        out.roots = list(range(trees))
        return out

    def importance(self) -> np.ndarray:
        """Gain per feature: of the forest the mean of the trees' shares, of boosted trees the share of the mean gain per split."""
        k = len(self.features)
        f, g, t = np.array(self.feature, dtype=int), np.array(self.gain), np.array(self.tree, dtype=int)
        inner = f >= 0
        if not inner.any():
            return np.zeros(k)
        if self.kind == "boosted":
            n = np.bincount(f[inner], minlength=k)
            out = np.bincount(f[inner], weights=g[inner], minlength=k) / np.maximum(1, n)
        else:
            per = np.zeros((t.max() + 1, k))
            np.add.at(per, (t[inner], f[inner]), g[inner])
            total = per.sum(axis=1, keepdims=True)
            out = np.divide(per, total, out=np.zeros_like(per), where=total > 0).sum(axis=0)
        return out / out.sum() if out.sum() > 0 else out


def leaves(a: dict[str, np.ndarray], roots: np.ndarray, x: np.ndarray, by: str = "threshold") -> np.ndarray:
    """The node that each row of ``x`` (values, or bins with by='cut') reaches in each tree: rows x trees."""
    at = np.broadcast_to(roots, (len(x), len(roots))).copy()
    rows = np.arange(len(x))[:, None]
    while True:
        f = a["feature"][at]
        inner = f >= 0
        if not inner.any():
            return at
        low = x[rows, np.maximum(f, 0)] <= a[by][at]
        at = np.where(inner, np.where(low, a["left"][at], a["right"][at]), at)


def outputs(a: dict[str, np.ndarray], base: float, x: np.ndarray, by: str = "threshold", step: int = 64) -> np.ndarray:
    out = np.full(len(x), base)
    for low in range(0, len(x), STRIP):
        at = slice(low, low + STRIP)
        for i in range(0, len(a["roots"]), step):
            out[at] += a["value"][leaves(a, a["roots"][i:i + step], x[at], by)].sum(axis=1)
    return out


def binned(train: DataFrame, edges: dict[str, np.ndarray], key: str, label: str, bag: Column) -> DataFrame:
    """(key, label, bag, x): x holds one byte for each feature."""
    names = list(edges)
    cuts = list(edges.values())
    src = train.select(F.col(key).cast("string").alias("key"), F.col(label).cast("int").alias("label"), bag.alias("bag"),
                       *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.empty((b.num_rows, len(cuts)), dtype=np.uint8)
            for i, e in enumerate(cuts):
                x[:, i] = np.searchsorted(e, b.column(3 + i).to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["key", "label", "bag", "x"])

    out = src.mapInArrow(run, "key string, label int, bag array<tinyint>, x binary")
    # the rows are small and the work for each is not: two parts for each core, or three and more
    parts, cores = out.rdd.getNumPartitions(), train.sparkSession.sparkContext.defaultParallelism
    return cut_lineage(out.repartition(2 * cores, "key") if parts < 3 * cores else out)


def _bytes(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows x ``width`` of a column of equally long binary values, read in place."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(memoryview(column.buffers()[2])[ends[0]:ends[-1]], dtype=kind).reshape(-1, width)


def _matrices(b: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, bag counts, bins) of a batch of binned rows."""
    x = _bytes(b.column("x"), np.uint8, features)
    bag = b.column("bag").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    return b.column("label").to_numpy(zero_copy_only=False).astype(np.int64), bag, x


CELL_COLUMNS = "tree int, slot int, j int, bin int, n bigint, a bigint, b bigint"


def _margins(b: pa.RecordBatch, fits: int) -> np.ndarray:
    """Rows x fits: the margins stored with the rows, 0 before the first time."""
    if "margin" not in b.schema.names:
        return np.zeros((b.num_rows, fits))
    return _bytes(b.column("margin"), np.float64, fits)


def task_cells(rows: DataFrame, model: Ensemble, open_nodes: list[int], subsets: np.ndarray, pos_weight: float = 1.0,
               rounds: int | None = None, needed: tuple[int, ...] = (1,)) -> DataFrame:
    """Each task's sums of one level: (tree, slot, j, bin, n, a, b) for open node ``slot``, its j-th feature and bin.

    n: rows in the bag; a, b: of a forest the bag's rows of label 1 and its rows; of boosted trees G and H in units of 2^-24.
    ``subsets`` (open nodes x features drawn, -1 behind fewer ones) says which features a node looks at. Of several boosted
    ensembles, the i-th has trees from i * ``rounds`` on, and takes a row whose bag count is at least ``needed[i]``.
    """
    a, k, m = model.arrays(), len(model.features), subsets.shape[1]
    trees = np.array([model.tree[i] for i in open_nodes])
    slot_of = np.full(len(model.tree), -1)
    slot_of[open_nodes] = np.arange(len(open_nodes))
    root_of = {model.tree[r]: r for r in model.roots}
    spans = {int(t): (int(np.flatnonzero(trees == t)[0]), int(np.flatnonzero(trees == t)[-1]) + 1) for t in np.unique(trees)}
    boosted, base, none = model.kind == "boosted", model.base, subsets < 0
    turns = rounds or max(root_of) + 1
    finished: dict[int, list[int]] = {t // turns: [] for t in spans} if boosted else {}
    for r in model.roots:
        if model.tree[r] not in spans and model.tree[r] // turns in finished:
            finished[model.tree[r] // turns].append(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(open_nodes) * m * BINS), dtype=np.int64)
        cells = sums.reshape(3, len(open_nodes), m, BINS)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, bag, x = _matrices(batch, k)
            stored = _margins(batch, len(needed)) if boosted else None
            for t, (low, high) in spans.items():
                fit, turn = divmod(t, turns)
                slot = slot_of[leaves(a, np.array([root_of[t]]), x, "cut")[:, 0]]
                r = np.flatnonzero((slot >= 0) & (bag[:, turn] >= needed[fit]))
                if not len(r):
                    continue
                s, w = slot[r], bag[r, turn].astype(np.int64)
                if boosted:  # an ensemble has one tree here
                    p = 1 / (1 + np.exp(-(stored[:, fit] + outputs(a | {"roots": np.array(finished[fit], dtype=np.int32)}, base, x, "cut"))))
                    v = np.where(y == 1, pos_weight, 1.0)
                    first, second = (np.rint(u * v * UNIT).astype(np.int64) for u in (p - y, p * (1 - p)))
                one, two = (first[r], second[r]) if boosted else (w * y[r], w)
                alike, own, size = (subsets[low:high] == subsets[low]).all(), x[r], (high - low) * BINS
                for j in range(m):  # one feature at a time: its cells stay in the processor's cache
                    code = (s - low) * BINS + (own[:, subsets[low, j]] if alike else x[r, subsets[s, j]])
                    for i, v in enumerate((None, one, two)):
                        cells[i, low:high, j] += np.bincount(code, v, size).astype(np.int64).reshape(-1, BINS)
        cells[:, none] = 0
        some = np.flatnonzero(sums[0])
        slot, rest = np.divmod(some, m * BINS)
        columns = [trees[slot].astype(np.int32), slot.astype(np.int32), (rest // BINS).astype(np.int32), (rest % BINS).astype(np.int32),
                   *sums[:, some]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "slot", "j", "bin", "n", "a", "b"])

    return rows.mapInArrow(run, CELL_COLUMNS)


def level_cells(cells: DataFrame, most: int) -> DataFrame:
    """The tasks' cells summed; ``most`` is how many there can be."""
    # tasks have added up their own rows, so one exchange serves this sum and the windows over a node's feature
    cells = cells.repartition(math.ceil(most / PER_TASK), "slot", "j")
    return cells.groupBy("tree", "slot", "j", "bin").agg(*map(F.expr, ("sum(n) n", "sum(a) a", "sum(b) b")))


def _score(kind: str, a: str, b: str) -> str:
    """SQL of a node's share in the gain: W (sum of squared class shares), or G^2 / (H + lambda)."""
    if kind == "forest":
        one, none = f"(w1 * {a})", f"(w0 * ({b} - {a}))"
        return f"(({one} * {one} + {none} * {none}) / nullif({one} + {none}, 0D))"
    g, h = f"(greatest(abs({a} / {UNIT}D) - alpha, 0D))", f"({b} / {UNIT}D + lam)"
    return f"({g} * {g} / nullif({h}, 0D))"


def best_splits(cells: DataFrame, kind: str, terms: dict[int, dict[str, float]]) -> DataFrame:
    """One row per node: its sums (n, a, b) and the best split (gain, j, bin, and the left sums), null if none is allowed.

    ``terms`` of each tree: the least a side must have, with the class weights w0 and w1 or with alpha and lam. Equal gains go
    to the first feature drawn and the lowest cut.
    """
    # SQL text: built in a few calls, once for every level; trees of the same terms share an entry
    kinds = sorted({tuple(v.items()) for v in terms.values()})
    structs = ", ".join("named_struct(" + ", ".join(f"'{k}', {float(v)!r}D" for k, v in one) + ")" for one in kinds)
    number = ", ".join(f"{t}, {kinds.index(tuple(v.items()))}" for t, v in terms.items())
    which = "0" if len(kinds) == 1 else f"map({number})[tree]"
    cells = cells.selectExpr("*", f"array({structs})[{which}] w").selectExpr("slot", "j", "bin", "n", "a", "b", "w.*")
    sums = [f"sum({x}) over (partition by slot, j{order}) {name}{x}" for x in "nab" for name, order in (("l", " order by bin"), ("t", ""))]
    side = "n" if kind == "forest" else "b"
    allowed = f"l{side} >= least and t{side} - l{side} >= least"
    gain = f"{_score(kind, 'la', 'lb')} + {_score(kind, '(ta - la)', '(tb - lb)')} - {_score(kind, 'ta', 'tb')}"
    found = cells.selectExpr("*", *sums).selectExpr("*", f"case when ln < tn and {allowed} then round({gain}, 9) end gain")
    best = "max_by(struct(gain, j, bin, ln, la, lb), case when gain is not null then struct(gain, -j, -bin) end) best"
    totals = found.groupBy("slot").agg(*map(F.expr, ("max(tn) n", "first(ta) a", "first(tb) b", best)))
    return totals.selectExpr("slot", "n", "a", "b", "best.*")


def best_of_few(cells: pa.Table, slots: int, m: int, kind: str, terms: dict[int, dict[str, float]]) -> Iterator[dict]:
    """What ``best_splits`` returns, in numpy: for few cells, where a query takes longer than its work."""
    tree, slot, j, place, *sums = (c.to_numpy().astype(np.int64) for c in cells.columns)
    tree_of = np.full(slots, min(terms), dtype=np.int64)
    tree_of[slot] = tree
    total = np.zeros((3, slots, m, BINS), dtype=np.int64)
    for i, v in enumerate(sums):
        np.add.at(total[i], (slot, j, place), v)
    of_slot = {k: np.array([float(terms[int(t)][k]) for t in tree_of]) for k in next(iter(terms.values()))}
    gain, f, cut, sides, whole = dense_best(total, kind, of_slot)
    for s in np.unique(slot):
        found = gain[s] > -np.inf
        yield {"slot": int(s), "n": int(whole[0, s]), "a": int(whole[1, s]), "b": int(whole[2, s]), "gain": float(gain[s]) if found else None,
               "j": int(f[s]), "bin": int(cut[s]), "ln": int(sides[0, s]), "la": int(sides[1, s]), "lb": int(sides[2, s])}


def dense_best(total: np.ndarray, kind: str, terms: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The best split of each slot from its cells (3 x slots x features x bins): gain (-inf: none), feature, bin, the sums of the
    left side and of the slot (3 x slots)."""
    slots, m = total.shape[1:3]
    low = total.cumsum(axis=3)
    whole = low[..., -1:]

    def term(name):
        return terms[name].reshape(-1, 1, 1)

    if kind == "forest":
        w0, w1, side = term("w0"), term("w1"), 0

        def score(a, b):
            one, none = w1 * a, w0 * (b - a)
            return np.divide(one * one + none * none, one + none, out=np.full(one.shape, np.nan), where=one + none != 0)
    else:
        alpha, lam, side = term("alpha"), term("lam"), 2

        def score(a, b):
            g, h = np.maximum(np.abs(a / UNIT) - alpha, 0), b / UNIT + lam
            return np.divide(g * g, h, out=np.full(g.shape, np.nan), where=h != 0)

    least = term("least")
    allowed = (low[side] >= least) & (whole[side] - low[side] >= least)
    gain = np.round(score(low[1], low[2]) + score(whole[1] - low[1], whole[2] - low[2]) - score(whole[1], whole[2]), 9)
    # a cut is at a bin with rows, as the query sees no others
    gain[~allowed | (low[0] >= whole[0]) | (total[0] == 0) | np.isnan(gain)] = -np.inf
    every = np.arange(slots)
    f, cut = np.divmod(gain.reshape(slots, -1).argmax(axis=1), BINS)  # the first of equal ones
    return gain[every, f, cut], f, cut, low[:, every, f, cut], whole[:, :, 0, 0]


def _sent_rows(rows: DataFrame, model: Ensemble, nodes: list[int]) -> DataFrame:
    """(slot, part): the rows in the bag at each of ``nodes``, some at a time; a row is its bins, its label and its bag count."""
    a, k = model.arrays(), len(model.features)
    slot_of = np.full(len(model.tree), -1)
    slot_of[nodes] = np.arange(len(nodes))
    roots = {model.tree[r]: r for r in model.roots}
    trees = sorted({model.tree[n] for n in nodes})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(slots, parts):
            return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(parts, pa.binary())], names=["slot", "part"])

        for b in batches:
            if not b.num_rows:
                continue
            y, bag, x = _matrices(b, k)
            slots, parts, size = [], [], 0
            for t in trees:
                slot = slot_of[leaves(a, np.array([roots[t]]), x, "cut")[:, 0]]
                r = np.flatnonzero((slot >= 0) & (bag[:, t] > 0))
                r = r[np.argsort(slot[r], kind="stable")]
                bound = np.flatnonzero(np.r_[True, np.diff(slot[r]) != 0, True]) if len(r) else np.zeros(1, dtype=int)
                held = np.c_[x[r], y[r].astype(np.uint8), bag[r, t].astype(np.uint8)]
                for low, high in zip(bound[:-1], bound[1:]):
                    slots.append(int(slot[r[low]]))
                    parts.append(held[low:high].tobytes())
                size += held.size
                if size > SENT:
                    yield batch_of(slots, parts)
                    slots, parts, size = [], [], 0
            if slots:
                yield batch_of(slots, parts)

    return rows.mapInArrow(run, "slot int, part binary")


#: what a subtree's nodes are sent as
NODE = np.dtype([("feature", "i2"), ("cut", "i2"), ("left", "i4"), ("right", "i4"), ("a", "i8"), ("b", "i8"), ("gain", "f8")])


def grown(x: np.ndarray, y: np.ndarray, row: np.ndarray, root: np.ndarray, w: np.ndarray, tree: np.ndarray, path: np.ndarray,
          depth: int, most: int, draw: Callable[[np.ndarray, np.ndarray], np.ndarray],
          worth: Callable[[np.ndarray, np.ndarray], np.ndarray], terms: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The subtrees of a forest below several roots, level by level: what ``_grow`` grows from each root.

    ``row``, ``root``, ``w``: which row of ``x`` stands at which root, and how often it is in the bag; 0: it only walks down.
    ``tree``, ``path`` and ``terms`` are those of the roots. Returns the nodes, the roots first, each node's root and depth, and
    the node that each row ends at. The cells of a level are sorted, not laid out: deep nodes have few rows and leave most empty.
    """
    roots, held = len(tree), w > 0
    sums = [np.bincount(root[held], None if v is None else v[held], roots).astype(np.int64) for v in (None, w * y[row], w)]
    blocks, of_root, depths, found, leaf = [sums], [np.arange(roots)], [np.full(roots, depth)], [], root.astype(np.int64)
    bits = int(w.max(initial=1)).bit_length()
    # open nodes: number, root, path and sums; rows that stand at them, and at which
    node, own, way, size = np.arange(roots), np.arange(roots), np.asarray(path), roots
    at, slot, row, w = np.arange(len(row)), root, row, w
    while len(node) and depth < most:
        n, a, b = sums
        subsets = draw(tree[own], way)
        m, w0, w1, side = subsets.shape[1], terms["w0"][own], terms["w1"][own], terms["least"][own]
        kept = np.flatnonzero(w > 0)
        s, r = slot[kept], row[kept]
        cells = (s[:, None] * m + np.arange(m)) * BINS + x[r[:, None], subsets[s]]
        cells = ((cells << bits + 1) + (w[kept] * 2 + y[r])[:, None]).ravel()
        if (len(node) * m * BINS) << bits + 1 < 1 << 31:
            cells = cells.astype(np.int32)
        cells.sort()
        code, weight = cells >> bits + 1, (cells >> 1) & (1 << bits) - 1
        last = np.flatnonzero(np.r_[code[1:] != code[:-1], True]) if len(code) else np.zeros(0, dtype=np.int64)
        code, low = code[last].astype(np.int64), [last + 1, np.cumsum(weight * (cells & 1), dtype=np.int64)[last],
                                                  np.cumsum(weight, dtype=np.int64)[last]]
        group = code // BINS
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(code) else last
        lengths = np.diff(np.r_[first, len(code)])
        ln, la, lb = (v - np.repeat(np.r_[0, v[first[1:] - 1]][:len(first)], lengths) for v in low)
        of = group // m
        fine = np.flatnonzero((ln < n[of]) & (ln >= side[of]) & (n[of] - ln >= side[of]))
        code, of, ln, la, lb = code[fine], of[fine], ln[fine], la[fine], lb[fine]

        def score(a, b, w0, w1):
            one, none = w1 * a, w0 * (b - a)
            return np.divide(one * one + none * none, one + none, out=np.full(one.shape, np.nan), where=one + none != 0)

        p0, p1 = w0[of], w1[of]
        gain = np.round(score(la, lb, p0, p1) + score(a[of] - la, b[of] - lb, p0, p1) - score(a, b, w0, w1)[of], 9)
        gain[np.isnan(gain)] = -np.inf
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
        top = np.maximum.reduceat(gain, starts) if len(of) else gain
        equal = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[starts, len(of)])))
        best = equal[np.r_[True, of[equal][1:] != of[equal][:-1]]] if len(of) else equal  # the first of equal ones
        best = best[(gain[best] > -np.inf) & worth(gain[best], tree[own[of[best]]])]
        split, k = of[best], len(best)
        feature, cut, start = np.full(len(node), -1), np.full(len(node), -1), np.full(len(node), -1)
        feature[split], cut[split], start[split] = subsets[split, code[best] // BINS % m], code[best] % BINS, size + 2 * np.arange(k)
        found.append((node[split], feature[split], cut[split], start[split], gain[best]))
        # rows go down, and those at nodes that stay open go on
        goes = np.flatnonzero(feature[slot] >= 0)
        at, slot, row, w = at[goes], slot[goes], row[goes], w[goes]
        child = start[slot] + (x[row, feature[slot]] > cut[slot])
        leaf[at] = child
        sums = [np.c_[v[best], t[split] - v[best]].ravel() for v, t in zip((ln, la, lb), (n, a, b))]
        blocks.append(sums)
        of_root.append(np.repeat(own[split], 2))
        depth += 1
        depths.append(np.full(2 * k, depth))
        stays = np.flatnonzero((sums[0] > 1) & (sums[1] > 0) & (sums[1] < sums[2])) if depth < most else np.zeros(0, dtype=np.int64)
        place = np.full(2 * k, -1)
        place[stays] = np.arange(len(stays))
        way = (2 * np.repeat(way[split], 2) + np.tile([0, 1], k))[stays]
        node, own, sums = size + stays, of_root[-1][stays], [v[stays] for v in sums]
        slot = place[child - size]
        on = np.flatnonzero(slot >= 0)
        at, slot, row, w, size = at[on], slot[on], row[on], w[on], size + 2 * k
    out = np.zeros(size, dtype=NODE)
    for name in ("feature", "cut", "left", "right"):
        out[name] = -1
    out["a"], out["b"] = (np.concatenate([block[i] for block in blocks]) for i in (1, 2))
    for of, feature, cut, start, gain in found:
        out["feature"][of], out["cut"][of], out["left"][of], out["right"][of], out["gain"][of] = feature, cut, start, start + 1, gain
    return out, np.concatenate(of_root), np.concatenate(depths), leaf


def grow_below(rows: DataFrame, model: Ensemble, local: list[tuple[int, int, int, int]], draw, most: int,
               worth: Callable[[np.ndarray, np.ndarray], np.ndarray], terms: Callable[[int], dict[str, float]]) -> dict[int, np.ndarray]:
    """The subtrees of a forest below ``local`` (node, tree, path, depth), each grown by one task from its rows; by node."""
    k, spark = len(model.features), rows.sparkSession
    at = [(t, path, depth, terms(t)) for _, t, path, depth in local]

    def kernel(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        t, path, depth, own = at[slot]
        held = np.frombuffer(b"".join(table.column("part").to_pylist()), dtype=np.uint8).reshape(-1, k + 2)
        x, y, w = held[:, :k], held[:, k].astype(np.int64), held[:, k + 1].astype(np.int64)
        every, own = np.zeros(len(x), dtype=np.int64), {name: np.array([v]) for name, v in own.items()}
        found = grown(x, y, np.arange(len(x)), every, w, np.array([t]), np.array([path]), depth, most, draw, worth, own)[0]
        return pa.table({"slot": pa.array([slot], pa.int32()), "nodes": pa.array([zlib.compress(found.tobytes(), 1)], pa.binary())})

    # a given number of partitions: subtrees are small in bytes and long in time, and must not be coalesced into few tasks
    tasks = max(1, min(len(local), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sent = _sent_rows(rows, model, [n for n, *_ in local]).repartition(tasks, "slot")
    found = sent.groupBy("slot").applyInArrow(kernel, "slot int, nodes binary").collect()  # the model's own nodes, packed
    return {local[r["slot"]][0]: np.frombuffer(zlib.decompress(r["nodes"]), dtype=NODE) for r in found}


def boosted_draw(seed: int, turn: int, features: int, m: int) -> np.ndarray:
    """The features that a boosted tree looks at."""
    return np.sort(np.random.default_rng([seed, turn]).permutation(features)[:m])


def _drawn(strategy: str, features: int) -> int:
    if strategy in ("all", "1.0"):
        return features
    if strategy == "sqrt":
        return max(1, int(math.sqrt(features)))
    if strategy == "log2":
        return max(1, int(math.log2(features)))
    return max(1, int(float(strategy) * features))


def _grow(rows: DataFrame, edges: list[np.ndarray], model: Ensemble, trees: list[int], depth_of: Callable[[int], int], draw, finish,
          price, terms: Callable[[int], dict[str, float]], few: Callable[[int, int], bool] | None = None,
          draws: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, **sums) -> list[tuple[int, int, int, int]]:
    """Grow ``trees`` of the model to their depth, level by level. Nodes for which ``few`` (n, depth) holds are not taken further but
    returned as (node, tree, path, depth).

    draw(tree, path): the features a node looks at, draws(trees, paths): those of many nodes; finish(node, tree, a, b): sets a node's value; price(gain, tree): whether
    a split is worth it; terms(tree): see ``best_splits``; ``sums``: see ``task_cells``.
    """
    todo, left_out, parts = [], [], rows.rdd.getNumPartitions()
    for t in trees:
        model.roots.append(model.add(t))
        todo.append((model.roots[-1], t, 1, 0))  # node, tree, path from the root as a heap number, depth
    while todo:
        first = draw(todo[0][1], todo[0][2])
        at_once = max(1, CELLS // (len(first) * BINS))
        now, todo, later = todo[:at_once], [], todo[at_once:]
        at = [t for _, t, *_ in now], [path for _, _, path, _ in now]
        subsets = np.array([draw(t, path) for t, path in zip(*at)]) if draws is None else draws(*map(np.array, at))
        nodes = [n for n, *_ in now]
        cells, most = task_cells(rows, model, nodes, subsets, **sums), subsets.size * BINS * parts
        of_tree = {t: terms(t) for _, t, *_ in now}
        if most > PER_TASK // 8:
            cells = level_cells(cells, most)
        found = (best_of_few(cells.toArrow(), *subsets.shape, model.kind, of_tree) if min(most, subsets.size * BINS) <= PER_TASK // 8
                 else best_splits(cells, model.kind, of_tree).collect())
        for r in found:  # one row for each open node
            node, t, path, depth = now[r["slot"]]
            finish(node, t, r["a"], r["b"])
            if r["gain"] is None or depth >= depth_of(t) or not price(r["gain"], t):
                continue
            f = int(subsets[r["slot"], r["j"]])
            model.feature[node], model.cut[node], model.threshold[node] = f, r["bin"], float(edges[f][r["bin"]])
            model.gain[node] = r["gain"]
            sides = ((r["ln"], r["la"], r["lb"]), (r["n"] - r["ln"], r["a"] - r["la"], r["b"] - r["lb"]))
            children = [model.add(t) for _ in sides]
            model.left[node], model.right[node] = children
            for side, (child, (n, a, b)) in enumerate(zip(children, sides)):
                finish(child, t, a, b)
                pure = model.kind == "forest" and (a == 0 or a == b)
                if depth + 1 < depth_of(t) and n > 1 and not pure:
                    (left_out if few and few(n, depth + 1) else todo).append((child, t, 2 * path + side, depth + 1))
        todo = sorted(later + todo, key=lambda x: (x[1], x[0]))
    return left_out


def bag_classes(rows: DataFrame) -> DataFrame:
    """(tree, label, n): rows of each label in each tree's bag, copies counted."""
    return (rows.select("label", F.posexplode("bag").alias("tree", "w")).groupBy("tree", "label")
            .agg(F.sum(F.col("w").cast("bigint")).alias("n")))


def bag_weights(none: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w0, w1, total) of bags with so many rows of each label: balanced weights, which add up to the bag's size."""
    size, present = none + ones, (none > 0).astype(np.int64) + (ones > 0)
    w0, w1 = (np.divide(size, present * n, out=np.zeros(len(size)), where=n > 0) for n in (none, ones))
    return w0, w1, np.maximum(size, 1)


def fit_forest(train: DataFrame, features: list[str], params: dict, key: str, label: str = "label", seed: int = 42) -> tuple[Ensemble, DataFrame]:
    """A forest of probabilities, and the binned rows with their bags, which ``out_of_bag`` reads."""
    p = params
    edges = bin_edges(train, features)
    rows = binned(train, edges, key, label, bags(key, int(p["numTrees"]), seed))
    counts: dict[int, dict[int, int]] = {}
    for r in bag_classes(rows).collect():  # two rows a tree
        counts.setdefault(r["tree"], {})[r["label"]] = r["n"]
    n = [np.array([counts.get(t, {}).get(c, 0) for t in range(int(p["numTrees"]))], dtype=np.int64) for c in (0, 1)]
    class0, class1, total = bag_weights(*n)
    weights = dict(enumerate(zip(class0.tolist(), class1.tolist())))
    model = Ensemble("forest", features, params=dict(p), total=total)
    m, least, trees = _drawn(str(p["featureSubsetStrategy"]), len(features)), float(p["minInfoGain"]), len(weights)

    def draws(tree: np.ndarray, path: np.ndarray) -> np.ndarray:
        return permutations(seed, tree, path, len(features), m)

    def draw(tree: int, path: int) -> np.ndarray:
        return draws(np.array([tree]), np.array([path]))[0]

    def finish(node: int, tree: int, a: int, b: int) -> None:
        w0, w1 = weights[tree]
        model.cover[node] = w1 * a + w0 * (b - a)
        model.value[node] = w1 * a / model.cover[node] / trees if model.cover[node] else 0.0

    def worth(gain, tree):
        return (gain > 1e-9) & (gain / total[tree] >= least)

    def terms(tree: int) -> dict[str, float]:
        return {"w0": weights[tree][0], "w1": weights[tree][1], "least": float(p["minInstancesPerNode"])}

    cuts, depth = list(edges.values()), int(p["maxDepth"])
    local = _grow(rows, cuts, model, list(weights), lambda t: depth, draw, finish, worth, terms,
                  lambda n, at: n <= LOCAL and depth - at >= LEVELS, draws)
    if local:
        found, below, tree_of = grow_below(rows, model, local, draws, depth, worth, terms), {}, {n: t for n, t, *_ in local}
        for node, v in found.items():
            w0, w1 = weights[tree_of[node]]
            a, b, inner = v["a"], v["b"], v["feature"] >= 0
            cover = w1 * a + w0 * (b - a)
            threshold = np.zeros(len(v))
            threshold[inner] = [cuts[f][c] for f, c in zip(v["feature"][inner], v["cut"][inner])]
            below[node] = {"feature": v["feature"], "cut": v["cut"], "left": v["left"], "right": v["right"], "threshold": threshold,
                           "cover": cover, "value": np.divide(w1 * a, cover, out=np.zeros(len(v)), where=cover != 0) / trees,
                           "gain": v["gain"]}
        model.hang_in(below)
    return model, rows


def out_of_bag(model: Ensemble, rows: DataFrame) -> DataFrame:
    """(key, label, trees, probability): each training row scored by the trees that have not seen it; null if there are none."""
    a, k, trees = model.arrays(), len(model.features), len(model.roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y, bag, x = _matrices(b, k)
            total, n = np.zeros(len(x)), np.zeros(len(x), dtype=np.int64)
            for i in range(0, trees, 64):
                out = bag[:, i:i + 64] == 0
                total += (a["value"][leaves(a, a["roots"][i:i + 64], x, "cut")] * out).sum(axis=1)
                n += out.sum(axis=1)
            share = np.divide(total * trees, n, out=np.zeros(len(x)), where=n > 0)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(y.astype(np.int32)), pa.array(n),
                                              pa.array(share, mask=n == 0)], names=["key", "label", "trees", "probability"])

    return rows.mapInArrow(run, "key string, label int, trees bigint, probability double")


def store_margins(rows: DataFrame, part: Ensemble, rounds: int, fits: int) -> DataFrame:
    """The rows with the trees of ``part`` added to each ensemble's margin."""
    a, k = part.arrays(), len(part.features)
    fit_of = np.array([part.tree[r] // rounds for r in part.roots])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, _, x = _matrices(b, k)
            margins = _margins(b, fits).copy()
            for f in range(fits):
                margins[:, f] += outputs(a | {"roots": a["roots"][fit_of == f]}, 0.0, x, "cut")
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("key", "label", "bag", "x")),
                                              pa.array([m.tobytes() for m in margins], pa.binary())], names=["key", "label", "bag", "x", "margin"])

    return cut_lineage(rows.mapInArrow(run, "key string, label int, bag array<tinyint>, x binary, margin binary"))


def fit_boosted_together(train: DataFrame, features: list[str], maps: list[dict], key: str, label: str = "label",
                         pos_weight: float = 1.0, seed: int = 42) -> list[Ensemble]:
    """One ensemble of boosted trees for each parameter map, grown side by side on the same binned rows.

    Each is the ensemble that the map gives by itself. The number of jobs is that of the longest and deepest one.
    """
    edges = bin_edges(train, features)
    cuts = list(edges.values())
    rounds = max(int(p["maxIter"]) for p in maps)
    shares = sorted({float(p["subsamplingRate"]) for p in maps})
    needed = tuple(len(shares) - shares.index(float(p["subsamplingRate"])) for p in maps)
    rows = binned(train, edges, key, label, bags(key, rounds, seed, shares))
    parts = math.ceil(rows.count() * len(maps) / ROWS_PER_TASK)
    if parts < rows.rdd.getNumPartitions():
        rows = rows.coalesce(max(1, parts))
    out = [Ensemble("boosted", features, params=dict(p)) for p in maps]
    drawn = [_drawn(str(p["featureSubsetStrategy"]), len(features)) for p in maps]

    def draw(tree: int, path: int) -> np.ndarray:
        fit, turn = divmod(tree, rounds)
        return np.pad(boosted_draw(seed, turn, len(features), drawn[fit]), (0, max(drawn) - drawn[fit]), constant_values=-1)

    def terms(tree: int) -> dict[str, float]:
        p = maps[tree // rounds]
        return {"alpha": float(p["regAlpha"]), "lam": float(p["regLambda"]), "least": float(p["minChildWeight"]) * UNIT}

    for start in range(0, rounds, STORED):
        part = Ensemble("boosted", features)

        def finish(node: int, tree: int, a: int, b: int) -> None:
            p, g, h = maps[tree // rounds], a / UNIT, b / UNIT
            soft, lam = max(abs(g) - float(p["regAlpha"]), 0.0), float(p["regLambda"])
            part.cover[node] = h
            part.value[node] = -float(p["stepSize"]) * math.copysign(soft, g) / (h + lam) if h + lam > 0 else 0.0

        for turn in range(start, min(start + STORED, rounds)):
            trees = [f * rounds + turn for f, p in enumerate(maps) if turn < int(p["maxIter"])]
            _grow(rows, cuts, part, trees, lambda t: int(maps[t // rounds]["maxDepth"]), draw, finish,
                  lambda gain, t: gain > max(float(maps[t // rounds]["minInfoGain"]), 1e-9), terms,
                  pos_weight=pos_weight, rounds=rounds, needed=needed)
        for f, model in enumerate(out):
            model.extend(part, {f * rounds + t: t for t in range(start, start + STORED) if t < rounds})
        if start + STORED < rounds:
            rows = store_margins(rows, part, rounds, len(maps))
    return out


def fit_boosted(train: DataFrame, features: list[str], params: dict, key: str, label: str = "label", pos_weight: float = 1.0,
                seed: int = 42) -> Ensemble:
    """Boosted trees; the output is the margin (log odds)."""
    return fit_boosted_together(train, features, [params], key, label, pos_weight, seed)[0]
