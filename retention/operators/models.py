"""Spark ML models: fit, score, evaluate, search, refit, persist.

Pipelines (one per model family, mirroring the reference's three pipelines):

* logistic regression: median imputation -> population z-scores -> [SMOTE on the
  training rows only] -> ``LogisticRegression`` (standardization off: inputs are scaled)
* random forest: imputation -> ``grow.fit_forest``, class weights balanced within each tree's bag, out-of-bag scores
* boosted trees: imputation -> ``grow.fit_boosted``, second order, positive weight neg/pos (truncated)

Imputation and scaling are Column projections with fitted literals. The logistic classifier is a Spark ML stage, whose
probabilities come out of one ``transform`` as ``vector_to_array(probability)[1]`` (no second pass, T18). Trees are
scored in Arrow batches.
Metrics reuse the SQL-checked operators of ``metrics``.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math
import random
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from . import encode as EN
from . import features as FE
from . import grow as GR
from . import metrics as ME
from . import search as SE
from . import split as SP

SEED = 42

# FIXED VALUES: parameter spaces and iteration counts of the randomized search, in Spark's names. Parameters without
# an effect here (solver, min_samples_split) are left out, so that two maps are two fits.
PARAM_SPACE = {
    "logistic_regression": {
        "C": [0.1, 0.5, 1, 2, 5, 10],
        "penalty": ["l1", "l2"],
        "smote_ratio": [0.5, 0.75, 1.0],
    },
    "random_forest": {
        "numTrees": [300, 400, 500],
        "maxDepth": [15, 20, 25, 30],             # unlimited depth: 30
        "minInstancesPerNode": [1, 2, 3, 4, 5],
        "featureSubsetStrategy": ["sqrt", "log2", "0.25", "0.33"],
        "minInfoGain": [0.0, 0.001, 0.01],
    },
    "xgboost": {
        "maxIter": [100, 200, 300],
        "maxDepth": [3, 4, 5, 6],
        "stepSize": [0.01, 0.05, 0.1],
        "subsamplingRate": [0.8, 0.9, 1.0],
        "featureSubsetStrategy": ["0.8", "0.9", "1.0"],
        "minInfoGain": [0, 0.1, 0.2],             # gamma
        "regAlpha": [0, 0.1, 1],
        "regLambda": [0.5, 1, 2],
    },
}
SEARCH_ITERATIONS = {"logistic_regression": 30, "random_forest": 75, "xgboost": 50}

# What a fit takes that is given no searched parameters; training_flow() passes the best ones it finds.
DEFAULT_PARAMS = {
    "logistic_regression": {"C": 1.0, "penalty": "l2", "smote_ratio": 1.0, "maxIter": 5000},
    "random_forest": {"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 1,
                      "featureSubsetStrategy": "sqrt", "minInfoGain": 0.0},
    "xgboost": {"maxIter": 50, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 1.0,
                "featureSubsetStrategy": "1.0", "minInfoGain": 0.0, "regAlpha": 0.0, "regLambda": 1.0, "minChildWeight": 1.0},
}


def param_grid_size(model: str) -> int:
    n = 1
    for v in PARAM_SPACE[model].values():
        n *= len(v)
    return n


def sample_params(model: str, n_iter: int, seed: int = SEED) -> list[dict]:
    """Distinct parameter maps drawn without replacement from the grid (M5)."""
    space = PARAM_SPACE[model]
    keys = list(space)
    total = param_grid_size(model)
    rng = random.Random(seed)
    picks = rng.sample(range(total), min(n_iter, total))
    out = []
    for idx in picks:
        combo, rest = {}, idx
        for k in keys:
            vals = space[k]
            combo[k] = vals[rest % len(vals)]
            rest //= len(vals)
        out.append(combo)
    return out


@dataclass
class FittedModel:
    name: str
    pipeline: PipelineModel
    medians: dict[str, float]
    scaling: dict[str, tuple[float, float]] = field(default_factory=dict)
    params: dict = field(default_factory=dict)

    def prepare(self, df: DataFrame) -> DataFrame:
        out = FE.impute(df, self.medians, K.FEATURES)
        if self.scaling:
            out = out.withColumns({f: EN.standardize_expr(f, m, s) for f, (m, s) in self.scaling.items()})
        return out

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Scored rows: keep-columns + model_used, churn_prediction, churn_probability."""
        scored = self.pipeline.transform(self.prepare(df))
        p = F.round(vector_to_array("probability")[1], 9)
        return scored.select(*(keep or []), F.lit(self.name).alias("model_used"),
                             F.col("prediction").cast("int").alias("churn_prediction"), p.alias("churn_probability"))

    def save(self, path: str) -> None:
        """Pipeline via Spark ML persistence, fitted literals as one JSON line."""
        self.pipeline.write().overwrite().save(f"{path}/{self.name}/pipeline")
        meta = {"name": self.name, "medians": self.medians, "scaling": self.scaling, "params": self.params}
        ss = SparkSession.getActiveSession()
        ss.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            f"{path}/{self.name}/state")

    @classmethod
    def load(cls, path: str, name: str) -> "FittedModel":
        ss = SparkSession.getActiveSession()
        meta = json.loads(ss.read.text(f"{path}/{name}/state").first()[0])
        scaling = {k: tuple(v) for k, v in meta["scaling"].items()}
        return cls(meta["name"], PipelineModel.load(f"{path}/{name}/pipeline"), meta["medians"], scaling,
                   meta["params"])


@dataclass
class FittedTrees:
    """A grown ensemble. ``bags``: the forest's binned training rows with their bags, for the out-of-bag score; not saved."""
    name: str
    ensemble: GR.Ensemble
    medians: dict[str, float]
    params: dict = field(default_factory=dict)
    bags: DataFrame | None = None

    def prepare(self, df: DataFrame) -> DataFrame:
        return FE.impute(df, self.medians, K.FEATURES)

    def output(self) -> Column:
        """The margin of boosted trees, the share of label 1 of a forest, on prepared rows."""
        arrays, base = self.ensemble.arrays(), self.ensemble.base

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(GR.outputs(arrays, base, np.stack(x.to_list())) if len(x) else np.zeros(0))

        return run(F.array(*[F.col(f).cast("double") for f in self.ensemble.features]))

    def probability(self) -> Column:
        out = self.output()
        return out if self.ensemble.kind == "forest" else F.lit(1.0) / (F.lit(1.0) + F.exp(-out))

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        scored = self.prepare(df).select(*(keep or []), F.round(self.probability(), 9).alias("churn_probability"))
        return scored.select(*(keep or []), F.lit(self.name).alias("model_used"),
                             (F.col("churn_probability") > 0.5).cast("int").alias("churn_prediction"), "churn_probability")

    def out_of_bag(self) -> DataFrame:
        """(customerID, label, trees, probability) of the training rows, each by the trees that have not seen it."""
        if self.bags is None:
            raise ValueError("out-of-bag scores need the fit's own rows")
        return GR.out_of_bag(self.ensemble, self.bags)

    def save(self, path: str) -> None:
        """Node table as parquet, fitted literals as one JSON line."""
        ss, e = SparkSession.getActiveSession(), self.ensemble
        e.table(ss).write.mode("overwrite").parquet(f"{path}/{self.name}/nodes")
        meta = {"name": self.name, "kind": e.kind, "features": e.features, "base": e.base, "medians": self.medians, "params": self.params}
        ss.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/{self.name}/state")

    @classmethod
    def load(cls, path: str, name: str) -> "FittedTrees":
        ss = SparkSession.getActiveSession()
        meta = json.loads(ss.read.text(f"{path}/{name}/state").first()[0])
        e = GR.Ensemble.from_rows(meta["kind"], meta["features"], meta["base"], ss.read.parquet(f"{path}/{name}/nodes").collect())
        return cls(meta["name"], e, meta["medians"], meta["params"])


def load(path: str, name: str) -> FittedModel | FittedTrees:
    return (FittedModel if name == "logistic_regression" else FittedTrees).load(path, name)


def _classifier(params: dict, rows: int) -> LogisticRegression:
    """``rows``: how many rows the fit reads. Spark averages the loss where C weighs its sum, so the penalty
    that belongs to C is 1 / (C * rows)."""
    c = float(params.get("C", 1.0))
    return LogisticRegression(featuresCol="features", labelCol="label", maxIter=int(params.get("maxIter", 5000)),
                              regParam=1.0 / (c * max(1, rows)), elasticNetParam=1.0 if params.get("penalty") == "l1" else 0.0,
                              standardization=False)


@dataclass
class FitInput:
    """Parameter-independent part of a fit: imputation medians, scaling, the prepared
    training rows and (logistic + SMOTE) the minority neighbour table. ``ready``: the oversampled rows as
    (label, features), for fits of one ratio, and how many they are."""
    medians: dict[str, float]
    scaling: dict[str, tuple[float, float]]
    base: DataFrame
    neighbours: DataFrame | None = None
    ready: tuple[DataFrame, int] | None = None


def prepare_fit(model: str, train: DataFrame, smote: bool = True) -> FitInput:
    medians = {r["column"]: r["value"] for r in FE.median_table(train, K.FEATURES).collect()}  # 28 rows
    base = FE.impute(train, medians, K.FEATURES)
    scaling, nn = {}, None
    if model == "logistic_regression":
        scaling = EN.fit_standardizer(base, K.FEATURES)
        base = base.withColumns({f: EN.standardize_expr(f, m, s) for f, (m, s) in scaling.items()})
        if smote:
            from .smote import minority_neighbours
            base, nn = minority_neighbours(base)
    return FitInput(medians, scaling, base, nn)


def fit_prepared(model: str, prep: FitInput, params: dict | None = None) -> FittedModel | FittedTrees:
    params = {**DEFAULT_PARAMS[model], **(params or {})}
    base = prep.base
    if model == "random_forest":
        ensemble, bags = GR.fit_forest(base, K.FEATURES, params, K.ID_COL, seed=SEED)
        return FittedTrees(model, ensemble, prep.medians, params, bags)
    if model == "xgboost":
        weight = SP.scale_pos_weight(base).first()["scale_pos_weight"]
        return FittedTrees(model, GR.fit_boosted(base, K.FEATURES, params, K.ID_COL, pos_weight=weight or 1.0, seed=SEED),
                           prep.medians, params)
    assembler = VectorAssembler(inputCols=K.FEATURES, outputCol="features", handleInvalid="error")
    if prep.ready is not None:
        rows, n = prep.ready
        return FittedModel(model, PipelineModel([assembler, _classifier(params, n).fit(rows)]), prep.medians, prep.scaling, params)
    if prep.neighbours is not None:
        from .smote import oversample
        base = oversample(base, ratio=float(params.get("smote_ratio", 1.0)), neighbours=prep.neighbours)
    # counted and read twice more by the fit: the synthetic rows are made once
    base = base.withColumns({f: F.col(f).cast("double") for f in K.FEATURES}).persist()
    try:
        pm = Pipeline(stages=[assembler, _classifier(params, base.count())]).fit(base)
    finally:
        base.unpersist()
    return FittedModel(model, pm, prep.medians, prep.scaling, params)


def _fit_logistic(prep: FitInput, maps: list[dict], parallelism: int = 4) -> list[FittedModel]:
    """Fits of several maps: the rows of a ratio are oversampled, assembled and kept once for all of its maps."""
    from .smote import oversample
    model, out = "logistic_regression", {}
    assembler = VectorAssembler(inputCols=K.FEATURES, outputCol="features", handleInvalid="error")
    ratio_of = [float(m.get("smote_ratio", 1.0)) if prep.neighbours is not None else None for m in maps]
    for ratio in dict.fromkeys(ratio_of):
        rows = prep.base if ratio is None else oversample(prep.base, ratio=ratio, neighbours=prep.neighbours)
        made = assembler.transform(rows.withColumns({f: F.col(f).cast("double") for f in K.FEATURES})).select("label", "features").persist()
        n = made.count()
        # an iteration is a job over these rows: on a small table starting a task takes longer than its work
        kept = made.coalesce(max(1, math.ceil(n / ROWS_PER_TASK))).persist()
        try:
            ready = replace(prep, ready=(kept, n))
            some = [i for i in range(len(maps)) if ratio_of[i] == ratio]
            with ThreadPoolExecutor(max_workers=parallelism) as ex:  # an iteration of one fit leaves most cores idle
                out |= dict(zip(some, ex.map(lambda i: fit_prepared(model, ready, maps[i]), some)))
        finally:
            kept.unpersist()
            made.unpersist()
    return [out[i] for i in range(len(maps))]


def fit_maps(model: str, prep: FitInput, maps: list[dict]) -> list[FittedModel | FittedTrees]:
    """One fitted model for each parameter map; logistic fits of a ratio share their rows, boosted trees grow side by side, a level of all of them is one job, and forests
    that draw alike (``search.alike``) are parts of one that is grown once."""
    if model == "random_forest":
        maps, out = [{**DEFAULT_PARAMS[model], **m} for m in maps], {}
        for some in SE.alike(maps, len(K.FEATURES)):
            whole, _ = GR.fit_forest(prep.base, K.FEATURES, SE.joined([maps[i] for i in some]), K.ID_COL, seed=SEED)
            out |= {i: FittedTrees(model, whole.cut_off(maps[i]), prep.medians, maps[i]) for i in some}
        return [out[i] for i in range(len(maps))]
    if model == "logistic_regression" and len(maps) > 1:
        return _fit_logistic(prep, maps)
    if model != "xgboost" or len(maps) < 2:
        return [fit_prepared(model, prep, m) for m in maps]
    maps = [{**DEFAULT_PARAMS[model], **m} for m in maps]
    weight = SP.scale_pos_weight(prep.base).first()["scale_pos_weight"]
    grown = GR.fit_boosted_together(prep.base, K.FEATURES, maps, K.ID_COL, pos_weight=weight or 1.0, seed=SEED)
    return [FittedTrees(model, e, prep.medians, m) for e, m in zip(grown, maps)]


def fit(model: str, train: DataFrame, params: dict | None = None, smote: bool = True) -> FittedModel | FittedTrees:
    """Fit one pipeline on encoded training rows (columns FEATURES + label)."""
    return fit_prepared(model, prepare_fit(model, train, smote), params)


def evaluate(fitted: list[FittedModel], df: DataFrame, fit_on: str = "train") -> DataFrame:
    """One transform per model over all rows, metrics per (model, split) (M6)."""
    scored = None
    for m in fitted:
        s = m.transform(df, keep=["label", "split"])
        scored = s if scored is None else scored.unionByName(s)
    return ME.metrics_long(scored, fit_on=fit_on)


#: rows that one task of a logistic iteration takes at least, in a search
ROWS_PER_TASK = 16384
#: fits whose scored rows are measured by one query: the buckets of their scores are broadcast
AT_ONCE = 25
LEDGER = "model string, param_id int, params string, fold int, side string, metric string, value double"


def _finished(spark: SparkSession, ledger: str | None, model: str) -> dict[tuple[str, int], list]:
    """Rows of the fits that the ledger holds, by (parameters as JSON, fold)."""
    done: dict[tuple[str, int], list] = {}
    if ledger:
        try:
            for r in spark.read.schema(LEDGER).parquet(f"{ledger}/{model}/*").collect():  # 8 rows a fit
                done.setdefault((r["params"], r["fold"]), []).append(tuple(r))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return done


def cross_validate(model: str, train: DataFrame, n_iter: int = 2, folds: int = 5, parallelism: int = 4,
                   seed: int = SEED, ledger: str | None = None, together: int = 10) -> DataFrame:
    """Randomized search: every (param map, fold) fit is scored on its held-out fold and on its
    training side; recall / precision / f1 / roc_auc for both sides in a long table (M4).

    Trees over a table that one task can hold grow there, whole ensembles at a time (``search``). Of a larger one boosted trees of
    up to ``together`` maps of a fold are fitted side by side, and forests that draw alike are grown once.
    ``ledger`` is a folder that belongs to these training rows: each fit's metrics are written there as it ends, and fits
    that it holds already are not repeated. A search that was stopped, or whose budget has grown, goes on from there.
    """
    maps = sample_params(model, n_iter, seed)
    spark = train.sparkSession
    texts = [json.dumps(m, sort_keys=True) for m in maps]
    full = [{**DEFAULT_PARAMS[model], **m} for m in maps]
    done = _finished(spark, ledger, model)
    open_maps = {k: [i for i in range(len(maps)) if (texts[i], k) not in done] for k in range(folds)}
    if model == "xgboost":  # maps of about the same length side by side
        open_maps = {k: sorted(of, key=lambda i: (maps[i]["maxIter"], maps[i]["maxDepth"])) for k, of in open_maps.items()}
    open_folds = sorted(k for k, of in open_maps.items() if of)
    local = bool(open_folds) and model in ("random_forest", "xgboost") and SE.fits(model, full, train.count(), len(open_folds))
    size = {"logistic_regression": len(maps), "random_forest": len(maps), "xgboost": 1 if local else together}[model]
    jobs = [(k, of[i:i + size]) for k, of in open_maps.items() for i in range(0, len(of), size)]
    if model == "logistic_regression":  # maps that read the same rows
        jobs = [(k, [i for i in of if maps[i].get("smote_ratio") == ratio]) for k, of in jobs for ratio in sorted({maps[i].get("smote_ratio") for i in of}, key=str)]
    if model == "random_forest":
        jobs = [(k, [of[j] for j in some]) for k, of in jobs for some in SE.alike([full[i] for i in of], len(K.FEATURES))]
    # imputation, scaling and SMOTE neighbours depend on the fold only: once per fold
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        preps = dict(zip(open_folds, ex.map(lambda k: prepare_fit(model, train.where(F.col("fold") != k)), open_folds)))

    def measure(scored, fits):
        """The metrics of the fits (fold, map) on both sides; ``model_used`` of ``scored`` is map/fold."""
        m = ME.metrics_long(scored).where(F.col("metric").isin("recall", "precision", "f1", "auc_roc"))
        rows = []
        for r in m.collect():  # 8 rows per fit
            i, k = map(int, r["model"].split("/"))
            rows.append((model, i, texts[i], k, r["split"], r["metric"], r["value"]))
        if ledger:
            name = hashlib.md5("/".join(f"{texts[i]}-{k}" for k, i in fits).encode()).hexdigest()
            spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/{model}/{name}")
        return rows

    def run(job):
        k, some = job
        sides = train.withColumn("split", F.when(F.col("fold") == k, F.lit("test")).otherwise(F.lit("train")))
        scored = [fm.transform(sides, keep=["label", "split"]).withColumn("model_used", F.lit(f"{i}/{k}"))
                  for fm, i in zip(fit_maps(model, preps[k], [maps[i] for i in some]), some)]
        size = AT_ONCE if model == "logistic_regression" else 1
        return list(itertools.chain.from_iterable(measure(functools.reduce(DataFrame.unionByName, scored[i:i + size]), [(k, j) for j in some[i:i + size]])
                                                  for i in range(0, len(scored), size)))

    def run_local(some):
        return measure(held.scored(some), [(k, i) for k, of in some for i in of])

    if local:
        with ThreadPoolExecutor(max_workers=parallelism) as ex:
            edges = dict(zip(open_folds, ex.map(lambda k: GR.bin_edges(preps[k].base, K.FEATURES), open_folds)))
        weights = ({k: SP.scale_pos_weight(preps[k].base).first()["scale_pos_weight"] or 1.0 for k in open_folds} if model == "xgboost" else {})
        held = SE.Local(model, train, full, {k: preps[k].medians for k in open_folds}, edges, weights, SEED)
        run, jobs = run_local, SE.batches(jobs, AT_ONCE)
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        rows = list(itertools.chain.from_iterable(ex.map(run, jobs)))
    if local:
        held.close()
    place = {t: i for i, t in enumerate(texts)}
    rows += [(r[0], place[r[2]], *r[2:]) for (text, k), found in done.items() if k < folds and text in place for r in found]
    return spark.createDataFrame(rows, LEDGER)


def best_params(cv: DataFrame) -> DataFrame:
    """Mean held-out roc_auc per parameter map; the best one is refit (refit='roc_auc')."""
    return (cv.where((F.col("side") == "test") & (F.col("metric") == "auc_roc"))
            .groupBy("model", "param_id", "params").agg(F.avg("value").alias("mean_test_auc"))
            .orderBy(F.col("mean_test_auc").desc(), "param_id"))


def refit_final(model: str, prepared: DataFrame, params: dict | None = None) -> FittedModel | FittedTrees:
    """Final model on train + validation rows."""
    return fit(model, prepared.where(F.col("split").isin("train", "val")), params)


def score_all(fitted: list[FittedModel], df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Score one customer set with every model."""
    out = None
    for m in fitted:
        s = m.transform(df, keep=keep)
        out = s if out is None else out.unionByName(s)
    return out
