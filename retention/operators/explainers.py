"""Global importance of any fitted model: the explainer is picked by the model and falls back on failure.

Explainers are tried in order: tree attributions where the model is an ensemble, coefficients times centred values where it
is linear, sampled Shapley values for anything that scores. One that fails leaves a note and the next one is tried; the result
says in a column which one it comes from.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import cut_lineage
from . import explain as EX
from . import features as FE
from . import score as SC
from . import tree_explain as TX

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Explainer:
    """run(fitted, rows, background) returns (customerID, model, feature, contribution)."""
    name: str
    suits: Callable[[object], bool]
    run: Callable[[object, DataFrame, DataFrame], DataFrame]


def _trees(fitted, rows: DataFrame, background: DataFrame) -> DataFrame:
    return TX.tree_contributions(fitted, rows).where("feature <> 'base_value'").select(K.ID_COL, "model", "feature", "contribution")


def _linear(fitted, rows: DataFrame, background: DataFrame) -> DataFrame:
    scorer = SC.from_spark_lr(fitted)  # scaled by the training rows: their mean contributes 0
    return EX.contributions(FE.impute(rows, fitted.medians, K.FEATURES), scorer).select(K.ID_COL, "model", "feature", "contribution")


def _sampled(fitted, rows: DataFrame, background: DataFrame) -> DataFrame:
    return TX.sampled_shapley(fitted, rows, background).where("feature <> 'base_value'").select(
        K.ID_COL, "model", "feature", "contribution")


EXPLAINERS = (
    Explainer("tree", lambda m: hasattr(m, "ensemble"), _trees),
    Explainer("linear", lambda m: hasattr(getattr(m, "pipeline", None), "stages") and hasattr(m.pipeline.stages[-1], "coefficients"), _linear),
    Explainer("sampled", lambda m: True, _sampled),
)


def explain(fitted, rows: DataFrame, background: DataFrame, explainers: tuple[Explainer, ...] = EXPLAINERS) -> DataFrame:
    """(customerID, model, feature, contribution, explainer) by the first explainer that suits the model and does not fail."""
    failed: list[str] = []
    for e in explainers:
        if not e.suits(fitted):
            continue
        try:  # written here: a failure in a task shows now and not at the caller
            return cut_lineage(e.run(fitted, rows, background).withColumn("explainer", F.lit(e.name)))
        except (PySparkException, ArithmeticError, LookupError, ValueError, TypeError, AttributeError) as why:
            log.warning("explainer %s failed for %s: %s", e.name, getattr(fitted, "name", fitted), why)
            failed.append(f"{e.name}: {why}")
    raise ValueError("no explainer is left: " + "; ".join(failed))


def global_importance(fitted: list, rows: DataFrame, background: DataFrame, explainers: tuple[Explainer, ...] = EXPLAINERS) -> DataFrame:
    """(model, feature, importance, explainer): mean |contribution| of every model in one table."""
    out = None
    for m in fitted:
        c = explain(m, rows, background, explainers)
        table = EX.mean_abs_contribution(c).join(c.select("model", "explainer").distinct(), "model")  # one row a model
        out = table if out is None else out.unionByName(table)
    return out
