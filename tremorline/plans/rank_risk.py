"""The whole analysis: change records and source texts in, ranked and explained files out."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.operators.coupling import mass_commit_report
from tremorline.operators.evaluation import evaluate_curve, pr_curve, score_curve
from tremorline.operators.history import (
    MIN_ROWS, commit_file_rows, file_touches, history_before, label_bugfix, settled_stats,
)
from tremorline.operators.matrix import split_report
from tremorline.operators.model import BoostingParams, FittedRun, fit_and_score
from tremorline.operators.report import DETAILS, detailed, driver_sentences, global_importance, prediction_spread, rank_files
from tremorline.operators.scaling import attach
from tremorline.plans.feature_matrix import matrix_from_touches
from tremorline.schemas import KEYS
from tremorline.session import materialize


@dataclass(frozen=True)
class RiskAnalysis:
    """Result tables; all but ``rejected`` cover repositories with enough history. A table is planned, and what it needs stored, when it is asked for.

    ``judged`` has probability, driver sentences, label and statistics of every scored file. ``skipped`` counts the commits that were
    too large for coupling, ``split`` describes both sides of the split in time, and ``spread`` flags repositories whose files all
    got one probability.
    """

    matrix: DataFrame
    fitted: FittedRun
    judged: DataFrame
    touches: DataFrame
    rejected: DataFrame

    @cached_property
    def ranked(self) -> DataFrame:
        return rank_files(detailed(self.judged))

    @cached_property
    def _curve(self) -> DataFrame:
        return score_curve(self.judged.select("repo", F.col("label").alias("y"), F.col("probability").alias("score")))

    @cached_property
    def metrics(self) -> DataFrame:
        return evaluate_curve(self._curve)

    @cached_property
    def pr_curve(self) -> DataFrame:
        return pr_curve(self._curve)

    @cached_property
    def importance(self) -> DataFrame:
        return global_importance(self.fitted.scored)

    @cached_property
    def skipped(self) -> DataFrame:
        return mass_commit_report(self.touches)

    @cached_property
    def split(self) -> DataFrame:
        return split_report(self.matrix)

    @cached_property
    def spread(self) -> DataFrame:
        return prediction_spread(self.judged)


def rank_risk(
    records: DataFrame,
    sources: DataFrame,
    params: BoostingParams = BoostingParams(),
    max_commits: int | None = None,
    min_rows: int = MIN_ROWS,
    fit: Callable[[DataFrame, BoostingParams], FittedRun] = fit_and_score,
    as_of: datetime | Column | None = None,
) -> RiskAnalysis:
    """The whole history counts unless ``max_commits`` or ``as_of`` (strictly before it) is given. ``fit`` may be replaced by trees trained before.

    Three tables are stored on the way, each read by several later steps: touches, matrix, judged scores."""
    labelled = history_before(label_bugfix(commit_file_rows(records, max_commits)), as_of)
    return rank_touches(materialize(file_touches(labelled, in_path_order=True), "touches"), sources, params, min_rows, fit)


def rank_touches(
    touches: DataFrame,
    sources: DataFrame,
    params: BoostingParams = BoostingParams(),
    min_rows: int = MIN_ROWS,
    fit: Callable[[DataFrame, BoostingParams], FittedRun] = fit_and_score,
) -> RiskAnalysis:
    """The analysis from stored touches on (see ``file_touches``), as kept history gives them."""
    all_stats = settled_stats(touches)
    stats = all_stats.filter(F.col("n_rows") >= min_rows)
    rejected = all_stats.filter(F.col("n_rows") < min_rows).select(
        "repo", "n_rows", F.lit(f"not enough history: fewer than {min_rows} rows").alias("reason"))
    eligible = attach(touches, stats.select("repo"), on=["repo"], how="inner")

    by_repo = matrix_from_touches(eligible, stats, sources).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    matrix = materialize(by_repo, "matrix")
    fitted = fit(matrix, params)
    # Scored, explained and joined once: rank, curve and spread read the sentences, not the attributions behind them.
    explained = fitted.scored.select(*KEYS, "probability", driver_sentences())
    judged = materialize(explained.join(matrix.select(*KEYS, "label", *DETAILS), KEYS), "judged")
    return RiskAnalysis(matrix, fitted, judged, eligible, rejected)
