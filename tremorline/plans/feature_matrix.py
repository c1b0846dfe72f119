"""From labelled facts to the feature matrix."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame

from tremorline.operators.activity import file_profile, split_flags
from tremorline.operators.complexity import complexity_features
from tremorline.operators.coupling import coupling_of
from tremorline.operators.history import file_touches, history_before, settled_stats
from tremorline.operators.matrix import labelled_matrix
from tremorline.schemas import KEYS
from tremorline.session import materialize


def build_feature_matrix(
    labelled: DataFrame, churn: DataFrame, coupling: DataFrame, authorship: DataFrame, complexity: DataFrame
) -> DataFrame:
    """Merge given feature frames; add label, in_train and in_test from the labelled facts."""
    return labelled_matrix(split_flags(labelled), churn, coupling, authorship, complexity)


def matrix_from_history(labelled: DataFrame, sources: DataFrame, as_of: datetime | Column | None = None) -> DataFrame:
    """All features of all files, each history feature from one shared, stored table of touches.

    With ``as_of`` only the history strictly before it counts; texts are taken as they are now.
    """
    touches = materialize(file_touches(history_before(labelled, as_of), in_path_order=True), "touches")
    stats = settled_stats(touches)
    return matrix_from_touches(touches, stats, sources)


def matrix_from_touches(touches: DataFrame, stats: DataFrame, sources: DataFrame) -> DataFrame:
    profile = materialize(file_profile(touches, stats), "profile")
    coupling = coupling_of(touches.select(*KEYS, "commit_hash", "n_rows"), profile, stats)
    complexity = complexity_features(profile, sources)
    return labelled_matrix(profile, coupling, complexity)
