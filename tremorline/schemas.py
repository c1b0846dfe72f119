"""Table schemas and the canonical feature order."""
from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["repo", "file_path"]

# Feature names and their order in the matrix.
CHURN_FEATURES = [
    "lines_changed_30d", "lines_changed_60d", "lines_changed_90d",
    "commit_count_30d", "commit_count_60d", "commit_count_90d",
    "churn_spike_ratio", "total_commits", "total_lines_changed",
    "file_age_days", "days_since_last_change",
]
COUPLING_FEATURES = [
    "coupling_score_mean", "coupling_score_max", "coupled_high_churn", "unique_coupling_partners",
]
AUTHORSHIP_FEATURES = [
    "unique_authors_total", "unique_authors_30d", "bus_factor_score", "author_entropy",
]
COMPLEXITY_FEATURES = ["cyclomatic_complexity", "complexity_rank", "is_high_complexity"]
FEATURES = CHURN_FEATURES + COUPLING_FEATURES + AUTHORSHIP_FEATURES + COMPLEXITY_FEATURES

DOUBLE_FEATURES = {
    "churn_spike_ratio", "coupling_score_mean", "coupling_score_max",
    "bus_factor_score", "author_entropy", "cyclomatic_complexity",
}


def feature_type(name: str) -> str:
    return "double" if name in DOUBLE_FEATURES else "bigint"


CHANGE_RECORDS = T.StructType([
    T.StructField("repo", T.StringType(), False),
    T.StructField("commit_hash", T.StringType(), False),
    T.StructField("commit_date", T.TimestampType(), False),
    T.StructField("is_merge", T.BooleanType(), False),
    T.StructField("author_name", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("old_path", T.StringType()),
    T.StructField("new_path", T.StringType()),
    T.StructField("lines_added", T.LongType()),
    T.StructField("lines_deleted", T.LongType()),
    # Optional: place in the history walk (0 = newest) and offset of the date from UTC, as "+02:00".
    T.StructField("commit_seq", T.LongType()),
    T.StructField("utc_offset", T.StringType()),
])

COMMIT_FILES = T.StructType([
    T.StructField("repo", T.StringType(), False),
    T.StructField("commit_hash", T.StringType(), False),
    T.StructField("commit_date", T.TimestampType(), False),
    T.StructField("author_name", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("lines_added", T.LongType()),
    T.StructField("lines_deleted", T.LongType()),
    T.StructField("is_code_file", T.BooleanType()),
])

SOURCE_FILES = T.StructType([
    T.StructField("repo", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("source", T.StringType()),
])

SCORED_FILES = T.StructType([
    T.StructField("repo", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("probability", T.DoubleType(), False),
    T.StructField("contributions", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("phi", T.DoubleType()),
    ]))),
])

_METRICS = ("auc_roc", "avg_precision", "threshold_05_precision", "threshold_05_recall", "threshold_05_f1")
#: What is kept of an analysis, by repository.
RESULT_TABLES = {
    "ranked": T.StructType([
        T.StructField("repo", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("risk_score", T.DoubleType()),
        T.StructField("top_drivers", T.ArrayType(T.StringType())), T.StructField("total_commits", T.LongType()),
        T.StructField("churn_30d", T.LongType()), T.StructField("bus_factor_score", T.DoubleType()),
        T.StructField("coupling_score_max", T.DoubleType()), T.StructField("rank", T.LongType()),
    ]),
    "metrics": T.StructType([T.StructField("repo", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in _METRICS]]),
    "pr_curve": T.StructType([T.StructField("repo", T.StringType()),
                              *[T.StructField(c, T.DoubleType()) for c in ("threshold", "recall", "precision", "no_skill")]]),
}
