"""The per-file feature matrix with label and time split."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.schemas import FEATURES, KEYS, feature_type


def canonical_features(df: DataFrame) -> DataFrame:
    """Keys and the known features in canonical order; absent ones are left out."""
    return df.select(*KEYS, *[name for name in FEATURES if name in df.columns])


def _merged(frames: list[DataFrame]) -> DataFrame:
    """Outer merge on (repo, file_path).

    Frames are stacked and folded per file: one shuffle whatever their number, where
    chained full joins would shuffle again after each step.
    """
    stacked = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)
    values = [name for name in stacked.columns if name not in KEYS]
    return stacked.groupBy(*KEYS).agg(*[F.max(name).alias(name) for name in values])


def _completed(name: str):
    value = F.coalesce(F.col(name).cast(feature_type(name)), F.lit(0).cast(feature_type(name)))
    if name == "complexity_rank":
        value = F.greatest(value, F.lit(1).cast("bigint"))
    return value.alias(name)


def feature_matrix(*frames: DataFrame) -> DataFrame:
    """One row per file found in any frame; missing features are 0, grades at least 1."""
    merged = canonical_features(_merged(list(frames)))
    return merged.select(*KEYS, *[_completed(name) for name in merged.columns if name not in KEYS])


def labelled_matrix(flags: DataFrame, *frames: DataFrame) -> DataFrame:
    """``feature_matrix`` with label, in_train and in_test, still in one shuffle. ``flags`` may hold features, too."""
    merged = _merged([flags, *frames])
    return merged.select(
        *KEYS,
        *[_completed(name) for name in FEATURES if name in merged.columns],
        F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"),
        F.coalesce("in_train", F.lit(False)).alias("in_train"),
        F.coalesce("in_test", F.lit(False)).alias("in_test"),
    )


def split_report(matrix: DataFrame) -> DataFrame:
    """Rows and positive rate per side, with a flag for a test side without positives."""
    def side(flag: str, name: str):
        label = F.when(F.col(flag), F.col("label"))
        return [F.count_if(flag).alias(f"{name}_files"),
                F.coalesce(F.avg(label), F.lit(0.0)).alias(f"{name}_pos_rate"),
                F.coalesce(F.sum(label), F.lit(0)).alias(f"{name}_positives")]

    return (
        matrix.groupBy("repo").agg(*side("in_train", "train"), *side("in_test", "test"))
        .withColumn("no_test_positives", (F.col("test_files") > 0) & (F.col("test_positives") == 0))
        .drop("train_positives", "test_positives")
    )
