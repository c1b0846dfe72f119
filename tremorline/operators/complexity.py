"""Cyclomatic complexity of the current text of Python files."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.functions.python_source import mean_complexity_udf
from tremorline.functions.scalars import GRADE_LIMITS, complexity_grade, high_complexity
from tremorline.schemas import COMPLEXITY_FEATURES, KEYS


def file_complexity(sources: DataFrame) -> DataFrame:
    """Mean block complexity of every parseable ``.py`` text.

    Parsing takes far longer than reading, so texts are dealt to ``spark.sql.shuffle.partitions`` tasks first: a few well
    compressed files would else be parsed by as few tasks. Only paths and numbers go on to the join.
    """
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    python_texts = sources.filter(F.col("file_path").endswith(".py")).repartition(tasks, *KEYS)
    # The measure is exploded, as a filter on the function itself would be moved below it and parse each text twice.
    measured = F.array(mean_complexity_udf("source"))
    return python_texts.select(
        *KEYS, F.explode(measured).alias("cyclomatic_complexity")
    ).filter(F.col("cyclomatic_complexity").isNotNull())


def complexity_left(files: DataFrame, measured: DataFrame, limits: tuple[float, ...] = GRADE_LIMITS) -> DataFrame:
    """All files with their complexity; (0.0, 1, 0) for those without a parseable Python text."""
    mean = F.coalesce("cyclomatic_complexity", F.lit(0.0))
    return (
        files.select(*KEYS).distinct()
        .join(measured, KEYS, "left")
        .select(
            *KEYS,
            mean.alias("cyclomatic_complexity"),
            complexity_grade(mean, limits).alias("complexity_rank"),
            high_complexity(mean).alias("is_high_complexity"),
        )
    )


def complexity_features(
    files: DataFrame, sources: DataFrame, limits: tuple[float, ...] = GRADE_LIMITS
) -> DataFrame:
    return complexity_left(files, file_complexity(sources), limits).select(*KEYS, *COMPLEXITY_FEATURES)
