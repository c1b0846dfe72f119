"""Ranked, explained results and the tables behind the report views."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorline.functions.scalars import (
    HIGH_FROM, exact_round, fixed_text, is_critical, risk_band, risk_colour, risk_score, shorten_path,
)
from tremorline.operators.scaling import running_totals
from tremorline.schemas import FEATURES, KEYS

TOP_DRIVERS = 3
#: Statistics that a file's result row shows.
DETAILS = ["total_commits", "commit_count_30d", "bus_factor_score", "coupling_score_max"]

# The sentence for each feature; the placeholder takes the feature's value.
DRIVER_TEXTS = {
    "lines_changed_30d": "high recent churn (%.0f lines in 30d)",
    "lines_changed_60d": "elevated 60d churn (%.0f lines)",
    "lines_changed_90d": "elevated 90d churn (%.0f lines)",
    "commit_count_30d": "frequent recent changes (%.0f commits in 30d)",
    "commit_count_60d": "frequent changes in 60d (%.0f commits)",
    "commit_count_90d": "frequent changes in 90d (%.0f commits)",
    "churn_spike_ratio": "churn spike ratio: %.1fx",
    "total_commits": "high total commit count (%.0f)",
    "total_lines_changed": "large lifetime churn (%.0f lines total)",
    "file_age_days": "file age: %.0f days",
    "days_since_last_change": "last changed %.0f days ago",
    "coupling_score_mean": "tightly coupled to other files (mean score: %.2f)",
    "coupling_score_max": "max coupling score: %.2f",
    "coupled_high_churn": "coupled to high-churn files",
    "unique_coupling_partners": "co-changes with %.0f unique files",
    "unique_authors_total": "touched by %.0f authors total",
    "unique_authors_30d": "active authors recently: %.0f",
    "bus_factor_score": "single author dominates (bus factor: %.2f)",
    "author_entropy": "author entropy: %.2f",
    "cyclomatic_complexity": "cyclomatic complexity: %.1f",
    "complexity_rank": "complexity grade: %.0f/6",
    "is_high_complexity": "high code complexity (grade C or above)",
}


def driver_parts(template: str) -> tuple[str, int | None, str]:
    """Text before the value, its decimals (None without a value), text after it."""
    found = re.fullmatch(r"(.*)%\.(\d)f(.*)", template)
    return (found[1], int(found[2]), found[3]) if found else (template, None, "")


def driver_text(feature: Column, value: Column) -> Column:
    """Sentence for a feature and its value; unknown features read ``name: 0.00``."""
    parts = {name: driver_parts(template) for name, template in DRIVER_TEXTS.items()}
    by_decimals = {}
    for name, (_, decimals, _) in parts.items():
        by_decimals.setdefault(decimals, []).append(name)
    number = F.lit("")
    for decimals, names in by_decimals.items():
        if decimals is not None:
            number = F.when(feature.isin(names), fixed_text(value, decimals)).otherwise(number)
    before = F.create_map(*[F.lit(x) for name, (text, _, _) in parts.items() for x in (name, text)])
    after = F.create_map(*[F.lit(x) for name, (_, _, text) in parts.items() for x in (name, text)])
    return F.when(
        feature.isin(list(DRIVER_TEXTS)), F.concat(before[feature], number, after[feature])
    ).otherwise(F.concat(feature, F.lit(": "), fixed_text(value, 2)))


def attribution_rows(contributions: DataFrame) -> DataFrame:
    """One row per file and feature."""
    return contributions.select(*KEYS, F.inline("contributions"))


def driver_sentences(k: int = TOP_DRIVERS) -> Column:
    """Sentences for the ``k`` features of largest absolute attribution, either sign; ties go to the later feature.

    The features of a file sit in one array, ``contributions``, in canonical order, so this is an expression.
    """
    strongest = F.slice(
        F.reverse(F.array_sort(F.transform(
            "contributions",
            lambda c, at: F.struct(F.abs(c["phi"]).alias("size"), at.alias("at"), c.alias("c")),
        ))), 1, k,
    )
    texts = F.transform(strongest, lambda s: driver_text(s["c"]["feature"], s["c"]["value"]))
    return F.coalesce(texts, F.array().cast("array<string>")).alias("top_drivers")


def top_drivers(contributions: DataFrame, k: int = TOP_DRIVERS) -> DataFrame:
    """``driver_sentences`` of every file."""
    return contributions.select(*KEYS, driver_sentences(k))


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature and its rank within the repository."""
    means = attribution_rows(contributions).groupBy("repo", "feature").agg(
        F.avg(F.abs("phi")).alias("mean_abs_phi")
    )
    order = F.create_map(*[F.lit(x) for at, name in enumerate(FEATURES) for x in (name, at)])
    largest = W.partitionBy("repo").orderBy(F.desc("mean_abs_phi"), order[F.col("feature")].desc())
    return means.withColumn("rank", F.row_number().over(largest))


def ranked_with_drivers(predictions: DataFrame, drivers: DataFrame, features: DataFrame) -> DataFrame:
    """Score, drivers and the four detail statistics of every predicted file; absent ones are empty or 0."""
    facts = features.select(*KEYS, *DETAILS)
    return detailed(predictions.select(*KEYS, "probability").join(drivers, KEYS, "left").join(facts, KEYS, "left"))


def detailed(rows: DataFrame) -> DataFrame:
    """Result rows from rows that hold probability, top_drivers and the statistics already."""
    return rows.select(
        *KEYS,
        risk_score(F.col("probability")).alias("risk_score"),
        F.coalesce("top_drivers", F.array().cast("array<string>")).alias("top_drivers"),
        F.coalesce("total_commits", F.lit(0)).cast("bigint").alias("total_commits"),
        F.coalesce("commit_count_30d", F.lit(0)).cast("bigint").alias("churn_30d"),
        exact_round(F.coalesce("bus_factor_score", F.lit(0.0)), 4).alias("bus_factor_score"),
        exact_round(F.coalesce("coupling_score_max", F.lit(0.0)), 4).alias("coupling_score_max"),
    )


def rank_files(results: DataFrame) -> DataFrame:
    """1-based position by risk score within the repository; equal scores in path order."""
    ranked = running_totals(
        results, ["repo"], [F.col("risk_score").desc(), F.col("file_path")], {"rank": F.lit(1)}
    )
    return ranked.drop("rank_total")


def file_detail(results: DataFrame, path: str, repo: str | None = None) -> DataFrame:
    """The detail row of one exact path; no row when it is unknown."""
    match = results.filter(F.col("file_path") == path)
    if repo is not None:
        match = match.filter(F.col("repo") == repo)
    return match.select(
        *KEYS, "risk_score", "top_drivers", "total_commits", "churn_30d", "bus_factor_score", "coupling_score_max"
    )


def file_details(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """``file_detail`` for a table of (repo, file_path)."""
    return results.join(wanted.select(*KEYS), KEYS, "left_semi")


def risk_bands(results: DataFrame) -> DataFrame:
    score = F.col("risk_score")
    return results.select(
        *KEYS, "risk_score", risk_band(score).alias("band"), risk_colour(score).alias("colour"),
        is_critical(score).alias("is_critical"),
    )


def risk_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files_analysed"),
        F.count_if(F.col("risk_score") >= HIGH_FROM).alias("high_risk_files"),
    )


def prediction_spread(predictions: DataFrame) -> DataFrame:
    """Distinct probabilities at three decimals; a single one means the model said nothing."""
    distinct = predictions.select("repo", exact_round(F.col("probability"), 3).alias("p")).distinct()
    return distinct.groupBy("repo").agg(F.count(F.lit(1)).alias("distinct_probabilities")).withColumn(
        "uniform", F.col("distinct_probabilities") == 1
    )


def risk_barchart_data(results: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` riskiest files per repository, lowest of them first, with label and colour."""
    riskiest = W.partitionBy("repo").orderBy(F.desc("risk_score"), "file_path")
    top = results.select(*KEYS, "risk_score").withColumn("from_top", F.row_number().over(riskiest)).filter(
        F.col("from_top") <= k
    )
    shown = F.max("from_top").over(W.partitionBy("repo"))
    return top.select(
        "repo",
        (shown - F.col("from_top") + 1).alias("position"),
        shorten_path(F.col("file_path")).alias("label"),
        "risk_score",
        risk_colour(F.col("risk_score")).alias("colour"),
    )


def risk_treemap_data(results: DataFrame) -> DataFrame:
    return results.select(
        "repo", "file_path", shorten_path(F.col("file_path")).alias("label"), F.lit(1).alias("weight"), "risk_score"
    )
