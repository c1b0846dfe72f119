"""Churn and authorship features per file, and the split and label flags.

Everything here is a sum, minimum or maximum over the touches of a file, so a feature set is one
aggregation that combines before it shuffles.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.operators.history import anchor_to_ref, file_touches, history_before, hot_files, settled_bounds
from tremorline.operators.scaling import attach
from tremorline.schemas import AUTHORSHIP_FEATURES, CHURN_FEATURES, KEYS
from tremorline.session import materialize

# Trailing windows in days, and the constant added inside the logarithm.
WINDOWS_DAYS = (30, 60, 90)
RECENT_DAYS = 30
#: Registers of an author sketch, as a power of two.
AUTHOR_SKETCH_BITS = 12
LOG_EPSILON = 1e-12
#: Tasks that a hot file is dealt to.
HOT_PARTS = 64

Fold = tuple  # (name, aggregate, expression over one touch)


def _days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def _window_folds() -> list[Fold]:
    folds = []
    for days in WINDOWS_DAYS:
        inside = F.col("commit_date") >= F.col("ref_date") - _days(days)
        folds.append((f"lines_changed_{days}d", F.sum, F.when(inside, F.col("lines")).otherwise(0)))
        folds.append((f"commit_count_{days}d", F.sum, inside.cast("bigint")))
    return folds


def _lifetime_folds() -> list[Fold]:
    return [
        ("total_commits", F.sum, F.lit(1).cast("bigint")),
        ("total_lines_changed", F.sum, F.col("lines")),
        ("first_change", F.min, F.col("commit_date")),
        ("last_change", F.max, F.col("commit_date")),
        ("anchor", F.max, F.col("ref_date")),
    ]


def _split_folds() -> list[Fold]:
    before = F.col("commit_date") < F.col("cutoff")
    return [("in_train", F.max, before), ("in_test", F.max, ~before)]


def _label_folds() -> list[Fold]:
    in_window = (F.col("commit_date") >= F.col("cutoff")) & (F.col("commit_date") < F.col("label_end"))
    return [("label", F.max, (F.col("is_bugfix") & in_window).cast("int"))]


def _fold(folds: list[Fold]) -> list[Column]:
    return [aggregate(expression).alias(name) for name, aggregate, expression in folds]


def _whole_days(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("DAY", earlier, later)


def spike_ratio(lines_30d: Column, lines_90d: Column) -> Column:
    """Recent lines over the expected 30-day share of 90 days; 1.0 when there were none."""
    return F.when(lines_90d > 0, lines_30d / (lines_90d / F.lit(3.0))).otherwise(F.lit(1.0))


def _window_columns() -> list[Column]:
    names = [n for n, _, _ in _window_folds()]
    return [F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in CHURN_FEATURES if n in names]


def _lifetime_columns() -> list[Column]:
    return [
        F.col("total_commits"),
        F.coalesce(F.col("total_lines_changed"), F.lit(0)).cast("bigint").alias("total_lines_changed"),
        _whole_days(F.col("anchor"), F.col("first_change")).alias("file_age_days"),
        _whole_days(F.col("anchor"), F.col("last_change")).alias("days_since_last_change"),
    ]


def _spike_column() -> Column:
    return spike_ratio(
        F.coalesce(F.col("lines_changed_30d"), F.lit(0)), F.coalesce(F.col("lines_changed_90d"), F.lit(0))
    ).alias("churn_spike_ratio")


def _anchored_touches(facts: DataFrame, bounds: DataFrame | None, as_of) -> DataFrame:
    facts = history_before(facts, as_of)
    bounds = settled_bounds(facts) if bounds is None else bounds
    return anchor_to_ref(file_touches(facts.drop("author_name")), bounds)


def churn_windows(facts: DataFrame, bounds: DataFrame | None = None, as_of=None) -> DataFrame:
    """Lines and commits in the trailing windows, lower bound included, 0 where inactive."""
    touches = _anchored_touches(facts, bounds, as_of)
    return touches.groupBy(*KEYS).agg(*_fold(_window_folds())).select(*KEYS, *_window_columns())


def churn_spike(windows: DataFrame) -> DataFrame:
    return windows.select(*KEYS, _spike_column())


def lifetime_activity(facts: DataFrame, bounds: DataFrame | None = None, as_of=None) -> DataFrame:
    """Commits, lines, and whole days since the first and last change."""
    touches = _anchored_touches(facts, bounds, as_of)
    return touches.groupBy(*KEYS).agg(*_fold(_lifetime_folds())).select(*KEYS, *_lifetime_columns())


def churn_features(facts: DataFrame, bounds: DataFrame | None = None, as_of=None) -> DataFrame:
    """The eleven churn features, in one pass over the touches."""
    touches = _anchored_touches(facts, bounds, as_of)
    folded = touches.groupBy(*KEYS).agg(*_fold(_window_folds() + _lifetime_folds()))
    return folded.select(*KEYS, *_window_columns(), _spike_column(), *_lifetime_columns()).select(
        *KEYS, *CHURN_FEATURES
    )


def author_counts(facts: DataFrame) -> DataFrame:
    """Commits of each named author to each file."""
    return _by_author(file_touches(facts)).filter(F.col("author_name").isNotNull()).select(
        *KEYS, "author_name", "n_commits"
    )


def _by_author(touches: DataFrame) -> DataFrame:
    return touches.groupBy(*KEYS, "author_name").agg(
        F.count(F.lit(1)).alias("n_commits"), F.max("commit_date").alias("author_last_change")
    )


def _author_folds(ref_date: Column) -> list[Column]:
    named = F.col("author_name").isNotNull()
    n = F.when(named, F.col("n_commits"))
    recent = named & (F.col("author_last_change") >= ref_date - _days(RECENT_DAYS))
    return [
        F.count_if(named).alias("n_authors"),
        F.count_if(recent).alias("n_recent_authors"),
        F.sum(n).alias("n_authored"),
        F.max(n).alias("n_top"),
        F.sum(n * F.log2(n)).alias("n_log_n"),
    ]


def _author_merges() -> list[Column]:
    """``_author_folds`` of all authors from those of some authors each."""
    sums = [F.sum(name).alias(name) for name in ("n_authors", "n_recent_authors", "n_authored", "n_log_n")]
    return [*sums, F.max("n_top").alias("n_top")]


def _author_columns() -> list[Column]:
    total = F.col("n_authored")
    # With p = n/T: -sum(p*log2(p+e)) = log2(T) - sum(n*log2(n))/T - k*e/ln(2), up to terms in e^2.
    # It needs sums only, so the authors of a file never have to meet in one place.
    entropy = (
        F.log2(total) - F.col("n_log_n") / total - F.col("n_authors") * F.lit(LOG_EPSILON) / F.log(F.lit(2.0))
    )
    return [
        F.col("n_authors").alias("unique_authors_total"),
        F.col("n_recent_authors").alias("unique_authors_30d"),
        F.coalesce(F.col("n_top") / total, F.lit(0.0)).alias("bus_factor_score"),
        F.greatest(F.lit(0.0), F.coalesce(entropy, F.lit(0.0))).alias("author_entropy"),
    ]


def _authorship(facts: DataFrame, bounds: DataFrame | None, as_of) -> DataFrame:
    facts = history_before(facts, as_of)
    bounds = settled_bounds(facts) if bounds is None else bounds
    by_author = anchor_to_ref(_by_author(file_touches(facts)), bounds)
    return by_author.groupBy(*KEYS).agg(*_author_folds(F.col("ref_date"))).select(*KEYS, *_author_columns())


def unique_authors(facts: DataFrame, bounds: DataFrame | None = None, as_of=None) -> DataFrame:
    return _authorship(facts, bounds, as_of).select(*KEYS, "unique_authors_total", "unique_authors_30d")


def author_sketches(facts: DataFrame, bits: int = AUTHOR_SKETCH_BITS) -> DataFrame:
    """A sketch of the named authors of each file and day; sketches of days, and of new history, merge into those of any window."""
    touches = file_touches(facts).filter(F.col("author_name").isNotNull())
    return touches.groupBy(*KEYS, F.to_date("commit_date").alias("day")).agg(F.hll_sketch_agg("author_name", bits).alias("authors"))


def unique_authors_approx(sketches: DataFrame, bounds: DataFrame) -> DataFrame:
    """``unique_authors`` from ``author_sketches``, the recent window in whole days; files without a named author are left out.

    The relative standard error is about 0.8 / sqrt(2 ** bits).
    """
    recent = F.col("day") >= F.to_date(F.col("ref_date") - _days(RECENT_DAYS))
    anchored = attach(sketches, materialize(bounds.select("repo", "ref_date"), "bounds"), on=["repo"])
    merged = anchored.groupBy(*KEYS).agg(
        F.hll_union_agg("authors").alias("all"), F.hll_union_agg(F.when(recent, F.col("authors"))).alias("recent"))
    return merged.select(*KEYS, F.hll_sketch_estimate("all").alias("unique_authors_total"),
                         F.coalesce(F.hll_sketch_estimate("recent"), F.lit(0)).alias("unique_authors_30d"))


def bus_factor(facts: DataFrame) -> DataFrame:
    """Share of the most active author; 0 without a named author."""
    return _without_ref(facts).select(*KEYS, "bus_factor_score")


def author_entropy(facts: DataFrame) -> DataFrame:
    """Shannon entropy in bits of the authors' commit shares."""
    return _without_ref(facts).select(*KEYS, "author_entropy")


def _without_ref(facts: DataFrame) -> DataFrame:
    by_author = _by_author(file_touches(facts))
    return (
        by_author.groupBy(*KEYS)
        .agg(*_author_folds(F.col("author_last_change")))
        .select(*KEYS, *_author_columns())
    )


def authorship_features(facts: DataFrame, bounds: DataFrame | None = None, as_of=None) -> DataFrame:
    return _authorship(facts, bounds, as_of).select(*KEYS, *AUTHORSHIP_FEATURES)


def label_files(labelled: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """1 for files in a bug-fix commit inside the label window, else 0."""
    anchored = anchor_to_ref(labelled, bounds)
    return anchored.groupBy(*KEYS).agg(*_fold(_label_folds())).withColumn(
        "label", F.coalesce("label", F.lit(0))
    )


def temporal_split(facts: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Membership before and from the cutoff on; a file may be in both."""
    return anchor_to_ref(facts, bounds).groupBy(*KEYS).agg(*_fold(_split_folds()))


def split_flags(labelled: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Label and both memberships in one pass."""
    anchored = anchor_to_ref(labelled, bounds)
    return (
        anchored.groupBy(*KEYS).agg(*_fold(_label_folds() + _split_folds()))
        .withColumn("label", F.coalesce("label", F.lit(0)))
    )


def file_profile(touches: DataFrame, bounds: DataFrame) -> DataFrame:
    """Churn, authorship and split flags of every file.

    Touches are shuffled once, by file, and folded by author, then by file; sums, minima and maxima of those of authors are those of
    the file. A hot file (see ``hot_files``) is dealt to many tasks by its authors, and its parts are folded once more.
    """
    hot = hot_files(touches)
    needed = touches.select(*KEYS, "author_name", "commit_date", "is_bugfix", "lines")
    if hot.isEmpty():
        part, dealt = [], needed.repartition(*KEYS)
    else:
        part = ["part"]
        share = F.when(F.col("is_hot"), F.pmod(F.xxhash64("author_name"), F.lit(HOT_PARTS))).otherwise(F.lit(0))
        marked = attach(needed, hot.withColumn("is_hot", F.lit(True)), on=KEYS).withColumn("part", share).drop("is_hot")
        dealt = marked.repartition(*KEYS, "part")
    folds = _window_folds() + _lifetime_folds() + _split_folds() + _label_folds()
    again = [aggregate(name).alias(name) for name, aggregate, _ in folds]
    bounds = bounds.select("repo", "ref_date", "cutoff", "label_end")
    by_author = attach(dealt, bounds, on=["repo"]).groupBy(*KEYS, *part, "author_name").agg(
        F.count(F.lit(1)).alias("n_commits"), F.max("commit_date").alias("author_last_change"), *_fold(folds))
    recent_from = F.col("anchor")  # the reference date, the same for all rows of a repository
    by_file = by_author.groupBy(*KEYS, *part).agg(*_author_folds(recent_from), *again)
    if part:
        by_file = by_file.groupBy(*KEYS).agg(*_author_merges(), *again)
    return by_file.select(
        *KEYS,
        *_window_columns(),
        _spike_column(),
        *_lifetime_columns(),
        *_author_columns(),
        F.coalesce("label", F.lit(0)).alias("label"),
        "in_train",
        "in_test",
    ).select(*KEYS, *CHURN_FEATURES, *AUTHORSHIP_FEATURES, "label", "in_train", "in_test")
