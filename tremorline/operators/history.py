"""From raw change records to labelled commit-file facts."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorline.functions.scalars import (
    code_file_flag, is_bugfix_message, lines_changed, moment, resolve_path, utc_commit_date,
)
from tremorline.operators.scaling import attach, running_totals
from tremorline.session import materialize

# Commit cap per repository, fewest rows worth modelling, split and label spans, session zones that are UTC.
MAX_COMMITS = 15_000
MIN_ROWS = 100
CUTOFF_MONTHS = 6
UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")
LABEL_DAYS = 30
#: Rows of a file above which they are not gathered in one task.
HOT_ROWS = 1_000_000


def non_merge_changes(records: DataFrame) -> DataFrame:
    """Rows of ordinary commits; a row that does not say counts as one."""
    return records.filter(~F.coalesce(F.col("is_merge"), F.lit(False)))


def _utc_date(records: DataFrame) -> Column:
    offset = F.col("utc_offset") if "utc_offset" in records.columns else None
    return utc_commit_date(F.col("commit_date"), offset)


def latest_commits(records: DataFrame, n: int = MAX_COMMITS) -> DataFrame:
    """All rows of the ``n`` most recent commits of each repository.

    Recency is ``commit_seq`` (0 = newest, the order of the history walk) if the source has it,
    else commit date; ties fall to the higher hash. A commit without files still counts.

    Only the n-th commit of repositories above the cap has to be found: a count per day (or run of
    sequence numbers) narrows it to one slot, the commits in that slot are ranked, and every
    row is then compared with that one commit. The rows themselves are not shuffled by repository.
    """
    age = -F.unix_micros(_utc_date(records))
    slot = F.floor(F.col("age") / F.lit(86_400_000_000))
    if "commit_seq" in records.columns:  # null where the source does not have it
        age = F.coalesce(F.col("commit_seq").cast("bigint"), age)
        slot = F.when(F.col("age") >= 0, F.shiftright(F.col("age"), 10)).otherwise(slot)
    # The narrow commit table is read three times, the records twice: to make it and to be filtered.
    commits = materialize(
        records.groupBy("repo", "commit_hash").agg(F.min(age).alias("age")).withColumn("slot", slot), "commits"
    )
    through = W.partitionBy("repo").orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    last_slot = (
        commits.groupBy("repo", "slot").agg(F.count(F.lit(1)).alias("in_slot"))
        .withColumn("reached", F.sum("in_slot").over(through))
        .filter((F.col("reached") >= n) & (F.col("reached") - F.col("in_slot") < n))
        .select("repo", F.col("slot").alias("last_slot"),
                (n - F.col("reached") + F.col("in_slot")).alias("wanted"))
    )
    candidates = attach(commits, last_slot, on=["repo"], how="inner").filter(
        F.col("slot") == F.col("last_slot")
    )
    ranked = running_totals(
        candidates, ["repo"], [F.col("age"), F.col("commit_hash").desc()], {"position": F.lit(1)}
    )
    oldest_kept = ranked.filter(F.col("position") == F.col("wanted")).select(
        "repo", F.col("age").alias("kept_age"), F.col("commit_hash").alias("kept_hash")
    )
    kept = (
        F.col("kept_age").isNull()
        | (age < F.col("kept_age"))
        | ((age == F.col("kept_age")) & (F.col("commit_hash") >= F.col("kept_hash")))
    )
    return (
        attach(records, oldest_kept, on=["repo"])
        .filter(kept)
        .drop("kept_age", "kept_hash")
    )


def commit_file_rows(records: DataFrame, max_commits: int | None = None) -> DataFrame:
    """One row per (commit, modified file): merges dropped, paths resolved, dates in UTC.

    The whole history counts; ``max_commits`` keeps the latest ones of each repository (``latest_commits``).
    """
    zone = records.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"dates are in UTC: set spark.sql.session.timeZone to UTC, not {zone}")
    changes = non_merge_changes(records)
    if max_commits is not None:
        changes = latest_commits(changes, max_commits)
    path = resolve_path(F.col("new_path"), F.col("old_path"))
    return (
        changes.withColumn("file_path", path)
        .filter(F.col("file_path").isNotNull())
        .select(
            "repo",
            "commit_hash",
            _utc_date(records).alias("commit_date"),
            "author_name",
            "message",
            "file_path",
            F.col("lines_added").cast("bigint").alias("lines_added"),
            F.col("lines_deleted").cast("bigint").alias("lines_deleted"),
            code_file_flag(F.col("file_path")).alias("is_code_file"),
        )
    )


def label_bugfix(facts: DataFrame) -> DataFrame:
    return facts.withColumn("is_bugfix", is_bugfix_message(F.col("message")))


def history_order(facts: DataFrame) -> DataFrame:
    """Facts by commit date, for sinks that want sorted files."""
    return facts.orderBy("commit_date", "repo", "commit_hash", "file_path")


def history_before(facts: DataFrame, as_of: datetime | Column | None) -> DataFrame:
    """History strictly before ``as_of``; the whole of it when ``as_of`` is None."""
    if as_of is None:
        return facts
    return facts.filter(F.col("commit_date") < moment(as_of))


def file_touches(facts: DataFrame, in_path_order: bool = False) -> DataFrame:
    """One row per (file, commit): the shared base of all history features.

    Keyed on file and commit together, so neither a hot file nor a mass commit fills one task. ``in_path_order`` cuts and sorts
    the rows by that key, for a table to be stored: the touches of a file then lie side by side, so that what reads it counts
    a file where it is read, and shuffles like paths next to each other. Finding the cuts takes another pass over ``facts``.
    Rows of a commit that disagree on the date or author give the earliest date and the last author by name, known
    before unknown. Text makes this a sorting aggregation: drop ``author_name`` if it is not needed.
    """
    author = [F.max("author_name").alias("author_name")] if "author_name" in facts.columns else []
    bugfix = [F.max("is_bugfix").alias("is_bugfix")] if "is_bugfix" in facts.columns else []
    if in_path_order:
        facts = facts.repartitionByRange("repo", "file_path", "commit_hash")
    return facts.groupBy("repo", "file_path", "commit_hash").agg(
        *author,
        F.min("commit_date").alias("commit_date"),
        *bugfix,
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(lines_changed(F.col("lines_added"), F.col("lines_deleted"))).alias("lines"),
    )


def hot_files(rows: DataFrame) -> DataFrame:
    """Files of more than ``HOT_ROWS`` of the rows, facts or touches, which have to be stored. Stored, too."""
    counts = rows.groupBy("repo", "file_path").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.filter(F.col("n") > HOT_ROWS).select("repo", "file_path"), "hot")


def by_file(facts: DataFrame) -> DataFrame:
    """Stored facts, to be shuffled by file: folds by commit, author and file then all find their rows in place.

    If there are hot files the facts stay as they are, and each fold shuffles them by its own finer key.
    """
    return facts.repartition("repo", "file_path") if hot_files(facts).isEmpty() else facts


def dedupe_commit_file(facts: DataFrame) -> DataFrame:
    """Distinct (commit, file) with the commit's author and date."""
    return file_touches(facts).select("repo", "file_path", "commit_hash", "commit_date", "author_name")


def _bounds_from(last_change: Column) -> list[Column]:
    cutoff = last_change - F.make_interval(months=F.lit(CUTOFF_MONTHS))
    return [
        last_change.alias("ref_date"),
        cutoff.alias("cutoff"),
        (cutoff + F.make_dt_interval(days=F.lit(LABEL_DAYS))).alias("label_end"),
    ]


def history_bounds(facts: DataFrame) -> DataFrame:
    """Per repository: newest commit date, split cutoff and end of the label window."""
    newest = facts.groupBy("repo").agg(F.max("commit_date").alias("newest"))
    return newest.select("repo", *_bounds_from(F.col("newest")))


def repo_stats(touches: DataFrame) -> DataFrame:
    """``history_bounds`` plus row and commit counts, in one pass over ``file_touches``."""
    commits = touches.groupBy("repo", "commit_hash").agg(
        F.max("commit_date").alias("newest"), F.sum("n_rows").alias("n_rows")
    )
    return (
        commits.groupBy("repo")
        .agg(F.max("newest").alias("newest"), F.sum("n_rows").alias("n_rows"),
             F.count(F.lit(1)).alias("total_commits"))
        .select("repo", *_bounds_from(F.col("newest")), "n_rows", "total_commits")
    )


def settled_bounds(facts: DataFrame) -> DataFrame:
    """``history_bounds`` written once: of known size, it is attached without moving the rows it is attached to."""
    return materialize(history_bounds(facts), "bounds")


def anchor_to_ref(facts: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Attach the repository's time bounds to every row. ``bounds`` should be stored, as ``settled_bounds`` are."""
    bounds = settled_bounds(facts) if bounds is None else bounds
    return attach(
        facts, bounds.select("repo", "ref_date", "cutoff", "label_end"), on=["repo"]
    )


def history_sizes(facts: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Row count per repository and why it is rejected, if it is."""
    return facts.groupBy("repo").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "reason",
        F.when(F.col("n_rows") < min_rows, F.lit(f"not enough history: fewer than {min_rows} rows")),
    )


def enough_history(facts: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Facts of repositories with at least ``min_rows`` commit-file rows."""
    passing = materialize(history_sizes(facts, min_rows).filter(F.col("reason").isNull()).select("repo"), "passing")
    return attach(facts, passing, on=["repo"], how="inner")


def short_history(facts: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Rejected repositories with the reason."""
    return history_sizes(facts, min_rows).filter(F.col("reason").isNotNull())


def history_summary(labelled: DataFrame) -> DataFrame:
    """Commits, bug-fix commits and their share, per repository."""
    commits = labelled.groupBy("repo", "commit_hash").agg(F.max("is_bugfix").alias("is_bugfix"))
    counts = commits.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.count_if("is_bugfix").alias("bugfix_commits"),
    )
    return counts.withColumn("bugfix_pct", F.col("bugfix_commits") / F.col("total_commits") * 100)


def top_bugfix_files(labelled: DataFrame, k: int = 10) -> DataFrame:
    """Per repository the ``k`` files with most distinct bug-fix commits."""
    counts = (
        labelled.filter("is_bugfix")
        .select("repo", "file_path", "commit_hash").distinct()
        .groupBy("repo", "file_path").agg(F.count(F.lit(1)).alias("bugfix_commits"))
    )
    best_first = W.partitionBy("repo").orderBy(F.desc("bugfix_commits"), "file_path")
    return counts.withColumn("position", F.row_number().over(best_first)).filter(F.col("position") <= k)


def settled_stats(touches: DataFrame) -> DataFrame:
    """``repo_stats`` written once, for callers that attach it several times."""
    return materialize(repo_stats(touches), "repo_stats")
