"""Co-change coupling: which files change in the same commits."""
from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorline.operators import history as H
from tremorline.operators.history import file_touches, repo_stats
from tremorline.operators.scaling import attach, running_totals
from tremorline.schemas import COUPLING_FEATURES, KEYS
from tremorline.session import materialize

# Row limit of a commit, partners averaged, partners checked, quantile of high churn.
MAX_FILES = 30
MEAN_PARTNERS = 5
CHECKED_PARTNERS = 3
HIGH_CHURN_QUANTILE = 0.75
#: Size of a quantile sketch; the error of a rank is about 1.65 / k.
QUANTILE_SKETCH_K = 800


def commit_sizes(facts: DataFrame) -> DataFrame:
    """Commit-file rows of each commit, repeated files included; of facts, or of touches that count them."""
    rows = F.sum("n_rows") if "n_rows" in facts.columns else F.count(F.lit(1))
    return facts.groupBy("repo", "commit_hash").agg(rows.alias("n_rows"))


def mass_commit_filter(facts: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Commits small enough to pair up."""
    return commit_sizes(facts).filter(F.col("n_rows") <= max_files)


def mass_commit_report(facts: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Per repository: commits, and how many of them are skipped as mass commits."""
    return commit_sizes(facts).groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.count_if(F.col("n_rows") > max_files).alias("skipped_commits"),
    )


def commit_file_sets(touches: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Sorted distinct files of every commit of at most ``max_files`` rows.

    Only the first ``max_files + 1`` files of a commit are carried on. Spark applies that rank limit
    before the shuffle too, so a mass commit never arrives whole: reaching the limit already
    shows it is too large, and below the limit its rows are complete and can be counted.
    """
    by_name = W.partitionBy("repo", "commit_hash").orderBy("file_path")
    bounded = touches.withColumn("nth", F.row_number().over(by_name)).filter(F.col("nth") <= max_files + 1)
    return (
        bounded.groupBy("repo", "commit_hash")
        .agg(F.sum("n_rows").alias("n_rows"), F.sort_array(F.collect_list("file_path")).alias("files"))
        .filter(F.col("n_rows") <= max_files)
        .drop("n_rows")
    )


def numbered_commits(touches: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """``commit_file_sets`` with a number that rises with the hash."""
    return (
        commit_file_sets(touches, max_files)
        .repartitionByRange("repo", "commit_hash")
        .sortWithinPartitions("repo", "commit_hash")
        .select("repo", "files", F.monotonically_increasing_id().alias("commit_no"))
    )


def pairs_of(touches: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """File pairs ``f1 < f2`` with the commits they share; at most 435 pairs per commit of 30.

    ``first_commit`` orders pairs by the lowest hash they occur in. It is a number that rises with the
    hash, given to the commits before they are paired: the many pair rows then carry 8 bytes for it,
    and counting them needs no sort.
    """
    numbered = numbered_commits(touches, max_files)
    first = numbered.select("repo", "commit_no", "files", F.posexplode("files").alias("at", "f1"))
    both = first.select(
        "repo", "commit_no", "f1",
        F.explode(F.slice("files", F.col("at") + 2, F.lit(max_files))).alias("f2"),
    )
    return both.groupBy("repo", "f1", "f2").agg(
        F.count(F.lit(1)).alias("n_commits"), F.min("commit_no").alias("first_commit")
    )


def co_change_pairs(facts: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """File pairs of each repository with the number of commits they share. The same pairs are to be had by numbers (``_NumberedEdges``)."""
    pairs = pairs_of(file_touches(facts.drop("author_name")), max_files)
    pairs._numbered = _NumberedEdges(facts, max_files)
    return pairs


def partner_edges(pairs: DataFrame) -> DataFrame:
    """Each pair seen from both of its files."""
    sides = F.array(
        F.struct(F.col("f1").alias("file_path"), F.col("f2").alias("partner")),
        F.struct(F.col("f2").alias("file_path"), F.col("f1").alias("partner")),
    )
    edges = pairs.select("repo", F.inline(sides), "n_commits", "first_commit")
    edges._numbered = vars(pairs).get("_numbered")
    return edges


def _best_first() -> list[Column]:
    return [F.desc("n_commits"), F.col("first_commit"), F.col("partner")]


def top_partners(edges: DataFrame, k: int = MEAN_PARTNERS) -> DataFrame:
    """The ``k`` partners sharing most commits; ties go to the pair seen in the earlier hash, then by name.

    The rank limit runs before the shuffle as well, so popular files stay small. Edges that are to be had by numbers are ranked
    so, and only the partners found get their paths.
    """
    numbered = vars(edges).get("_numbered")
    if numbered is not None:
        return numbered.named(numbered.ranked(k))
    best_first = W.partitionBy(*KEYS).orderBy(*_best_first())
    return edges.withColumn("position", F.row_number().over(best_first)).filter(F.col("position") <= k)


def churn_threshold(churn: DataFrame, quantile: float = HIGH_CHURN_QUANTILE) -> DataFrame:
    """Exact, linearly interpolated quantile of total_lines_changed over a repository's files."""
    values = churn.groupBy("repo", "total_lines_changed").agg(F.count(F.lit(1)).alias("n_files"))
    ranked = running_totals(
        values, ["repo"], [F.col("total_lines_changed")], {"through": F.col("n_files")}
    )
    spot = F.lit(quantile) * (F.col("through_total") - 1)

    def value_at(position):
        held = (position < F.col("through")) & (position >= F.col("through") - F.col("n_files"))
        return F.max(F.when(held, F.col("total_lines_changed")))

    return (
        ranked.withColumn("spot", spot)
        .groupBy("repo")
        .agg(value_at(F.floor("spot")).alias("below"), value_at(F.ceil("spot")).alias("above"),
             F.max("spot").alias("spot"))
        .select("repo", (F.col("below") + (F.col("above") - F.col("below"))
                         * (F.col("spot") - F.floor("spot"))).alias("threshold"))
    )


def churn_threshold_approx(churn: DataFrame, quantile: float = HIGH_CHURN_QUANTILE, k: int = QUANTILE_SKETCH_K) -> DataFrame:
    """``churn_threshold`` from one mergeable sketch a repository: no order and nothing stored, a value of the data, not interpolated.

    Its rank is off by about 1.65 / k of the files (one standard error of the sketch is less).
    """
    sketch = F.kll_sketch_agg_bigint(F.col("total_lines_changed").cast("long"), F.lit(k))
    return churn.groupBy("repo").agg(sketch.alias("sketch")).select(
        "repo", F.kll_sketch_get_quantile_bigint("sketch", F.lit(quantile)).cast("double").alias("threshold"))


def high_churn_files(churn: DataFrame, quantile: float = HIGH_CHURN_QUANTILE, approximate: bool = False) -> DataFrame:
    """Files at or above their repository's churn quantile."""
    if approximate:  # one row a repository, from one pass: nothing is stored
        threshold = F.broadcast(churn_threshold_approx(churn, quantile))
    else:
        threshold = materialize(churn_threshold(churn, quantile), "threshold")
    return (
        attach(churn.select(*KEYS, "total_lines_changed"), threshold, on=["repo"])
        .filter(F.col("total_lines_changed") >= F.col("threshold"))
    )


def coupled_high_churn(edges: DataFrame, churn: DataFrame, k: int = CHECKED_PARTNERS) -> DataFrame:
    """1 for files with a high-churn file among their top ``k`` partners, else 0; files with partners only.

    Churn is stored first, as it is read twice.
    """
    churn = materialize(churn.select(*KEYS, "total_lines_changed"), "churn")
    numbered = vars(edges).get("_numbered")
    if numbered is None:
        return _coupled(top_partners(edges, k), churn)
    ranked = materialize(numbered.ranked(k).select("file_path", "partner"), "ranked")
    found = _coupled_numbers(ranked, churn, numbered.numbers)
    flags = ranked.select("file_path").distinct().join(found, "file_path", "left").withColumnRenamed("file_path", "file_no")
    return numbered.numbers.select(*KEYS, "file_no").join(flags, "file_no").select(
        *KEYS, F.coalesce("coupled_high_churn", F.lit(0)).alias("coupled_high_churn"))


def _coupled(ranked: DataFrame, churn: DataFrame) -> DataFrame:
    hot = high_churn_files(churn).select("repo", F.col("file_path").alias("partner"), F.lit(1).alias("hot"))
    return (
        attach(ranked, hot, on=["repo", "partner"])
        .groupBy(*KEYS)
        .agg(F.coalesce(F.max("hot"), F.lit(0)).alias("coupled_high_churn"))
    )


def file_numbers(touches: DataFrame) -> DataFrame:
    """A number for every file, rising with repository and path, so that numbers sort as paths do. Stored, as it is read several times.

    Numbers have no gaps, which keeps them short. ``n_touches`` counts the commits of a file.
    """
    files = touches.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_touches")).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    stored = materialize(files.withColumn("at", F.monotonically_increasing_id()), "file_numbers")
    # The number of a row is that of its task, times 2**33, and its place there: tasks are told where theirs begin.
    sizes = stored.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    begins = [0] * (1 + max((r["task"] for r in sizes), default=0))
    total = 0
    for r in sorted(sizes):
        begins[r["task"]], total = total, total + r["n"]
    begin = F.element_at(F.lit(begins).cast("array<bigint>"), (F.shiftright("at", 33) + 1).cast("int"))
    return stored.select(*KEYS, (begin + F.col("at").bitwiseAND(F.lit(2**33 - 1))).alias("file_no"), "n_touches")


def _by_number(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """``rows`` with the number of a file for its path."""
    return rows.join(numbers.select(*KEYS, "file_no"), KEYS, "left").withColumn("file_path", F.col("file_no")).drop("file_no")


def _edges_by_file(commits: DataFrame, numbers: DataFrame) -> list[DataFrame]:
    """``partner_edges`` of the pairs in numbered commits (see ``numbered_commits``): file_path, partner, n_commits, first_commit, all numbers.

    A commit goes to each of its files once, with the others as one array, and is taken apart and counted there: one shuffle of far fewer
    bytes than one of pairs and one of edges. The files of the second frame, of more than ``HOT_ROWS`` commits, would
    fill a task that way; their edges are counted by both files. No file is in both; where there is no such file, there is no second.
    """
    n_files, n_hot = numbers.agg(F.count(F.lit(1)), F.count_if(F.col("n_touches") > H.HOT_ROWS)).first()
    number = "int" if n_files < 2**31 else "bigint"
    sides = commits.filter(F.size("files") > 1).select(
        "commit_no", F.explode("files").alias("file_path"), F.col("files").cast(f"array<{number}>").alias("files"))
    sides = sides.withColumn("files", F.array_remove("files", F.col("file_path").cast(number)))
    hot = materialize(numbers.filter(F.col("n_touches") > H.HOT_ROWS).select(F.col("file_no").alias("file_path")), "hot") if n_hot else None
    common = sides if hot is None else sides.join(hot, "file_path", "left_anti")
    frames = [common.repartition("file_path")]
    if hot is not None:
        frames.append(sides.join(hot, "file_path", "left_semi"))
    return [
        frame.select("file_path", F.explode("files").alias("partner"), "commit_no")
        .groupBy("file_path", F.col("partner").cast("bigint").alias("partner")).agg(F.count(F.lit(1)).alias("n_commits"), F.min("commit_no").alias("first_commit"))
        for frame in frames
    ]


class _NumberedEdges:
    """The edges of facts by numbers of files (``_edges_by_file``), built and stored when first asked for.

    Edges with paths are many and wide: those who only want a few of each file rank them in this form.
    """

    def __init__(self, facts: DataFrame, max_files: int):
        self.facts, self.max_files = facts, max_files

    @cached_property
    def touches(self) -> DataFrame:
        return materialize(file_touches(self.facts.drop("author_name"), in_path_order=True).select(*KEYS, "commit_hash", "n_rows"), "touches")

    @cached_property
    def numbers(self) -> DataFrame:
        return file_numbers(self.touches)

    @cached_property
    def edges(self) -> list[DataFrame]:
        return _edges_by_file(numbered_commits(_by_number(self.touches, self.numbers), self.max_files), self.numbers)

    def ranked(self, k: int) -> DataFrame:
        """``top_partners``, by numbers."""
        position = F.row_number().over(W.partitionBy("file_path").orderBy(*_best_first()))
        return reduce(DataFrame.unionByName, [e.withColumn("position", position).filter(F.col("position") <= k) for e in self.edges])

    def named(self, ranked: DataFrame) -> DataFrame:
        """``ranked`` with repositories and paths."""
        files = self.numbers.select("file_no", *KEYS)
        partners = files.select(F.col("file_no").alias("partner"), F.col("file_path").alias("path"))
        return ranked.join(partners, "partner").withColumnsRenamed({"partner": "_no", "path": "partner", "file_path": "file_no"}).join(
            files, "file_no").select(*KEYS, "partner", "n_commits", "first_commit", "position")


def _coupled_numbers(checked: DataFrame, churn: DataFrame, numbers: DataFrame) -> DataFrame:
    """Numbers of the files with a high-churn file among their partners in ``checked``, with 1 as coupled_high_churn."""
    hot = _by_number(high_churn_files(churn).select(*KEYS), numbers).select(F.col("file_path").alias("partner"))
    return checked.join(hot, "partner", "left_semi").select("file_path").distinct().withColumn("coupled_high_churn", F.lit(1))


def _partners(edges: list[DataFrame]) -> DataFrame:
    """Per file number: partners, most commits shared, mean of the nearest, and numbers of those to check. Takes ``_edges_by_file``."""
    position = F.row_number().over(W.partitionBy("file_path").orderBy(*_best_first()))
    checked = F.when(F.col("position") <= CHECKED_PARTNERS, F.col("partner"))
    nearest = [F.avg(F.when(F.col("position") <= MEAN_PARTNERS, F.col("n_commits"))).alias("mean_commits"),
               F.collect_list(checked).alias("checked")]
    totals = [F.count(F.lit(1)).alias("unique_coupling_partners"), F.max("n_commits").alias("max_commits")]
    found = edges[0].withColumn("position", position).groupBy("file_path").agg(*totals, *nearest)
    for hot in edges[1:]:
        few = hot.withColumn("position", position).filter(F.col("position") <= MEAN_PARTNERS).groupBy("file_path").agg(*nearest)
        found = found.unionByName(hot.groupBy("file_path").agg(*totals).join(few, "file_path"))
    return found


def coupling_of(touches: DataFrame, churn: DataFrame, commits: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Coupling features of every file in ``churn``; ``commits`` has each repository's total_commits.

    Commits, pairs and edges, the most rows by far, carry the numbers of files in place of their paths.
    """
    numbers = file_numbers(touches)
    partners = materialize(_partners(_edges_by_file(numbered_commits(_by_number(touches, numbers), max_files), numbers)), "partners")
    coupled = _coupled_numbers(partners.select("file_path", F.explode("checked").alias("partner")), churn, numbers)
    by_number = partners.drop("checked").join(coupled, "file_path", "left").withColumnRenamed("file_path", "file_no")
    files = churn.select(*KEYS).join(numbers.select(*KEYS, "file_no"), KEYS, "left").join(by_number, "file_no", "left").drop("file_no")
    total = F.col("total_commits")
    return attach(files, commits.select("repo", "total_commits"), on=["repo"]).select(
        *KEYS,
        F.coalesce(F.col("mean_commits") / total, F.lit(0.0)).alias("coupling_score_mean"),
        F.coalesce(F.col("max_commits") / total, F.lit(0.0)).alias("coupling_score_max"),
        F.coalesce("coupled_high_churn", F.lit(0)).cast("bigint").alias("coupled_high_churn"),
        F.coalesce("unique_coupling_partners", F.lit(0)).cast("bigint").alias("unique_coupling_partners"),
    ).select(*KEYS, *COUPLING_FEATURES)


def coupling_features(facts: DataFrame, churn: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Mean and maximum coupling, high-churn coupling and partner count; zeros for files that change alone.

    The divisor counts all commits of the repository, skipped mass commits included. Touches and churn
    are stored first, as each is read more than once.
    """
    touches = materialize(
        file_touches(facts.select(*KEYS, "commit_hash", "commit_date", "lines_added", "lines_deleted"), in_path_order=True), "touches"
    )
    churn = materialize(churn.select(*KEYS, "total_lines_changed"), "churn")
    return coupling_of(touches, churn, repo_stats(touches), max_files)
