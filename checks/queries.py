"""Every operator as a query over the sample tables."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.functions import scalars as S
from tremorline.operators import activity as A
from tremorline.operators import complexity as X
from tremorline.operators import coupling as C
from tremorline.operators import evaluation as E
from tremorline.operators import history as H
from tremorline.operators import matrix as M
from tremorline.operators import model as L
from tremorline.operators import report as R
from tremorline.plans.feature_matrix import build_feature_matrix, matrix_from_history
from tremorline.plans.rank_risk import RiskAnalysis, rank_risk
from tremorline.plans.refresh import refresh_ranking, refresh_results
from tremorline.schemas import FEATURES, KEYS
from tremorline.session import SESSION_DEFAULTS, materialize, scratch_path
from tremorline.sources import sample_tables as T
from tremorline.sources import tables as IO
from tremorline.sources.run_store import HistoryStore, RunStore

PATIENCE = 5
SMALL_COMMIT = 8
LATEST = 1000
NOW = datetime(2024, 3, 1)


def _plain(df: DataFrame) -> DataFrame:
    """Doubles at six decimals, dates as microseconds, text lists as one text: comparable across engines."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(field.name), field.dataType.simpleString()
        if kind == "double":
            column = F.round(column, 6)
        elif kind == "timestamp":
            column = F.unix_micros(column)
        elif kind == "array<string>":
            column = F.array_join(column, " | ")
        elif kind == "int":
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _lines_known(records: DataFrame) -> DataFrame:
    """Commits without files have no line counts; -1 keeps the result columns whole numbers."""
    return records.fillna(-1, ["lines_added", "lines_deleted"])


class Inputs:
    """The base tables of one scale, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def records(self):
        return T.order_history(self.spark, self.sf_dir)

    @property
    def facts(self):
        return H.commit_file_rows(self.records, None)

    @property
    def labelled(self):
        return H.label_bugfix(self.facts)

    @property
    def event_records(self):
        return T.event_history(self.spark, self.sf_dir)

    @property
    def event_facts(self):
        return H.label_bugfix(H.commit_file_rows(self.event_records, None))

    @property
    def churn(self):
        return A.churn_features(self.facts)

    @property
    def sources(self):
        return T.part_sources(self.spark, self.sf_dir)

    @property
    def matrix(self):
        return matrix_from_history(self.labelled, self.sources)

    @property
    def scores(self):
        return T.document_scores(self.spark, self.sf_dir)

    @property
    def predictions(self):
        return T.formula_predictions(self.churn)

    @property
    def results(self):
        return self.predictions.select(
            *KEYS, S.risk_score(F.col("probability")).alias("risk_score")
        )

    @property
    def contributions(self):
        return T.formula_contributions(self.matrix)

    @property
    def stamped(self):
        """Results between zero and two days old at NOW."""
        age = F.make_dt_interval(secs=(F.col("total_lines_changed") * 400 % 172_800).cast("decimal(18,6)"))
        return self.churn.select(*KEYS, "total_lines_changed", (S.moment(NOW) - age).alias("computed_at"))


def _test(feature: str, lo: float, hi: float, cover: float) -> dict:
    return {"feature": FEATURES.index(feature), "lo": lo, "hi": hi, "cover_ratio": cover}


_ANY = float("inf")
#: Two small trees, so that SQL can state every score and attribution.
LEAVES = [
    {"tree_id": 0, "leaf_id": 1, "value": -0.625, "path": [_test("total_commits", -_ANY, 9.0, 0.5)]},
    {"tree_id": 0, "leaf_id": 2, "value": 0.375,
     "path": [_test("total_commits", 9.0, _ANY, 0.5), _test("bus_factor_score", -_ANY, 0.1875, 0.75)]},
    {"tree_id": 0, "leaf_id": 3, "value": 0.875,
     "path": [_test("total_commits", 9.0, _ANY, 0.5), _test("bus_factor_score", 0.1875, _ANY, 0.25)]},
    {"tree_id": 1, "leaf_id": 1, "value": -0.1875, "path": [_test("file_age_days", -_ANY, 1500.0, 0.375)]},
    {"tree_id": 1, "leaf_id": 2, "value": 0.3125, "path": [_test("file_age_days", 1500.0, _ANY, 0.625)]},
]


def run_analysis(inputs: Inputs) -> RiskAnalysis:
    """The whole analysis with all its boosting rounds."""
    return rank_risk(inputs.records, inputs.sources)


def analysis_by_leaves(i: Inputs) -> RiskAnalysis:
    return rank_risk(i.records, i.sources, fit=lambda matrix, _: L.score_with_leaves(matrix, LEAVES))


BOOSTED = ["total_commits", "file_age_days"]
TWO_ROUNDS = L.BoostingParams(rounds=2, depth=2, row_share=1.0, column_share=1.0)


def two_factors(i: Inputs):
    """Files labelled by two features together, in whole steps, so that SQL can state every split."""
    commits, age = F.least("total_commits", F.lit(20)), F.floor(F.col("file_age_days") / 100)
    return i.churn.select(*KEYS, commits.alias("total_commits"), age.alias("file_age_days"),
                          ((commits >= 10) != (age % 7 == 3)).cast("int").alias("label"), F.lit(True).alias("in_test"))


def boosted(i: Inputs):
    """Trees of two rounds and two levels, positives weighted twice, and their scores of every file."""
    files = materialize(two_factors(i), "two_factors")
    return files, L.score_files(L.train_model(files, F.lit(2.0), TWO_ROUNDS, BOOSTED), files, BOOSTED)


def train_model(i: Inputs):
    files, scored = boosted(i)
    return scored.join(files, KEYS).select(*KEYS, (F.col("probability") > 0.5).cast("int").alias("predicted"), "label")


def auc_by_round(i: Inputs):
    orders = T.table(i.spark, i.sf_dir, "orders")
    return orders.groupBy((F.col("o_orderkey") % 3).cast("string").alias("repo"), (F.col("o_orderkey") % 60).cast("int").alias("tree_id")).agg(
        (F.sum("o_custkey") % 997 / 997.0).alias("auc_roc"))


def refreshed(i: Inputs):
    """Three repositories are asked for: kept results of two are fresh, those of one are a day too old."""
    age = F.make_dt_interval(hours=F.when(F.col("repo") == "repo2", 48).otherwise(1))
    kept = i.results.select(*KEYS, F.lit(-1.0).alias("risk_score"), (S.moment(NOW) - age).alias("computed_at"))

    def compute(stale):
        facts = H.commit_file_rows(i.records.join(stale, "repo", "left_semi"))
        return T.formula_predictions(A.churn_features(facts)).select(*KEYS, S.risk_score(F.col("probability")).alias("risk_score"))

    return refresh_results(i.facts.select("repo"), kept, compute, NOW).select(*KEYS, "risk_score")


def _refreshed(i: Inputs, delta: bool):
    """Two of three repositories were analysed an hour ago, the third has no results: it is analysed now, by the kept model.

    With ``delta`` all three were analysed two days ago, from the older commits; now they are given all, and add the new ones.
    """
    store = RunStore(i.spark, scratch_path(i.spark, "store"))
    repos = materialize(i.facts.select("repo").distinct(), "repos")  # read by both runs
    store.keep_model("r0", L.leaf_frame(i.spark, LEAVES).selectExpr("'*' as repo", "*", "true as kept"),
                     i.spark.createDataFrame([("*", 1, 0.5)], L.BEST_ROUND), NOW)
    if delta:
        history, before = HistoryStore(i.spark, store.path), i.records.filter("commit_date < '2001-01-01'")
        refresh_ranking(store, "r1", repos, before, i.sources, now=NOW - timedelta(days=2), history=history)
        return refresh_ranking(store, "r2", repos, i.records, i.sources, now=NOW, history=history)
    refresh_ranking(store, "r1", repos.filter("repo != 'repo2'"), i.records, i.sources, now=NOW - timedelta(hours=1))
    return refresh_ranking(store, "r2", repos, i.records, i.sources, now=NOW)


def read_change_records(i: Inputs):
    path = scratch_path(i.spark, "records")
    i.records.write.json(path)
    return _lines_known(IO.read_change_records(i.spark, path, "json").drop("commit_seq", "utc_offset"))


def read_change_records_csv(i: Inputs):
    """Messages with line breaks, commas and doubled quotes, as commit messages have them."""
    path = scratch_path(i.spark, "records")
    text = F.concat(F.coalesce("message", F.lit("none")), F.lit(', first line\nsaid "fix", twice ""\n\nend'))
    i.records.withColumn("message", text).write.options(header=True, escape='"').csv(path)
    return _lines_known(IO.read_change_records(i.spark, path, "csv").drop("commit_seq", "utc_offset"))


def read_source_files(i: Inputs):
    path = scratch_path(i.spark, "sources")
    i.sources.write.parquet(path)
    return IO.read_source_files(i.spark, path)


def read_history(i: Inputs):
    path = scratch_path(i.spark, "history")
    IO.write_history(i.facts, path)
    return IO.read_history(i.spark, path, ["repo0", "repo2"])


def write_results(i: Inputs):
    path = scratch_path(i.spark, "results")
    IO.write_results(i.results, path, NOW)
    return IO.read_results(i.spark, path)


def stale_repos(i: Inputs):
    repos = i.facts.select("repo").distinct()
    age = F.make_dt_interval(hours=F.substring("repo", 5, 1).cast("int") * 12)
    kept = repos.withColumn("computed_at", S.moment(NOW) - age)
    return IO.stale_repos(repos, kept, NOW)


def utc_commit_date(i: Inputs):
    orders = T.table(i.spark, i.sf_dir, "orders")
    offset = F.when(F.col("o_orderkey") % 2 == 0, "+02:00")
    return orders.select(
        "o_orderkey", S.utc_commit_date(F.col("o_orderdate"), offset).alias("commit_date")
    )


def repo_slug(i: Inputs):
    url = T.table(i.spark, i.sf_dir, "pages")
    return url.select("page_id", "url", S.repo_slug(F.col("url")).alias("s"), S.repo_display_name(F.col("url")).alias("display")).select(
        "page_id", "s.*", "display"
    )


def graded(i: Inputs, explained: str = "true"):
    matrix = materialize(i.matrix, "matrix")
    drivers = R.top_drivers(T.formula_contributions(matrix.filter(explained)))
    return R.ranked_with_drivers(T.formula_predictions(matrix), drivers, matrix)


def file_detail(i: Inputs):
    results = materialize(graded(i), "graded")  # read twice
    return R.file_details(results, results.filter(F.col("risk_score") >= 90))


def one_file_detail(i: Inputs):
    first = T.table(i.spark, i.sf_dir, "part").filter(F.col("p_partkey") == 0).select(T._part_path()).first()[0]
    return R.file_detail(graded(i), first)


def driver_text(i: Inputs):
    rows = R.attribution_rows(i.contributions)
    return rows.select(*KEYS, "feature", R.driver_text(F.col("feature"), F.col("value")).alias("driver"))


def complexity_grade(i: Inputs):
    measured = X.file_complexity(i.sources)
    mean = F.col("cyclomatic_complexity")
    return measured.select(*KEYS, S.complexity_grade(mean).alias("complexity_rank"),
                           S.high_complexity(mean).alias("is_high_complexity"))


def in_path_order(facts: DataFrame) -> DataFrame:
    """Facts for storing: those of a file side by side, so that they are folded where they are read."""
    by = (*KEYS, "commit_hash")
    return facts.repartitionByRange(*by).sortWithinPartitions(*by)


def coupled_edges(i: Inputs):
    return C.partner_edges(C.co_change_pairs(i.facts, SMALL_COMMIT))


def coupled_high_churn(i: Inputs):
    """Edges and churn from one stored history."""
    stored = materialize(in_path_order(i.facts.select(*KEYS, "commit_hash", "commit_date", "lines_added", "lines_deleted")), "facts")
    edges = C.partner_edges(C.co_change_pairs(stored, SMALL_COMMIT))
    return C.coupled_high_churn(edges, A.churn_features(H.by_file(stored))).select(*KEYS, "coupled_high_churn")


def near_quantile(i: Inputs):
    """Whether the rank of each repository's sketched threshold is within a hundredth of the quantile."""
    value, limit = F.col("total_lines_changed"), F.col("threshold")
    churn = materialize(i.churn.select("repo", "total_lines_changed"), "churn")
    ranked = churn.join(materialize(C.churn_threshold_approx(churn), "threshold"), "repo").groupBy("repo").agg(
        F.avg((value < limit).cast("int")).alias("below"), F.avg((value <= limit).cast("int")).alias("through"))
    return ranked.select("repo", ((F.col("below") - 0.01 <= C.HIGH_CHURN_QUANTILE) & (F.col("through") + 0.01 >= C.HIGH_CHURN_QUANTILE)).alias("near"))


def separate_matrix(i: Inputs):
    """Every frame from one stored history and one stored churn."""
    facts = materialize(in_path_order(i.labelled.drop("message", "is_code_file")), "facts")
    bounds = H.settled_bounds(facts)
    own = H.by_file(facts)
    churn = materialize(A.churn_features(own, bounds), "churn")
    return build_feature_matrix(
        facts, churn, C.coupling_features(facts, churn), A.authorship_features(own, bounds),
        X.complexity_features(churn, i.sources),
    )


def merged_features(i: Inputs):
    """Frames that cover different files, so that the outer merge has gaps to fill."""
    churn = i.churn
    return M.feature_matrix(
        churn.filter("total_commits % 2 = 0"), A.authorship_features(i.facts).filter("unique_authors_total % 3 > 0"),
        X.complexity_features(i.facts, i.sources).filter("complexity_rank > 1"),
    )


def event_fallback(i: Inputs):
    matrix = M.labelled_matrix(A.split_flags(i.event_facts), A.churn_features(i.event_facts))
    return L.constant_fallback(matrix, L.class_balance(matrix)).select(*KEYS, "probability")


SPECS = {
    # sources and sinks
    "read_change_records": read_change_records,
    "read_change_records_csv": read_change_records_csv,
    "read_source_files": read_source_files,
    "read_history": read_history,
    "write_results": write_results,
    "fresh_results": lambda i: IO.fresh_results(i.stamped, NOW),
    "stale_repos": stale_repos,
    "refresh_results": refreshed,
    # history
    "non_merge_changes": lambda i: _lines_known(H.non_merge_changes(i.records)),
    "resolve_path": lambda i: i.records.select(
        "repo", "commit_hash", S.resolve_path(F.col("new_path"), F.col("old_path")).alias("file_path")
    ).filter("file_path is not null"),
    "code_file_flag": lambda i: i.facts.select("repo", "file_path", "is_code_file").distinct(),
    "utc_commit_date": utc_commit_date,
    "commit_file_rows": lambda i: i.facts,
    "latest_commits": lambda i: _lines_known(H.latest_commits(H.non_merge_changes(i.records), LATEST)),
    "label_bugfix": lambda i: i.labelled.select("repo", "commit_hash", "message", "is_bugfix").distinct(),
    "label_bugfix_events": lambda i: i.event_facts.select("repo", "commit_hash", "is_bugfix"),
    "lines_changed": lambda i: i.facts.select(
        "repo", "commit_hash", "file_path",
        S.lines_changed(F.col("lines_added"), F.col("lines_deleted")).alias("lines_changed"),
    ),
    "history_bounds": lambda i: H.history_bounds(i.facts),
    "history_order": lambda i: H.history_order(i.facts),
    "anchor_to_ref": lambda i: H.anchor_to_ref(i.facts).select("repo", "commit_hash", "file_path", "ref_date", "cutoff"),
    "dedupe_commit_file": lambda i: H.dedupe_commit_file(i.facts),
    "enough_history": lambda i: H.enough_history(i.event_facts, 3300),
    "short_history": lambda i: H.short_history(i.event_facts, 3334),
    "history_summary": lambda i: H.history_summary(i.labelled),
    "top_bugfix_files": lambda i: H.top_bugfix_files(i.labelled),
    # labels for people
    "repo_slug": repo_slug,
    "shorten_path": lambda i: i.facts.select("file_path", S.shorten_path(F.col("file_path")).alias("label")).distinct(),
    "risk_band": lambda i: R.risk_bands(i.results),
    "risk_score": lambda i: i.results,
    "driver_text": driver_text,
    # churn
    "churn_windows": lambda i: A.churn_windows(i.facts),
    "churn_spike": lambda i: A.churn_spike(A.churn_windows(i.facts)),
    "lifetime_activity": lambda i: A.lifetime_activity(i.facts),
    "churn_features": lambda i: i.churn,
    "churn_features_as_of": lambda i: A.churn_features(i.facts, as_of=datetime(2000, 1, 1)),
    "churn_features_events": lambda i: A.churn_features(i.event_facts),
    # authorship
    "author_counts": lambda i: A.author_counts(i.facts),
    "unique_authors": lambda i: A.unique_authors(i.facts),
    "unique_authors_approx": lambda i: A.unique_authors_approx(A.author_sketches(i.facts), H.history_bounds(i.facts)),
    "bus_factor": lambda i: A.bus_factor(i.facts),
    "author_entropy": lambda i: A.author_entropy(i.facts),
    "authorship_features": lambda i: A.authorship_features(i.facts),
    "authorship_features_events": lambda i: A.authorship_features(i.event_facts),
    # coupling
    "mass_commit_filter": lambda i: C.mass_commit_filter(i.facts, SMALL_COMMIT),
    "mass_commit_report": lambda i: C.mass_commit_report(i.facts, SMALL_COMMIT),
    "co_change_pairs": lambda i: C.co_change_pairs(i.facts).drop("first_commit"),
    "co_change_pairs_small": lambda i: C.co_change_pairs(i.facts, SMALL_COMMIT).drop("first_commit"),
    "partner_edges": lambda i: coupled_edges(i).drop("first_commit"),
    "top_partners": lambda i: C.top_partners(C.partner_edges(C.co_change_pairs(i.facts))).drop("first_commit"),
    "churn_threshold": lambda i: C.churn_threshold(i.churn),
    "churn_threshold_approx": near_quantile,
    "high_churn_files": lambda i: C.high_churn_files(i.churn).select(*KEYS),
    "coupled_high_churn": coupled_high_churn,
    "coupling_features": lambda i: C.coupling_features(i.facts, i.churn),
    "coupling_features_small": lambda i: C.coupling_features(i.facts, i.churn, SMALL_COMMIT),
    # complexity
    "file_complexity": lambda i: X.file_complexity(i.sources),
    "complexity_grade": complexity_grade,
    "complexity_left": lambda i: X.complexity_left(i.facts, X.file_complexity(i.sources)),
    "complexity_features": lambda i: X.complexity_features(i.facts, i.sources),
    # matrix
    "feature_matrix": merged_features,
    "canonical_features": lambda i: M.canonical_features(A.authorship_features(i.facts).join(i.churn, KEYS)),
    "label_files": lambda i: A.label_files(i.labelled),
    "temporal_split": lambda i: A.temporal_split(i.facts),
    "split_report": lambda i: M.split_report(A.split_flags(i.labelled)),
    "build_feature_matrix": separate_matrix,
    "matrix_from_history": lambda i: i.matrix,
    # evaluation
    "score_curve": lambda i: E.score_curve(i.scores).select("repo", "score", "tp", "fp"),
    "roc_auc": lambda i: E.roc_auc(E.score_curve(i.scores)),
    "average_precision": lambda i: E.average_precision(E.score_curve(i.scores)),
    "pr_curve": lambda i: E.pr_curve(E.score_curve(i.scores)),
    "evaluate_model": lambda i: E.evaluate_model(i.scores),
    "classification_report": lambda i: E.classification_report(i.scores),
    # model
    "class_balance": lambda i: L.class_balance(A.split_flags(i.labelled)),
    "constant_fallback": event_fallback,
    "train_model": train_model,
    "best_iteration": lambda i: L.best_iteration(auc_by_round(i), PATIENCE),
    "score_files": lambda i: boosted(i)[1],
    "tree_attributions": lambda i: R.attribution_rows(L.score_with_leaves(materialize(i.matrix, "matrix"), LEAVES).scored),
    "explain_predictions": lambda i: L.explain_predictions(i.contributions)[0],
    # results
    "rank_files": lambda i: R.rank_files(i.results),
    "top_drivers": lambda i: R.top_drivers(i.contributions),
    "global_importance": lambda i: R.global_importance(i.contributions),
    "ranked_with_drivers": lambda i: graded(i, "file_path like '%.py'"),
    "file_detail": file_detail,
    "file_detail_by_path": one_file_detail,
    "risk_summary": lambda i: R.risk_summary(i.results),
    "prediction_spread": lambda i: R.prediction_spread(i.predictions),
    "risk_barchart_data": lambda i: R.risk_barchart_data(i.results),
    "risk_treemap_data": lambda i: R.risk_treemap_data(i.results),
    # end to end
    "rank_risk": lambda i: analysis_by_leaves(i).ranked,
    "risk_metrics": lambda i: analysis_by_leaves(i).metrics,
    "refresh_ranking": lambda i: _refreshed(i, False).ranked.drop("computed_at"),
    "refresh_metrics": lambda i: _refreshed(i, False).metrics.drop("computed_at"),
    "refresh_from_delta": lambda i: _refreshed(i, True).ranked.drop("computed_at"),
    "rank_risk_trained": lambda i: run_analysis(i).ranked,
}


def _ready(spec):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for key in ("spark.sql.session.timeZone", "spark.sql.sources.partitionOverwriteMode"):
            spark.conf.set(key, SESSION_DEFAULTS[key])
        return _plain(spec(Inputs(spark, sf_dir)))

    return query


QUERIES = {name: _ready(spec) for name, spec in SPECS.items()}
