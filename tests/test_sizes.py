"""What large histories rely on: rows lie by path, numbers travel in place of paths, nothing is stored or worked out twice."""
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks.queries import LEAVES, NOW
from conftest import rows_of
from test_features import brute_coupling, random_history
from tremorline.operators import activity as A
from tremorline.operators import boosting as B
from tremorline.operators import coupling as C
from tremorline.operators import history as H
from tremorline.operators import model as L
from tremorline.plans import rank_risk as plan
from tremorline.plans.feature_matrix import matrix_from_history
from tremorline.plans.refresh import refresh_ranking
from tremorline.session import DROP_SHUFFLES, materialize
from tremorline.sources import sample_tables
from tremorline.sources.run_store import RunStore


def shown(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in row]) for row in df.collect())


@pytest.fixture()
def no_sources(spark):
    return spark.createDataFrame([], "repo string, file_path string, source string")


def test_a_stored_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {disk.getAllFiles().apply(n).getName() for n in range(disk.getAllFiles().size())
                if disk.getAllFiles().apply(n).getName().startswith("shuffle")}

    before, kept = shuffles(), spark.conf.get(DROP_SHUFFLES, None)
    stored = materialize(spark.range(500).groupBy((F.col("id") % 50).alias("k")).count(), "counts")
    for _ in range(50):  # files may be removed a moment later
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and spark.conf.get(DROP_SHUFFLES, None) == kept
    assert stored.count() == 50


def test_touches_lie_in_path_order(make_facts):
    stored = materialize(H.file_touches(make_facts(random_history(5)).repartition(4), in_path_order=True), "touches")
    order = stored.select("repo", "file_path", "commit_hash", F.input_file_name().alias("file")).collect()
    by_file = {}
    for r in order:
        by_file.setdefault(r.file, []).append(tuple(r)[:3])
    assert all(rows == sorted(rows) for rows in by_file.values()) and len(by_file) > 1
    spans = sorted((rows[0], rows[-1]) for rows in by_file.values())
    assert all(earlier[1] < later[0] for earlier, later in zip(spans, spans[1:]))


def test_numbers_of_files_have_no_gaps(make_facts):
    touches = H.file_touches(make_facts(random_history(6)))
    numbers = C.file_numbers(touches).orderBy("repo", "file_path").collect()
    assert [r.file_no for r in numbers] == list(range(len(numbers)))
    assert sum(r.n_touches for r in numbers) == touches.count()


@pytest.mark.parametrize("hot_rows", [0, 12, 10**6])
def test_hot_files_give_the_same_features(make_facts, no_sources, monkeypatch, hot_rows):
    rows = random_history(7)
    expected = shown(matrix_from_history(make_facts(rows), no_sources))
    totals = {}
    for repo, _, _, _, _, file, added, deleted in rows:
        totals.setdefault(repo, {}).setdefault(file, 0)
        totals[repo][file] += added + deleted
    monkeypatch.setattr(H, "HOT_ROWS", hot_rows)
    facts = materialize(make_facts(rows).repartition(5), "facts")
    assert shown(matrix_from_history(facts, no_sources)) == expected
    own = H.by_file(facts)
    assert shown(A.churn_features(own)) == shown(A.churn_features(facts))
    assert shown(A.authorship_features(own)) == shown(A.authorship_features(facts))
    coupled = C.coupling_features(facts, A.churn_features(own), 4).collect()
    want = brute_coupling(rows, totals, 4)
    assert {(r["repo"], r["file_path"]): pytest.approx(tuple(r)[2:], abs=1e-12) for r in coupled} == want


def test_facts_gathered_by_file_are_shuffled_once(spark, make_facts):
    own = H.by_file(materialize(make_facts(random_history(4)), "facts"))
    for frame in (A.churn_features(own), A.authorship_features(own)):
        assert frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1


def test_partners_are_ranked_by_number(make_facts):
    facts = make_facts(random_history(9))
    edges = C.partner_edges(C.co_change_pairs(facts, 4))
    assert "f1#" not in C.top_partners(edges)._jdf.queryExecution().optimizedPlan().toString()
    columns = ("repo", "file_path", "position", "partner", "n_commits")
    by_path = C.top_partners(edges.select("*"))  # a frame that does not know its numbers
    assert rows_of(C.top_partners(edges), *columns) == rows_of(by_path, *columns)
    churn = A.churn_features(facts)
    flags = rows_of(C.coupled_high_churn(edges, churn), "repo", "file_path", "coupled_high_churn")
    assert flags == rows_of(C.coupled_high_churn(edges.select("*"), churn), "repo", "file_path", "coupled_high_churn")
    assert C.top_partners(edges).columns == by_path.columns


def test_results_nobody_asks_for_are_not_worked_out(make_facts, no_sources, monkeypatch):
    rng = random.Random(3)
    start = datetime(2023, 1, 1)
    records = make_facts([
        ("r", f"c{n:03d}", str(start + timedelta(days=n)), f"a{n % 5}", "fix" if n % 3 else "m", f"f{rng.randrange(30)}", 1, 2) for n in range(300)
    ]).selectExpr("*", "false as is_merge", "file_path as new_path", "file_path as old_path")
    found = plan.rank_risk(records, no_sources, fit=lambda matrix, _: L.score_with_leaves(matrix, LEAVES))
    with monkeypatch.context() as patch:
        patch.setattr(plan, "rank_files", None)
        assert found.metrics.count() == 1
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (found.metrics, found.spread)]
        assert not any("MapInPandas" in text for text in plans)  # scores are stored
    assert found.ranked.count() == found.judged.count() > 0


def test_requested_names_are_read_once(spark, tmp_path, no_sources):
    spark.createDataFrame([("r",)], "repo string").write.parquet(str(tmp_path / "asked"))
    store = RunStore(spark, str(tmp_path / "store"))
    records = spark.createDataFrame([], "repo string, commit_hash string, commit_date timestamp, is_merge boolean, author_name string, "
                                        "message string, old_path string, new_path string, lines_added bigint, lines_deleted bigint")
    store.publish("r0", {"ranked": spark.createDataFrame([("r", "f", 1.0)], "repo string, file_path string, risk_score double")},
                  spark.createDataFrame([("r",)], "repo string"), NOW)
    got = refresh_ranking(store, "r1", spark.read.parquet(str(tmp_path / "asked")), records, no_sources, now=NOW)
    assert got.ranked.count() == 1 and not any("/asked/" in f for f in got.ranked.inputFiles() if str(tmp_path) in f)


def test_passes_start_from_stored_margins(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("r", f"f{n}", rng.random(), rng.random(), int(rng.random() < 0.3), True) for n in range(600)]
    files = materialize(spark.createDataFrame(rows, "repo string, file_path string, a double, b double, label int, in_test boolean"), "files")

    def trained(**params):
        return L.Boosting(files, F.lit(2.0), L.BoostingParams(**params), ["a", "b"], F.lit(True), F.col("in_test"))

    one = trained().grow(5)
    for name, value in (("AHEAD_ROUNDS", 2), ("SUM_ROWS", 50), ("FEW_PIECES", 2), ("PIECE_ROWS", 100)):
        monkeypatch.setattr(B, name, value)
    many = trained(rows_per_task=200).grow(5)
    assert many.tasks == 3 and many.passed == 4 and many.settled == 0 and len(many.state.inputFiles()) == 4
    assert many.leaves() == one.leaves()
    assert shown(many.staged()) == shown(one.staged())
    assert many.settle().settled == 5 and many.grow(7).leaves() == one.grow(7).leaves()


def test_orders_meet_lines_before_parts(spark, tmp_path):
    """Keys that are null, repeated or without a partner give the rows that lines with paths, then orders, gave."""
    orders = [(1, 7, datetime(2024, 1, 1), "1-URGENT"), (1, 8, datetime(2024, 1, 2), None), (2, None, None, "2-HIGH"), (3, 9, datetime(2024, 1, 3), "5-LOW"), (None, 1, None, None)]
    lines = [(1, 10, 1, 5.0, 0.01, "R"), (1, 11, 7, None, 0.02, "R"), (1, None, 7, 6.5, None, "R"), (2, 10, 7, 1.0, 0.1, None), (None, 10, 2, 1.0, 0.1, "A"), (3, 99, 7, 2.0, 0.05, "R")]
    parts = [(10, "a b", "T X", 5), (10, "c", "T", 6), (11, None, "T", 1), (None, "n", "T", 1), (99, "z", "U", 3)]
    for name, rows, schema in (("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
                               ("lineitem", lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string"),
                               ("part", parts, "p_partkey long, p_name string, p_type string, p_size int")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sample_tables.order_history(spark, str(tmp_path))
    paths = spark.read.parquet(str(tmp_path / "part.parquet")).select(F.col("p_partkey").alias("l_partkey"), sample_tables._part_path().alias("path"))
    both = spark.read.parquet(str(tmp_path / "orders.parquet")).join(
        spark.read.parquet(str(tmp_path / "lineitem.parquet")).join(paths, "l_partkey", "left"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    gone = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    want = both.select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("commit_hash"), F.col("o_orderdate").alias("commit_date"), F.col("path").alias("old_path"),
                       F.when(gone, None).otherwise(F.col("path")).alias("new_path"), F.col("l_quantity").cast("bigint").alias("lines_added"),
                       F.round(F.col("l_discount") * 100).cast("bigint").alias("lines_deleted"))
    assert shown(got.select(want.columns)) == shown(want) and got.count() == want.count()
    own = got.filter("repo = 'repo2'")._jdf.queryExecution().optimizedPlan().toString()
    assert own.index("path") and own.find("p_partkey") > own.find("o_orderkey")
