from pyspark.sql import functions as F

from conftest import rows_of
from tremorline.operators import report as R


def results(spark, rows):
    return spark.createDataFrame(rows, "repo string, file_path string, risk_score double")


def test_rank_files(spark):
    rows = [("hot", f"f{n:03d}", 50.0) for n in range(200)] + [("hot", "a", 90.0), ("s", "x", 1.0)]
    ranked = R.rank_files(results(spark, rows).repartition(5))
    got = rows_of(ranked, "repo", "rank", "file_path")
    assert got == [("hot", 1, "a")] + [("hot", n + 2, f"f{n:03d}") for n in range(200)] + [("s", 1, "x")]


def contributions(spark, rows):
    return spark.createDataFrame(
        rows, "repo string, file_path string, contributions array<struct<feature:string, value:double, phi:double>>")


def test_top_drivers_by_size_whatever_the_sign(spark):
    items = [("total_commits", 7.0, 0.1), ("author_entropy", 1.5, -0.9), ("file_age_days", 3.0, 0.5),
             ("churn_spike_ratio", 2.0, 0.5), ("is_high_complexity", 1.0, 0.0)]
    got = R.top_drivers(contributions(spark, [("r", "f", items), ("r", "none", [])]))
    assert dict((r["file_path"], r["top_drivers"]) for r in got.collect()) == {
        "f": ["author entropy: 1.50", "churn spike ratio: 2.0x", "file age: 3 days"], "none": []}


def test_global_importance(spark):
    frame = contributions(spark, [("r", "f", [("total_commits", 1.0, -3.0), ("author_entropy", 1.0, 1.0)]),
                                  ("r", "g", [("total_commits", 1.0, 1.0), ("author_entropy", 1.0, 0.0)])])
    assert rows_of(R.global_importance(frame), "rank", "feature", "mean_abs_phi") == [
        (1, "total_commits", 2.0), (2, "author_entropy", 0.5)]


def test_ranked_with_drivers_fills_gaps(spark):
    predictions = spark.createDataFrame([("r", "f", 0.1234), ("r", "g", 0.5)], "repo string, file_path string, probability double")
    drivers = spark.createDataFrame([("r", "f", ["x"])], "repo string, file_path string, top_drivers array<string>")
    features = spark.createDataFrame([("r", "f", 3, 2, 0.12345, 0.5)], "repo string, file_path string, total_commits long, "
                                     "commit_count_30d long, bus_factor_score double, coupling_score_max double")
    joined = R.ranked_with_drivers(predictions, drivers, features)
    got = {r["file_path"]: tuple(r)[2:] for r in joined.collect()}
    assert got == {"f": (12.3, ["x"], 3, 2, 0.1235, 0.5), "g": (50.0, [], 0, 0, 0.0, 0.0)}
    assert R.file_detail(joined, "f", "r").count() == 1 and R.file_detail(joined, "missing").count() == 0


def test_summaries_and_charts(spark):
    frame = results(spark, [("r", f"d/f{n:02d}", float(n * 5)) for n in range(20)])
    assert rows_of(R.risk_summary(frame), "files_analysed", "high_risk_files") == [(20, 6)]
    bars = sorted(R.risk_barchart_data(frame).collect(), key=lambda r: r["position"])
    assert [b["risk_score"] for b in bars] == [50.0 + 5 * n for n in range(10)]
    assert bars[-1]["label"] == "d/f19" and bars[-1]["colour"] == "#f85149" and bars[0]["colour"] == "#d29922"
    assert R.risk_barchart_data(frame.limit(3)).agg(F.max("position")).first()[0] == 3
    assert R.risk_treemap_data(frame.filter("false")).count() == 0
    same = spark.createDataFrame([("r", "f", 0.50001), ("r", "g", 0.5), ("s", "f", 0.1), ("s", "g", 0.2)],
                                 "repo string, file_path string, probability double")
    assert rows_of(R.prediction_spread(same), "repo", "distinct_probabilities", "uniform") == [("r", 1, True), ("s", 2, False)]
