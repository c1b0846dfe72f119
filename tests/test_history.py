from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from conftest import rows_of
from tremorline.operators import history as H
from tremorline.schemas import CHANGE_RECORDS


def records(spark, rows):
    """(repo, hash, day of January 2024, merge, old, new)"""
    full = [(r, h, datetime(2024, 1, d), m, "ann", "msg", old, new, 1, 1) for r, h, d, m, old, new in rows]
    return spark.createDataFrame(full, StructType(CHANGE_RECORDS.fields[:10]))


def test_commit_file_rows(spark):
    df = H.commit_file_rows(records(spark, [
        ("r", "1", 1, False, "a", "b"), ("r", "2", 2, False, "a", None),
        ("r", "3", 3, False, None, None), ("r", "4", 4, True, "m", "m"),
    ]))
    assert rows_of(df, "commit_hash", "file_path") == [("1", "b"), ("2", "a")]
    assert df.columns == ["repo", "commit_hash", "commit_date", "author_name", "message", "file_path",
                          "lines_added", "lines_deleted", "is_code_file"]


def test_the_whole_history_counts_unless_a_cap_is_given(spark):
    df = records(spark, [("r", f"{n:05d}", 1 + n % 28, False, "x", "x") for n in range(400)])
    assert H.commit_file_rows(df).count() == 400 and H.commit_file_rows(df, 7).count() == 7
    unsaid = df.withColumn("is_merge", F.when(F.col("commit_hash") > "00001", F.col("is_merge")))
    assert H.non_merge_changes(unsaid).count() == 400


def test_rows_of_a_commit_that_disagree_give_one_touch(make_facts):
    facts = make_facts([("r", "1", "2024-01-02 00:00:00", "ann", "m", "f"), ("r", "1", "2024-01-01 00:00:00", None, "m", "f"),
                        ("r", "1", "2024-01-02 00:00:00", "bob", "m", "f"), ("r", "2", "2024-01-03 00:00:00", None, "m", "f")])
    touches = H.file_touches(facts)
    assert rows_of(touches, "commit_hash", "author_name", "n_rows")[0] == ("1", "bob", 3)
    assert touches.count() == H.dedupe_commit_file(facts).count() == 2


def test_latest_commits_counts_commits_without_files_and_breaks_ties_by_hash(spark):
    df = records(spark, [
        ("r", "a", 3, False, None, None), ("r", "b", 2, False, "x", "x"), ("r", "b", 2, False, "y", "y"),
        ("r", "c", 2, False, "x", "x"), ("r", "d", 1, False, "x", "x"), ("s", "z", 1, False, "x", "x"),
    ])
    assert rows_of(H.latest_commits(df, 2), "repo", "commit_hash") == [("r", "a"), ("r", "c"), ("s", "z")]
    assert H.latest_commits(df, 3).count() == 5
    assert H.latest_commits(df, 100).count() == 6


def test_latest_commits_on_one_crowded_day(spark):
    df = records(spark, [("r", f"{n:03d}", 1, False, "x", "x") for n in range(120)])
    kept = rows_of(H.latest_commits(df, 50), "commit_hash")
    assert kept == [(f"{n:03d}",) for n in range(70, 120)]


def test_latest_commits_follows_the_walk_order_if_known(spark):
    df = records(spark, [("r", h, d, False, "x", "x") for h, d in (("a", 1), ("b", 2), ("c", 3))])
    walked = df.withColumn("commit_seq", F.expr("case commit_hash when 'a' then 0 when 'c' then 1 else 2 end"))
    assert rows_of(H.latest_commits(walked, 2), "commit_hash") == [("a",), ("c",)]


def test_history_bounds(make_facts):
    facts = make_facts([("r", "1", "2024-08-31 12:34:56", "a", "m", "f"), ("r", "0", "2023-01-01 00:00:00", "a", "m", "f")])
    row = H.history_bounds(facts).first()
    assert (row["ref_date"], row["cutoff"], row["label_end"]) == (
        datetime(2024, 8, 31, 12, 34, 56), datetime(2024, 2, 29, 12, 34, 56), datetime(2024, 3, 30, 12, 34, 56))


def test_enough_history_counts_rows(make_facts):
    rows = [("few", f"c{n}", "2024-01-01 00:00:00", "a", "m", "f") for n in range(99)]
    rows += [("wide", f"c{n % 3}", "2024-01-01 00:00:00", "a", "m", f"f{n}") for n in range(100)]
    facts = make_facts(rows)
    assert rows_of(H.enough_history(facts).select("repo").distinct(), "repo") == [("wide",)]
    assert rows_of(H.short_history(facts), "repo", "n_rows") == [("few", 99)]


def test_summary_and_top_files(make_facts):
    day = "2024-01-01 00:00:00"
    facts = make_facts([
        ("r", "1", day, "a", "fix x", "f"), ("r", "1", day, "a", "fix x", "g"), ("r", "2", day, "a", "fix", "g"),
        ("r", "3", day, "a", "add", "f"), ("r", "4", day, "a", None, "h"),
    ])
    assert rows_of(H.history_summary(facts), "total_commits", "bugfix_commits", "bugfix_pct") == [(4, 2, 50.0)]
    assert rows_of(H.top_bugfix_files(facts), "position", "file_path", "bugfix_commits") == [(1, "g", 2), (2, "f", 1)]


def test_as_of_is_exclusive(make_facts):
    facts = make_facts([("r", "1", "2024-01-01 00:00:00", "a", "m", "f"), ("r", "2", "2024-01-02 00:00:00", "a", "m", "f")])
    assert rows_of(H.history_before(facts, datetime(2024, 1, 2)), "commit_hash") == [("1",)]
    assert H.history_before(facts, None).count() == 2
