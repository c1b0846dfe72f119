import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import rows_of
from tremorline.sources import tables as IO


def test_malformed_records_are_left_out(spark, tmp_path):
    good = {"repo": "r", "commit_hash": "1", "commit_date": "2024-01-01T10:00:00Z", "is_merge": False, "old_path": "a"}
    lines = [json.dumps(good), "{broken", json.dumps({**good, "commit_hash": None}),
             json.dumps({**good, "commit_hash": "2", "lines_added": 4})]
    (tmp_path / "in.json").write_text("\n".join(lines))
    path = str(tmp_path / "in.json")
    df = IO.read_change_records(spark, path, "json")
    assert rows_of(df.select("commit_hash", F.coalesce("lines_added", F.lit(-1)).alias("n")), "commit_hash", "n") == [("1", -1), ("2", 4)]
    rejected = [r["record"] for r in IO.rejected_change_records(spark, path, "json").collect()]
    assert len(rejected) == 2 and "{broken" in rejected and any('"commit_date"' in r for r in rejected)


def test_csv_and_parquet_records(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        "repo,commit_hash,commit_date,is_merge,author_name,message,old_path,new_path,lines_added,lines_deleted\n"
        "r,1,2024-01-01 10:00:00,false,ann,hi,a,b,1,2\nr,2,2024-01-01 10:00:00,false,ann,hi,a,b,many,2\n")
    df = IO.read_change_records(spark, str(tmp_path / "in.csv"), "csv")
    assert rows_of(df, "commit_hash", "lines_added") == [("1", 1)]
    df.write.parquet(str(tmp_path / "p"))
    assert IO.read_change_records(spark, str(tmp_path / "p")).count() == 1


def _csv(rows):
    quoted = lambda v: "" if v is None else '"' + str(v).replace('"', '""') + '"'
    return "\n".join(",".join(map(quoted, r)) for r in rows) + "\n"


def test_accepted_and_rejected_are_the_input(spark, tmp_path):
    names = ["commit_hash", "repo", "commit_date", "message", "is_merge", "lines_added", "utc_offset", "commit_seq"]
    rows = [["1", "r", "2024-01-01 10:00:00", 'line one\nsay ""fix"", now', "false", 3, "+02:00", 0],
            ["2", "r", "2024-01-01 11:00:00", "plain", None, None, None, None],
            ["3", "r", "2024-01-01 12:00:00", "bad number", "false", "many", None, None],
            [None, "r", "2024-01-01 12:00:00", "no hash", "false", 1, None, None],
            ["5", "r", "not a date", "multi\nline", "false", 1, None, None]]
    (tmp_path / "in.csv").write_text(_csv([names, *rows]) + "6,r,2024-01-01 10:00:00,too many,false,1,,,extra\n")
    (tmp_path / "in.json").write_text("\n".join(json.dumps({k: v != "false" and v for k, v in zip(names, r) if v is not None}) for r in rows[:2])
                                      + '\n{"repo": "r"}\nbroken\n{"repo":"r","commit_hash":"9","commit_date":"2024-01-01","lines_added":"many"}\n')
    for name, size, accepted in (("csv", 6, 2), ("json", 5, 2)):
        path = str(tmp_path / f"in.{name}")
        df, rejected = IO.read_change_records(spark, path, name), IO.rejected_change_records(spark, path, name)
        assert df.count() == len(df.collect()) == df.select("commit_hash").count() == df.select("message").count() == accepted
        assert rejected.count() == len(rejected.collect()) == size - accepted
    df = IO.read_change_records(spark, str(tmp_path / "in.csv"), "csv")
    first = df.filter("commit_hash = '1'").first()
    assert (first["message"], first["utc_offset"], first["commit_seq"]) == ('line one\nsay ""fix"", now', "+02:00", 0)
    from tremorline.operators.history import commit_file_rows
    with_path = df.withColumn("new_path", F.lit("a.py"))
    assert [str(r[0]) for r in commit_file_rows(with_path).orderBy("commit_hash").select("commit_date").collect()] == [
        "2024-01-01 08:00:00", "2024-01-01 11:00:00"]


def test_source_tree_keeps_paths_and_drops_bad_bytes(spark, tmp_path):
    for repo, name, raw in (("r", "src/a b.py", b"x = '\xff\xc3\xa9'"), ("r", "note.md", b"text"), ("s", "b.py", b"y")):
        file = tmp_path / "tree" / repo / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(raw)
    got = rows_of(IO.read_source_files(spark, str(tmp_path / "tree"), "files"), "repo", "file_path", "source")
    assert got == [("r", "src/a b.py", "x = 'é'"), ("s", "b.py", "y")]


def test_history_is_replaced_per_repository(spark, make_facts, tmp_path):
    path = str(tmp_path / "history")
    day = "2024-01-01 00:00:00"
    first = make_facts([("r", "1", day, "a", "m", "f"), ("007", "2", day, "a", "m", "f")]).withColumn("is_code_file", F.lit(True))
    IO.write_history(first.drop("is_bugfix"), path)
    second = make_facts([("r", "9", day, "a", "m", "g")]).withColumn("is_code_file", F.lit(True))
    IO.write_history(second.drop("is_bugfix"), path)
    assert rows_of(IO.read_history(spark, path), "repo", "commit_hash") == [("007", "2"), ("r", "9")]
    only = IO.read_history(spark, path, ["007"])
    assert rows_of(only, "repo") == [("007",)]
    files = [f for f in only.inputFiles()]
    assert files and all("repo=007" in f for f in only.select("repo", F.input_file_name().alias("f")).toPandas()["f"])
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "repo" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_results_and_their_age(spark, tmp_path):
    path, now = str(tmp_path / "results"), datetime(2024, 5, 2)
    for repo, age in (("01", 86_399), ("b", 86_400)):
        frame = spark.createDataFrame([(repo, "f", 1.0)], "repo string, file_path string, risk_score double")
        IO.write_results(frame, path, now - timedelta(seconds=age))
    kept = IO.read_results(spark, path)
    assert rows_of(IO.fresh_results(kept, now), "repo") == [("01",)]
    asked = spark.createDataFrame([("01",), ("b",), ("new",)], "repo string")
    assert rows_of(IO.stale_repos(asked, kept, now), "repo") == [("b",), ("new",)]
    assert IO.read_results(spark, path, ["b"]).count() == 1
