"""Records of CSV files that many tasks read, against Spark's own reader, which reads such a file in one."""
import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremorline.sources.csv_records import csv_records, csv_rows, ends_inside
from tremorline.sources.tables import read_change_records, rejected_change_records

HEADER = ["repo", "message", "n"]


def _written(rows, end):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([HEADER, *rows])
    return out.getvalue()


@pytest.fixture()
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _rows(n, seed):
    draw = random.Random(seed)
    parts = ["plain", "a,b", 'say "x"', "line\nbreak", "\n\n", '"', "tail\n", "été", "long " * 30, "", "a\r\nb", ',"\n",']
    return [(f"r{i}", "".join(draw.choices(parts, k=draw.randint(1, 6))), str(i)) for i in range(n)]


def test_equals_one_task_reader(spark, small_blocks, tmp_path):
    for seed in range(3):
        (tmp_path / f"f{seed}.csv").write_text(_written(_rows(400, seed), "\n"), newline="")
    found = csv_rows(spark, str(tmp_path), HEADER, "_bad")
    expected = spark.read.schema("repo string, message string, n string, _bad string").options(
        header=True, multiLine=True, quote='"', escape='"', lineSep="\n", columnNameOfCorruptRecord="_bad", columnPruning=False).csv(str(tmp_path))
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_line_ends_of_two_characters(spark, small_blocks, tmp_path):
    """Texts stay as they are in the file, where the one-task reader turns the line breaks inside them into its own."""
    rows = _rows(600, 7)
    (tmp_path / "f.csv").write_text(_written(rows, "\r\n"), newline="")
    found = csv_rows(spark, str(tmp_path), HEADER, "_bad").collect()
    assert sorted((r.repo, r.message or "", r.n) for r in found) == sorted(rows) and not any(r["_bad"] for r in found)


def test_record_over_many_blocks(spark, small_blocks, tmp_path):
    rows = [("a", "x\n" * 9000, "1"), ("b", "y", "2"), ("c", "z,\n" * 3000 + '"', "3")]
    (tmp_path / "f.csv").write_text(_written(rows, "\n"), newline="")
    found = {r.repo: r for r in csv_rows(spark, str(tmp_path), HEADER, "_bad").collect()}
    assert {k: (v.message, v.n) for k, v in found.items()} == {a: (b, c) for a, b, c in rows}


def test_accepted_and_rejected_are_the_input(spark, small_blocks, tmp_path):
    lines = ["repo,commit_hash,commit_date,lines_added,message"]
    for i in range(600):
        lines.append(f'r{i % 3},h{i},2024-01-0{i % 9 + 1} 00:00:00,{i if i % 7 else "many"},"first ""{i}""\nsecond, line"')
        if i % 50 == 0:
            lines += ["too,few", "", f"r,h{i}x,2024-01-01 00:00:00,1,m,more"]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "f.csv")
    accepted, rejected = read_change_records(spark, path, "csv", split=True), rejected_change_records(spark, path, "csv", split=True)
    assert accepted.count() == sum(1 for i in range(600) if i % 7)
    for cut, whole in ((accepted, read_change_records(spark, path, "csv")), (rejected, rejected_change_records(spark, path, "csv"))):
        assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    assert rejected.count() == 24 + sum(1 for i in range(600) if i % 7 == 0)
    assert accepted.filter(F.col("message").rlike("^first \"[0-9]+\"\nsecond, line$")).count() == accepted.count()


def test_edges(spark, tmp_path):
    for name, text in {"empty": "", "header": "repo,message,n\n", "blank": "\n\nrepo,message,n\n\na,b,1\n\n", "open": 'repo,message,n\na,"b\nc,d,e\n'}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    count = lambda name: [r.record for r in csv_records(spark, str(tmp_path / f"{name}.csv")).filter("record != ''").collect()]
    assert count("empty") == count("header") == []
    assert count("blank") == ["a,b,1"]
    assert count("open") == ['a,"b\nc,d,e']


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a",\n', max_size=14), st.booleans())
def test_state_of_a_line(text, inside):
    """Character by character, in plain steps."""
    line, state, fresh, at = text.replace("\n", ""), "in" if inside else "start", True, 0
    while at < len(line):
        c = line[at]
        if state == "in" and c == '"':
            if line[at + 1:at + 2] == '"':
                at += 1
            else:
                state = "plain"
        elif state == "start" and c == '"':
            state = "in"
        elif state != "in":
            state = "start" if c == "," else "plain"
        at += 1
    assert ends_inside(line, inside) == (state == "in")
