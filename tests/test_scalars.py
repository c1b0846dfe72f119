import random

import pytest
from pyspark.sql import functions as F

from tremorline.functions import scalars as S
from tremorline.operators.report import DRIVER_TEXTS, driver_text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_label_bugfix(spark):
    hits = ["Fixed it", "fixes #3", "HOTFIX", "resolved", "a bug.", "error: x", "fix"]
    misses = ["fixing", "bugs", "prefix", "issues", "crashed", "", None, "éfix"]
    got = values(spark, [(m,) for m in hits + misses], "m string", S.is_bugfix_message(F.col("m")))
    assert [g[0] for g in got] == [True] * len(hits) + [False] * len(misses)


def test_code_file_flag(spark):
    cases = {"a.b.GO": True, ".py": False, "x.": False, "src/.a.py": True, "a.md": False, "dir.py/readme": False,
             "x.tar.rs": True, "src/.py": False}
    got = values(spark, [(p,) for p in cases], "p string", S.code_file_flag(F.col("p")))
    assert [g[0] for g in got] == list(cases.values())


def test_repo_slug(spark):
    urls = ["https://host/o/n.git/", "https://host/o/n", "n.git", "https://host/o/n.git.git"]
    got = values(spark, [(u,) for u in urls], "u string", S.repo_slug(F.col("u")), S.repo_display_name(F.col("u")))
    assert [tuple(s) for s, _ in got] == [
        ("o", "n", "o_n"), ("o", "n", "o_n"), ("unknown", "n", "unknown_n"), ("o", "n.git", "o_n.git")]
    assert [d for _, d in got] == ["o / n.git", "o / n", "n.git", "o / n.git.git"]


def test_shorten_path(spark):
    got = values(spark, [("src/features/x.py",), ("x.py",), ("a//b.py",)], "p string", S.shorten_path(F.col("p")))
    assert [g[0] for g in got] == ["features/x.py", "x.py", "a/b.py"]


def test_risk_band(spark):
    rows = [(39.9,), (40.0,), (69.9,), (70.0,), (80.0,)]
    got = values(spark, rows, "s double", S.risk_band(F.col("s")), S.is_critical(F.col("s")))
    assert got == [("LOW", False), ("MED", False), ("MED", False), ("HIGH", False), ("HIGH", True)]


def test_complexity_grade(spark):
    rows = [(0.0,), (5.0,), (5.5,), (10.0,), (10.1,), (41.0,)]
    got = values(spark, rows, "c double", S.complexity_grade(F.col("c")), S.high_complexity(F.col("c")))
    assert got == [(1, 0), (1, 0), (2, 0), (2, 0), (3, 1), (6, 1)]


@pytest.mark.parametrize("decimals", [0, 1, 2, 4])
def test_exact_round_is_pythons(spark, decimals):
    rng = random.Random(decimals)
    numbers = [rng.random() * 10 ** rng.randint(0, 5) for _ in range(500)]
    numbers += [n / 1000 for n in range(1000)] + [n / 32 for n in range(200)] + [0.025, 0.165, 0.145, 2.5, 0.5]
    got = values(spark, [(n,) for n in numbers], "x double",
                 S.exact_round(F.col("x"), decimals), S.fixed_text(F.col("x"), decimals))
    assert [g[0] for g in got] == [round(n, decimals) for n in numbers]
    assert [g[1] for g in got] == [f"{n:.{decimals}f}" for n in numbers]


def test_driver_text(spark):
    rows = [("churn_spike_ratio", 3.24), ("unknown f", 1.0), ("lines_changed_30d", 412.0),
            ("bus_factor_score", 0.125), ("coupled_high_churn", 1.0), ("complexity_rank", 2.0)]
    got = values(spark, rows, "f string, v double", driver_text(F.col("f"), F.col("v")))
    assert [g[0] for g in got] == [
        "churn spike ratio: 3.2x", "unknown f: 1.00", "high recent churn (412 lines in 30d)",
        "single author dominates (bus factor: 0.12)", "coupled to high-churn files", "complexity grade: 2/6"]
    assert len(DRIVER_TEXTS) == 22
