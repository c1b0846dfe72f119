import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tremorline.functions.python_source import mean_complexity
from tremorline.operators.complexity import complexity_features, file_complexity

CASES = [
    ("def f(x):\n    if x:\n        pass\n    if x:\n        pass\n", 3.0),
    ("x = 1\n", 0.0),
    ("", 0.0),
    ("def (:", None),
    (None, None),
    ("x = '\0'", None),
    ("def f():\n    pass\ndef g(a, b):\n    return a and b or a\n", 2.0),          # 1 and 3
    ("class A:\n    def m(self):\n        for i in []:\n            pass\n        else:\n            pass\n", 3.5),   # method 3, class 4
    ("class A:\n    x = 1\n", 1.0),
    ("class A:\n    x = 1 if y else 2\n    def m(self):\n        pass\n    def n(self):\n        pass\n", 5 / 3),   # 4 // 2 + 1, 1, 1
    ("class A:\n    class B:\n        def m(self):\n            if x:\n                pass\n", 1.0),
    ("async def f():\n    try:\n        pass\n    except A:\n        pass\n    except B:\n        pass\n    else:\n        pass\n", 4.0),
    ("def f(x):\n    return [a for a in x if a if a > 1]\n", 4.0),
    ("def f(x):\n    def g(y):\n        return 1 if y else 2\n    return g\n", 2.0),
    ("def f(x):\n    match x:\n        case 1:\n            pass\n        case _:\n            pass\n", 2.0),
    ("if True:\n    def f():\n        while x:\n            assert x\n", 3.0),
]


@pytest.mark.parametrize("source,expected", CASES)
def test_mean_complexity(source, expected):
    assert mean_complexity(source) == expected


def test_complexity_features(spark):
    files = spark.createDataFrame(
        [("r", p) for p in ("a.py", "a.py", "bad.py", "gone.py", "c.js")], "repo string, file_path string")
    deep = "def f(x):\n" + "    if x:\n        pass\n" * 11
    sources = spark.createDataFrame(
        [("r", "a.py", deep), ("r", "bad.py", "def (:"), ("r", "c.js", deep), ("s", "a.py", "x")],
        "repo string, file_path string, source string")
    got = rows_of(complexity_features(files, sources), "file_path", "cyclomatic_complexity", "complexity_rank",
                  "is_high_complexity")
    assert got == [("a.py", 12.0, 3, 1), ("bad.py", 0.0, 1, 0), ("c.js", 0.0, 1, 0), ("gone.py", 0.0, 1, 0)]


def test_texts_of_one_file_are_parsed_once_and_by_many_tasks(spark):
    sources = spark.createDataFrame([("r", f"{n}.py", "def f():\n    pass\n") for n in range(50)], "repo string, file_path string, source string")
    measured = file_complexity(sources.coalesce(1))
    assert measured.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert measured._jdf.queryExecution().executedPlan().toString().count("mean_complexity_udf") == 1
