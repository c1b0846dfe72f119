import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tremorline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        # Small inputs stay in several partitions, as large ones would.
        "spark.sql.shuffle.partitions": "3", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_facts(spark):
    """Facts from (repo, commit, 'YYYY-mm-dd HH:MM:SS', author, message, file[, added[, deleted]]) tuples."""
    from tremorline.operators.history import label_bugfix
    from pyspark.sql import functions as F

    def build(rows):
        full = [tuple(r) + (1, 0)[len(r) - 6:] if len(r) < 8 else tuple(r) for r in rows]
        frame = spark.createDataFrame(full, (
            "repo string, commit_hash string, commit_date string, author_name string, message string, "
            "file_path string, lines_added bigint, lines_deleted bigint"
        )).withColumn("commit_date", F.col("commit_date").cast("timestamp"))
        return label_bugfix(frame)

    return build


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
