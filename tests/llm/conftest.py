import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame over several partitions from (doc_id, text[, source]) tuples, with a column of a clashing name."""
    def build(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", *extra.values()) for r in rows]
        names = "".join(f", {c} string" for c in extra)
        return spark.createDataFrame(full, f"doc_id long, text string, source string{names}").repartition(3)
    return build


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and white texts, one-word, very long and repeated rows, copies, no id."""
    long = " ".join(f"w{i % 997}" for i in range(20_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, long), (7, "the same row"), (7, "the same row"), (None, "no id here"),
            (None, None), (8, "é ü ß 日本"), (9, "x " * 50)]


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
