"""A training corpus from documents: toxic ones go, one of each group of near copies stays, benchmark leaks go, sources are mixed, shards dealt."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from tremorline.llm.text import set_aside
from tremorline.session import materialize

SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a severity above 0 stays below the limit, by a model of the labelled ones among ``docs``."""
    rows, as_before = set_aside(docs, "doc_id", "text")
    model = toxicity.fit_toxicity(rows, _table(spark, sf_dir, "labels"))
    return as_before(toxicity.score_toxicity(rows, model).filter("not toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word Jaccard similarity of 0.8 or more."""
    return jaccard_join.first_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows, as_before = set_aside(docs, "text")
    return as_before(decontamination.find_leaks(rows, _table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the weight of the square root of their bytes; a document may be left out or come several times."""
    rows, as_before = set_aside(docs, "doc_id", "text", "source")
    return as_before(mixing.mix_sources(rows))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot."""
    return sharding.shard_documents(docs, sharding.even_tree(SHARDS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages' models and joins have no SQL form; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
