"""Histories, sources and scores read out of the sample star-schema and text tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.schemas import FEATURES, KEYS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _repo(key: str):
    return F.concat(F.lit("repo"), (F.col(key) % 3).cast("string"))


def _part_path():
    extension = (
        F.when(F.col("p_size") % 5 == 0, ".py").when(F.col("p_size") % 5 == 1, ".js")
        .when(F.col("p_size") % 5 == 2, ".GO").when(F.col("p_size") % 5 == 3, ".md").otherwise("")
    )
    return F.concat(
        F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")),
        F.lit("_"), F.col("p_partkey").cast("string"), extension,
    )


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records: an order is a commit, a line a modified file; orders without lines have no paths.

    Lines meet their orders first, as numbers, and get their long paths last: lines of orders that nobody asks for
    (merges, other repositories) then stay out of the second join.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)).alias("removed"),
        F.col("l_quantity").cast("bigint").alias("lines_added"), F.round(F.col("l_discount") * 100).cast("bigint").alias("lines_deleted"),
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), _part_path().alias("old_path"))
    message = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Fixed crash in module")
        .when(F.col("o_orderpriority") == "2-HIGH", "bugs cleanup")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "prefix tidy")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("string"))
        .otherwise("Add feature")
    )
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(parts, "l_partkey", "left")
        .select(
            _repo("o_orderkey").alias("repo"),
            F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("commit_hash"),
            F.col("o_orderdate").cast("timestamp").alias("commit_date"),
            (F.col("o_orderkey") % 13 == 0).alias("is_merge"),
            F.concat(F.lit("author"), (F.col("o_custkey") % 50).cast("string")).alias("author_name"),
            message.alias("message"),
            "old_path",
            F.when(F.col("removed"), F.lit(None)).otherwise(F.col("old_path")).alias("new_path"),
            "lines_added",
            "lines_deleted",
        )
    )


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records with microsecond times and one file per commit."""
    return table(spark, sf_dir, "events").select(
        _repo("event_id").alias("repo"),
        F.lpad(F.col("event_id").cast("string"), 10, "0").alias("commit_hash"),
        F.col("ts").cast("timestamp").alias("commit_date"),
        F.lit(False).alias("is_merge"),
        F.col("user_id").cast("string").alias("author_name"),
        F.col("event_type").alias("message"),
        F.lit(None).cast("string").alias("old_path"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k"), F.lit(".py")).alias("new_path"),
        F.floor("value").cast("bigint").alias("lines_added"),
        F.lit(0).cast("bigint").alias("lines_deleted"),
    )


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated Python text per ``.py`` part and repository; one size in fifty does not parse.

    By the part's key: a function of branches, a class with two methods, loops and ``try`` with boolean operators, or no function.
    """
    branches = F.repeat(F.lit("    if x:\n        pass\n"), F.col("p_size") % 50)
    function = F.concat(F.lit("def f(x):\n    pass\n"), branches)
    method_branches = F.repeat(F.lit("        if x:\n            pass\n"), F.col("p_size") % 50)
    in_class = F.concat(F.lit("class A:\n    def m(self, x):\n        pass\n"), method_branches, F.lit("    def n(self):\n        return self\n"))
    loops = F.concat(F.lit(
        "def g(x):\n    for a in x:\n        pass\n    else:\n        pass\n    try:\n        pass\n    except E:\n        pass\n    else:\n"
        "        pass\n    while x and a or x:\n        pass\n    return [b for b in x if b]\n"), function)
    kind = F.col("p_partkey") % 4
    text = (
        F.when(F.col("p_size") == 50, "def (:").when(kind == 0, function).when(kind == 1, in_class).when(kind == 2, loops)
        .otherwise("import os\nx = 1 if os else 2\n")
    )
    repos = F.explode(F.array(F.lit("repo0"), F.lit("repo1"), F.lit("repo2")))
    return table(spark, sf_dir, "part").filter(F.col("p_size") % 5 == 0).select(
        repos.alias("repo"), _part_path().alias("file_path"), text.alias("source")
    )


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and heavily tied scores for the evaluation operators."""
    labels, documents = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(documents, "doc_id").select(
        F.concat(F.lit("toxic"), F.col("toxic").cast("string")).alias("repo"),
        F.col("quality").cast("int").alias("y"),
        F.round(F.col("n_chars") / F.lit(20000.0), 2).alias("score"),
    )


def formula_predictions(churn: DataFrame) -> DataFrame:
    """Probabilities from a fixed formula over churn, standing in for a model's where SQL has to agree."""
    mixed = (F.col("total_lines_changed") * 7 + F.col("file_age_days") * 3 + F.col("total_commits")) % 1000
    return churn.select(*KEYS, (mixed / F.lit(1000.0)).alias("probability"))


def formula_contributions(matrix: DataFrame) -> DataFrame:
    """Attributions from a fixed formula, standing in for a model's where SQL has to agree."""
    items = [
        F.struct(
            F.lit(name).alias("feature"),
            F.col(name).cast("double").alias("value"),
            ((F.floor(F.round(F.col(name).cast("double"), 6) * 16) * (at + 3) % 41 - 20) / F.lit(16.0)).alias("phi"),
        )
        for at, name in enumerate(FEATURES)
    ]
    return matrix.select(*KEYS, F.array(*items).alias("contributions"))
