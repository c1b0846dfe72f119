"""Class balance, boosted-tree training, early stopping and scoring."""
from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import batched
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorline.operators.attribution import (
    LEAF_TABLE, tree_attributions, leaf_frame, leaf_table, staged_margins,
)
from tremorline.operators.boosting import Boosting, BoostingParams, margins
from tremorline.operators.evaluation import auc_of_margins, roc_auc, score_curve
from tremorline.operators.report import global_importance, top_drivers
from tremorline.operators.scaling import attach
from tremorline.schemas import FEATURES, KEYS, SCORED_FILES
from tremorline.session import materialize, scratch_path


BEST_ROUND = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("best_iteration", T.IntegerType()),
    T.StructField("best_auc", T.DoubleType()),
])


def class_balance(matrix: DataFrame) -> DataFrame:
    """Training positives and negatives, weight of a positive, and whether there is anything to learn."""
    train = F.col("in_train")
    return (
        matrix.groupBy("repo")
        .agg(F.count_if(train & (F.col("label") == 1)).alias("pos"),
             F.count_if(train & (F.col("label") == 0)).alias("neg"))
        .withColumn("scale_pos_weight",
                    F.greatest(F.col("neg") / F.greatest(F.col("pos"), F.lit(1)), F.lit(1.0)))
        .withColumn("trainable", (F.col("pos") > 0) & (F.col("neg") > 0))
    )


def train_model(train: DataFrame, pos_weight: Column,
                params: BoostingParams = BoostingParams(), features: list[str] = FEATURES) -> Boosting:
    """Fit boosted trees on one training set (keys, features, label), positives weighted up; all rounds."""
    return Boosting(train, pos_weight, params, features).grow(params.rounds)


def train_until_best(matrix: DataFrame, pos_weight: Column, params: BoostingParams = BoostingParams(),
                     features: list[str] = FEATURES) -> tuple[Boosting, tuple[int, float] | None]:
    """Train on the rows in_train until ``patience`` rounds have passed without a better AUC on all rows in_test together.

    Rounds are judged together when a stop is next possible: after the best round so far and ``patience`` more. So where a
    level is a pass over tasks, no round past the stop is trained. Where one task learns, a round costs less than the jobs around it:
    there each run at least doubles the rounds, and those past the stop are dropped. Returns the model and ``best_iteration``, or None
    without test rows.
    """
    model = Boosting(matrix, pos_weight, params, features, F.col("in_train"), F.col("in_test"))
    aucs, target = [], params.patience + 1
    while True:
        model.grow(min(params.rounds, target if model.tasks > 1 else max(target, 2 * len(model.trees))))
        aucs += [(r["tree_id"], r["auc_roc"]) for r in auc_of_margins(model.staged(), ["tree_id"]).collect()]
        if not aucs:
            return model.grow(params.rounds), None
        best = _best_of(matrix.sparkSession, aucs, params.patience)
        target = best[0] + params.patience + 1
        if len(model.trees) >= min(params.rounds, target):
            return model.keep(target), best
        model.settle()


def score_files(model: Boosting, matrix: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Positive-class probability of every test file under the whole model."""
    return margins(matrix.filter("in_test"), model).select(*KEYS, (1 / (1 + F.exp(-2 * F.col("margin")))).alias("probability"))


def staged_auc(matrix: DataFrame, leaves: list[dict], rounds: range | None = None) -> DataFrame:
    """Test AUC after each boosting round (of ``rounds``, else all), exact, per repository."""
    rounds = range(1 + max(leaf["tree_id"] for leaf in leaves)) if rounds is None else rounds
    staged = staged_margins(matrix.filter("in_test"), leaves, rounds).select(
        "repo", F.col("label").alias("y"), F.posexplode("margins").alias("at", "score")
    ).withColumn("tree_id", F.col("at") + rounds.start).drop("at")
    return roc_auc(score_curve(staged, ["repo", "tree_id"]), ["repo", "tree_id"])


def _aucs(matrix: DataFrame, leaves: list[dict], rounds: range) -> list[tuple[int, float]]:
    """One number a round."""
    return sorted((r["tree_id"], r["auc_roc"]) for r in staged_auc(matrix, leaves, rounds).collect())


def _best_of(spark: SparkSession, aucs: list[tuple[int, float]], patience: int) -> tuple[int, float]:
    by_round = spark.createDataFrame([("*", *a) for a in aucs], "repo string, tree_id int, auc_roc double")
    best = best_iteration(by_round, patience).first()
    return best["best_iteration"], best["best_auc"]


def stopped_round(matrix: DataFrame, leaves: list[dict], params: BoostingParams) -> tuple[int, float] | None:
    """``best_iteration`` of finished trees, looked for block by block until its patience is spent; None without test rows.

    At most one number a round reaches the driver, and rounds past the stop are never scored.
    """
    last, aucs, best = 1 + max(leaf["tree_id"] for leaf in leaves), [], None
    for start in range(0, last, params.block):
        aucs += _aucs(matrix, leaves, range(start, min(last, start + params.block)))
        if not aucs:
            return None
        best = _best_of(matrix.sparkSession, aucs, params.patience)
        if aucs[-1][0] - best[0] > params.patience:
            break
    return best


def best_iteration(auc_by_round: DataFrame, patience: int = 20) -> DataFrame:
    """The round kept when training stops after ``patience`` rounds without a better AUC.

    Test labels of a single class give the same AUC to every round, so the first one stays.
    """
    rounds = F.sort_array(F.collect_list(F.struct("tree_id", "auc_roc")))  # one entry per round
    start = F.struct(F.lit(-1).alias("tree_id"), F.lit(-1.0).alias("auc_roc"))
    best = F.aggregate(
        "rounds", start,
        lambda best, r: F.when(
            (r["auc_roc"] > best["auc_roc"]) & ((best["tree_id"] < 0) | (r["tree_id"] - best["tree_id"] <= patience)),
            F.struct(r["tree_id"].alias("tree_id"), r["auc_roc"].alias("auc_roc")),
        ).otherwise(best),
    )
    return auc_by_round.groupBy("repo").agg(rounds.alias("rounds")).select(
        "repo", best["tree_id"].alias("best_iteration"), best["auc_roc"].alias("best_auc")
    )


def constant_fallback(matrix: DataFrame, balance: DataFrame) -> DataFrame:
    """0.5 and no attributions for the test files of repositories with nothing to learn from."""
    untrainable = balance.filter(~F.col("trainable")).select("repo")
    tests = attach(matrix.filter("in_test").select(*KEYS), untrainable, on=["repo"], how="inner")
    return tests.select(
        *KEYS, F.lit(0.5).alias("probability"),
        F.array().cast(SCORED_FILES["contributions"].dataType).alias("contributions"),
    )


@dataclass(frozen=True)
class FittedRun:
    """Scores of all test files, and the leaves and kept round of each repository's model."""

    scored: DataFrame
    leaves: DataFrame
    best: DataFrame


def fit_and_score(matrix: DataFrame, params: BoostingParams = BoostingParams()) -> FittedRun:
    """Probability and attributions of every test file.

    A single model over all trainable repositories by default, positives weighted by repository: the number of jobs
    does not grow with the repositories. With ``pooled=False`` each repository gets its own model, in folders of its own;
    repositories are read from an iterator a few at a time, and fitted side by side. ``matrix`` then has to be a
    stored table (see ``materialize``) sorted by repository, so that a fit reads its own rows only.
    """
    spark = matrix.sparkSession
    balance = class_balance(matrix)
    root = scratch_path(spark, "models")

    def run(name, own, pos_weight):
        model, best = train_until_best(own, pos_weight, params)
        leaves = leaf_table(spark, model)
        # Without test files there is nothing to stop on (and nothing to score).
        last, auc = best or (params.rounds - 1, 0.0)
        kept = [leaf for leaf in leaves if leaf["tree_id"] <= last]
        folder = uuid.uuid4().hex
        # Dealt out, as a file takes far longer to explain than to read.
        dealt = own.filter("in_test").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEYS)
        tree_attributions(dealt, kept).write.parquet(f"{root}/scored/{folder}")
        leaf_frame(spark, leaves).select(
            F.lit(name).alias("repo"), "*", (F.col("tree_id") <= last).alias("kept")
        ).write.parquet(f"{root}/leaves/{folder}")
        spark.createDataFrame([(name, last, auc)], BEST_ROUND).write.parquet(f"{root}/best/{folder}")

    def run_repo(row):
        own = matrix.filter(F.col("repo") == row["repo"])
        run(row["repo"], own, F.lit(row["scale_pos_weight"]))

    if params.pooled:
        weights = balance.filter("trainable").select("repo", "scale_pos_weight")
        pooled = materialize(attach(matrix, weights, on=["repo"], how="inner"), "pooled")
        if not pooled.isEmpty():
            run("*", pooled, F.col("scale_pos_weight"))
    else:
        pool = ThreadPool(params.parallel_repos)
        try:
            task = inheritable_thread_target(spark)(run_repo)
            for few in batched(balance.filter("trainable").toLocalIterator(), params.parallel_repos):
                pool.map(task, few)
        finally:
            pool.close()
    constant_fallback(matrix, balance).write.parquet(f"{root}/scored/untrained")

    def read(kind, schema):
        # The empty frame stands in for a folder that exists only once some model was trained.
        stored = spark.read.schema(schema).option("recursiveFileLookup", True)
        try:
            return stored.parquet(f"{root}/{kind}")
        except AnalysisException:
            return spark.createDataFrame([], schema)

    model_leaves = T.StructType([SCORED_FILES["repo"], *LEAF_TABLE.fields, T.StructField("kept", T.BooleanType())])
    return FittedRun(read("scored", SCORED_FILES), read("leaves", model_leaves), read("best", BEST_ROUND))


def score_with_leaves(matrix: DataFrame, leaves: list[dict]) -> FittedRun:
    """Scores of all test files under given trees, for models that were trained before; every round counts as kept."""
    spark = matrix.sparkSession
    last = max(leaf["tree_id"] for leaf in leaves)
    table = leaf_frame(spark, leaves).select(F.lit("*").alias("repo"), "*", F.lit(True).alias("kept"))
    return FittedRun(tree_attributions(matrix.filter("in_test"), leaves), table, spark.createDataFrame([("*", last, None)], BEST_ROUND))


def score_kept(matrix: DataFrame, leaves: list[dict]) -> FittedRun:
    """Scores as the run gave them that trained ``leaves``: repositories with nothing to learn from get the constant."""
    balance = class_balance(matrix)
    learnable = attach(matrix, balance.filter("trainable").select("repo"), on=["repo"], how="inner")
    run = score_with_leaves(learnable, leaves)
    return FittedRun(run.scored.unionByName(constant_fallback(matrix, balance)), run.leaves, run.best)


def explain_predictions(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Driver sentences per file and importance per feature."""
    return top_drivers(scored), global_importance(scored)
