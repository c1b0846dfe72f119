import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tremorline.operators import attribution as AT
from tremorline.operators import model as L
from tremorline.operators.report import attribution_rows
from tremorline.schemas import FEATURES
from tremorline.session import materialize


def matrix_rows(repo, n, seed, label_of):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        values = [float(rng.randint(0, 20)) for _ in FEATURES]
        rows.append((repo, f"f{k:04d}", *values, label_of(values), True, k % 2 == 0))
    return rows


@pytest.fixture(scope="module")
def matrix(spark):
    def risky(v):
        return int(v[0] + v[7] > 24)
    rows = matrix_rows("learns", 400, 1, risky) + matrix_rows("flat", 30, 2, lambda v: 0)
    schema = "repo string, file_path string, " + ", ".join(f"{f} double" for f in FEATURES) + \
        ", label int, in_train boolean, in_test boolean"
    return materialize(spark.createDataFrame(rows, schema), "matrix")


@pytest.fixture(scope="module")
def fitted(spark, matrix):
    own = matrix.filter("repo = 'learns'")
    model = L.train_model(own, F.lit(2.0), L.BoostingParams(rounds=6))
    return own, model, AT.leaf_table(spark, model)


def test_class_balance(spark):
    rows = [("a", 1)] * 2 + [("a", 0)] * 8 + [("b", 1)] * 8 + [("b", 0)] * 2 + [("c", 0)] * 3
    df = spark.createDataFrame(rows, "repo string, label int").withColumn("in_train", F.lit(True))
    assert rows_of(L.class_balance(df), "repo", "scale_pos_weight", "trainable") == [
        ("a", 4.0, True), ("b", 1.0, True), ("c", 3.0, False)]


def test_leaf_table_scores_like_the_model(fitted):
    own, model, leaves = fitted
    ours = dict(rows_of(AT.tree_attributions(own.filter("in_test"), leaves), "file_path", "probability"))
    theirs = dict(rows_of(L.score_files(model, own), "file_path", "probability"))
    assert ours.keys() == theirs.keys()
    assert all(ours[k] == pytest.approx(theirs[k], abs=1e-12) for k in ours)


def test_attributions_add_up_to_the_margin(fitted):
    own, _, leaves = fitted
    base = AT.base_margin(leaves)
    for row in AT.tree_attributions(own, leaves).limit(60).collect():
        margin = math.log(row["probability"] / (1 - row["probability"])) / 2
        assert base + sum(c["phi"] for c in row["contributions"]) == pytest.approx(margin, abs=1e-9)
        assert [c["feature"] for c in row["contributions"]] == FEATURES


def expected_margin(leaves, x, known):
    """Mean margin when only the features in ``known`` are given, path-dependent."""
    total = 0.0
    for leaf in leaves:
        weight = leaf["value"]
        for t in leaf["path"]:
            inside = t["lo"] < x[t["feature"]] <= t["hi"]
            weight *= float(inside) if t["feature"] in known else t["cover_ratio"]
        total += weight
    return total


def test_attributions_equal_the_definition_of_shapley_values(fitted):
    own, _, leaves = fitted
    used = sorted({t["feature"] for leaf in leaves if leaf["tree_id"] == 0 for t in leaf["path"]})
    tree = [leaf for leaf in leaves if leaf["tree_id"] == 0]
    assert 2 <= len(used) <= 9
    for row in AT.tree_attributions(own, tree).limit(3).collect():
        x = [c["value"] for c in row["contributions"]]
        for j in used:
            others = [f for f in used if f != j]
            phi = 0.0
            for size in range(len(others) + 1):
                share = math.factorial(size) * math.factorial(len(others) - size) / math.factorial(len(used))
                for known in itertools.combinations(others, size):
                    phi += share * (expected_margin(tree, x, {*known, j}) - expected_margin(tree, x, set(known)))
            assert row["contributions"][j]["phi"] == pytest.approx(phi, abs=1e-12)


def test_staged_margins_end_at_the_margin(fitted):
    own, _, leaves = fitted
    staged = {r["file_path"]: r["margins"] for r in AT.staged_margins(own, leaves, range(6)).collect()}
    final = dict(rows_of(AT.tree_attributions(own, leaves), "file_path", "probability"))
    for path, margins in staged.items():
        assert len(margins) == 6
        assert 1 / (1 + np.exp(-2 * margins[-1])) == pytest.approx(final[path], abs=1e-12)


@pytest.mark.parametrize("aucs,patience,best", [
    ([0.5, 0.6, 0.6, 0.7], 2, 3), ([0.5, 0.6, 0.6, 0.5, 0.9], 2, 1), ([0.5, 0.6, 0.6, 0.9], 2, 3), ([0.7], 2, 0),
])
def test_best_iteration(spark, aucs, patience, best):
    df = spark.createDataFrame([("r", t, a) for t, a in enumerate(aucs)], "repo string, tree_id int, auc_roc double")
    assert L.best_iteration(df, patience).first()["best_iteration"] == best


def test_fit_and_score(matrix):
    run = L.fit_and_score(matrix, L.BoostingParams(rounds=4, patience=2, pooled=False))
    flat = run.scored.filter("repo = 'flat'").collect()
    assert len(flat) == 15 and {r["probability"] for r in flat} == {0.5} and all(r["contributions"] == [] for r in flat)
    assert run.scored.filter("repo = 'learns'").count() == 200
    kept = run.leaves.filter("kept").select("tree_id").distinct().count()
    assert run.best.first()["best_iteration"] + 1 == kept
    assert run.best.first()["best_auc"] > 0.9
    importance = attribution_rows(run.scored).groupBy("feature").agg(F.avg(F.abs("phi")).alias("m"))
    top = [r["feature"] for r in importance.orderBy(F.desc("m")).take(2)]
    assert set(top) == {FEATURES[0], FEATURES[7]}


def test_training_repeats_exactly(spark, matrix):
    def scores(frame):
        model = L.train_model(frame, F.lit(2.0), L.BoostingParams(rounds=3))
        return rows_of(L.score_files(model, matrix.filter("repo = 'learns'")), "file_path", "probability")

    own = matrix.filter("repo = 'learns'")
    assert scores(own) == scores(own.repartition(7, F.rand(1)))


def test_training_repeats_whatever_the_partitions(spark):
    """Enough rows for several pieces under any sizing by rows; random layouts of the input give one model."""
    rows = spark.range(40_000).selectExpr("'r' repo", "cast(id as string) file_path", *[
        f"cast(pmod(xxhash64(id, {k}), 21) as double) {f}" for k, f in enumerate(FEATURES)]).withColumn(
        "label", (F.col(FEATURES[0]) + F.col(FEATURES[7]) > 24).cast("int")).withColumn("in_test", F.lit(True))
    rows = materialize(rows, "many")

    def scores(frame):
        model = L.train_model(frame, F.lit(2.0), L.BoostingParams(rounds=2))
        return L.score_files(model, rows).agg(F.sum(F.xxhash64("file_path", "probability").cast("decimal(38,0)"))).first()[0]

    assert scores(rows) == scores(rows) == scores(rows.repartition(5, F.rand(1)))


def test_rounds_past_the_stop_are_not_scored(spark, matrix, monkeypatch):
    own, looked = matrix.filter("repo = 'learns'"), []
    path = [{"feature": 0, "lo": -np.inf, "hi": 5.0, "cover_ratio": 0.5}]
    leaves = [{"tree_id": t, "leaf_id": 1, "value": 0.1, "path": path} for t in range(60)]
    whole = L.best_iteration(L.staged_auc(own, leaves), 5).first()
    monkeypatch.setattr(L, "staged_auc", lambda m, leaves, rounds, f=L.staged_auc: looked.append(rounds) or f(m, leaves, rounds))
    assert L.stopped_round(own, leaves, L.BoostingParams(patience=5, block=8)) == (whole["best_iteration"], whole["best_auc"])
    assert looked == [range(0, 8)]
    assert L.stopped_round(own.filter("false"), leaves, L.BoostingParams()) is None


def test_jobs_do_not_grow_with_repositories(spark, matrix):
    def jobs(n):
        many = materialize(matrix.filter("repo = 'learns'").crossJoin(spark.range(n).select(F.concat(F.lit("r"), "id").alias("r")))
                           .withColumn("repo", F.col("r")).drop("r"), "many")
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        L.fit_and_score(many, L.BoostingParams(rounds=2))
        return len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before))

    assert jobs(12) <= jobs(3) + 2  # a join may be planned another way, no more


def test_pooled_model_covers_the_same_files(matrix):
    run = L.fit_and_score(matrix, L.BoostingParams(rounds=2))
    assert rows_of(run.scored.groupBy("repo").count(), "repo", "count") == [("flat", 15), ("learns", 200)]
    assert run.best.first()["repo"] == "*"


def test_nothing_to_train(matrix):
    run = L.fit_and_score(matrix.filter("repo = 'flat'"), L.BoostingParams(rounds=2))
    assert run.scored.count() == 15 and run.leaves.count() == 0 and run.best.count() == 0


def test_same_trees_from_any_number_of_tasks(matrix):
    """From one task that holds all rows, and from passes over 8 or 64."""
    own = matrix.filter("repo = 'learns'")
    trees = {}
    for tasks in (1, 8, 64):
        model = L.Boosting(own, F.lit(2.0), L.BoostingParams(rows_per_task=400 // tasks)).grow(2).settle().grow(3)
        assert model.tasks >= tasks
        trees[tasks] = model.leaves()
    assert trees[1] == trees[8] == trees[64] and len(trees[1]) > 20


def test_a_level_is_one_pass(matrix, monkeypatch):
    passes = []
    monkeypatch.setattr(L.Boosting, "_sums", lambda self, *a, f=L.Boosting._sums: passes.append(1) or f(self, *a))
    params = L.BoostingParams(rows_per_task=100, depth=3)
    L.Boosting(matrix.filter("repo = 'learns'"), F.lit(2.0), params).grow(2)
    assert 2 <= len(passes) <= 2 * params.depth


def test_training_stops_when_patience_is_spent(matrix, monkeypatch):
    aucs = iter([0.5, 0.7, 0.6, 0.6, 0.71, *[0.6] * 40])
    monkeypatch.setattr(L, "auc_of_margins", lambda staged, group: staged.sparkSession.createDataFrame(
        [(t, next(aucs)) for t in sorted(r[0] for r in staged.select("tree_id").distinct().collect())], "tree_id int, auc_roc double"))
    model, best = L.train_until_best(matrix.filter("repo = 'learns'"), F.lit(2.0), L.BoostingParams(rounds=40, patience=3))
    assert best == (4, 0.71) and len(model.trees) == 4 + 3 + 1


def test_margins_are_judged_exactly(matrix):
    own = matrix.filter("repo = 'learns'")
    model, (best, auc) = L.train_until_best(own, F.lit(2.0), L.BoostingParams(rounds=5, patience=2))
    ours = {r["tree_id"]: r["auc_roc"] for r in L.staged_auc(own, model.leaves()).collect()}
    assert auc == pytest.approx(ours[best], abs=1e-12) and auc == pytest.approx(max(ours.values()), abs=1e-12)
    rows = model.grow(6).staged()
    for width in (2.0**-12, 0.5, 100.0):
        found = {r["tree_id"]: r["auc_roc"] for r in L.auc_of_margins(rows, ["tree_id"], width).collect()}
        assert found and all(v == pytest.approx(brute_auc([(r.y, r.score) for r in rows.filter(F.col("tree_id") == t).collect()]), abs=1e-12)
                             for t, v in found.items())


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_constant_features_and_empty_sets(matrix):
    own = matrix.filter("repo = 'learns'").withColumn(FEATURES[0], F.lit(3.0)).withColumn(FEATURES[7], F.lit(None).cast("double"))
    assert len(L.Boosting(own, F.lit(1.0)).grow(2).trees) == 2
    empty = L.Boosting(own.filter("false"), F.lit(1.0)).grow(1)
    assert [leaf["value"] for leaf in empty.leaves()] == [0.0]


def random_leaves(rng, trees, depth, features):
    """Leaves of random trees, grown along one path to ``depth``, with side leaves."""
    leaves = []
    for tree in range(trees):
        tests, leaf_id = {}, 0
        for _ in range(depth):
            f, limit, share = rng.randrange(features), rng.randint(1, 18) + 0.5, rng.uniform(0.1, 0.9)
            lo, hi, cover = tests.get(f, (-np.inf, np.inf, 1.0))
            for bounds, part in (((max(lo, limit), hi), 1 - share), ((lo, min(hi, limit)), share)):
                path = {**tests, f: (*bounds, cover * part)}
                leaf_id += 1
                leaves.append({"tree_id": tree, "leaf_id": leaf_id, "value": rng.uniform(-1, 1), "path": [
                    {"feature": g, "lo": a, "hi": b, "cover_ratio": c} for g, (a, b, c) in sorted(path.items())]})
            leaves.pop()
            tests = path
        leaves.append({**leaves[-1], "leaf_id": leaf_id + 1, "value": 0.25, "path": [
            {"feature": g, "lo": a, "hi": b, "cover_ratio": c} for g, (a, b, c) in sorted(tests.items())]})
    return leaves


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 7])
def test_quadrature_equals_sums_over_sets(depth):
    rng = random.Random(depth)
    leaves = random_leaves(rng, 3, depth, 6)
    x = np.array([[float(rng.randint(0, 20)) for _ in range(6)] for _ in range(5)])
    margin, phi = AT._Paths.of(leaves).explain(x)
    for row, m, values in zip(x, margin, phi):
        assert m == pytest.approx(expected_margin(leaves, row, set(range(6))), abs=1e-12)
        for j in range(6):
            others = [f for f in range(6) if f != j]
            exact = sum(
                math.factorial(size) * math.factorial(5 - size) / math.factorial(6)
                * (expected_margin(leaves, row, {*known, j}) - expected_margin(leaves, row, set(known)))
                for size in range(6) for known in itertools.combinations(others, size))
            assert values[j] == pytest.approx(exact, abs=1e-10)


def test_deep_paths_stay_small(monkeypatch):
    """Paths of 16 features: sets of them would take 2**16 rows a leaf."""
    import tracemalloc

    rng = random.Random(9)
    leaves = random_leaves(rng, 40, 40, 22)
    assert max(len(leaf["path"]) for leaf in leaves) >= 16
    x = np.array([[float(rng.randint(0, 20)) for _ in range(22)] for _ in range(300)])
    tracemalloc.start()
    margin, phi = AT._Paths.of(leaves).explain(x)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert np.allclose(AT.base_margin(leaves) + phi.sum(axis=1), margin, atol=1e-9)
    monkeypatch.setattr(AT, "CELLS", 50)
    assert np.allclose(AT._Paths.of(leaves).explain(x[:4])[1], phi[:4], atol=1e-12)


def test_a_round_in_one_task_is_summed_once_for_each_pair_of_siblings(matrix):
    """Of two siblings the fewer rows are read, of features that the round may use; totals are those of all rows and features."""
    from tremorline.operators import boosting as B

    rng, params = np.random.default_rng(3), L.BoostingParams(depth=3)
    bins = rng.integers(0, 9, (500, 5)).astype(np.uint8)
    rows = B._Rows(np.arange(500), rng.integers(0, 2, 500).astype(float), rng.integers(0, 3, 500).astype(float), rng.normal(size=500), bins)
    grower, read = B._Grower(params, [np.arange(8.0)] * 5, 5), []
    used = np.union1d(grower.drawn(4), [0])

    class Counted(B._RoundRows):
        def _summed(self, taken, n, width):
            read.append(len(self.gradient) if taken is None else len(taken))
            return super()._summed(taken, n, width)

    one = Counted(rows, np.ascontiguousarray(bins.T), 4, used, params)

    def sums(at, tree, frontier, shape):
        found, whole = one.sums(at, tree, frontier, shape), rows.sums(at, tree, frontier, shape, params)
        assert (found[:, :, used] == whole[:, :, used]).all() and found.shape == whole.shape
        return found

    tree = grower(4, sums)
    assert len(tree.feature) > 7
    assert sum(read[1:]) <= (params.depth - 1) * read[0] / 2 and read[0] < 500


def test_judging_takes_few_passes_in_one_task(matrix, monkeypatch):
    """An AUC that rises to the last round was judged every ``patience`` + 1 rounds: three jobs and more for each."""
    passes = []
    monkeypatch.setattr(L, "auc_of_margins", lambda staged, group: passes.append(1) or staged.groupBy("tree_id").agg(
        (F.max("tree_id") / F.lit(100)).alias("auc_roc")))
    model, best = L.train_until_best(matrix.filter("repo = 'learns'"), F.lit(2.0), L.BoostingParams(rounds=40, patience=1))
    assert best[0] == 39 and len(model.trees) == 40
    assert len(passes) <= 6


def test_rounds_past_the_stop_are_dropped(matrix, monkeypatch):
    own, params = matrix.filter("repo = 'learns'"), L.BoostingParams(rounds=30, patience=2)
    monkeypatch.setattr(L, "auc_of_margins", lambda staged, group: staged.groupBy("tree_id").agg(
        F.max(F.when(F.col("tree_id") <= 9, F.col("tree_id")).otherwise(0) / F.lit(100)).alias("auc_roc")))
    one, best = L.train_until_best(own, F.lit(2.0), params)
    many, same = L.train_until_best(own, F.lit(2.0), L.BoostingParams(rounds=30, patience=2, rows_per_task=100))
    assert best == same == (9, 0.09) and len(one.trees) == len(many.trees) == 12
    assert one.leaves() == many.leaves()


def test_few_rows_are_stored_in_many_pieces(matrix, monkeypatch):
    from tremorline.operators import boosting as B

    monkeypatch.setattr(B, "PIECE_ROWS", 50)
    model = L.Boosting(matrix.filter("repo = 'learns'"), F.lit(2.0), judged=F.col("in_test")).grow(2)
    assert model.tasks == 1 and len(model.state.inputFiles()) == 8
    assert len(model.settle().state.inputFiles()) >= 2 and len(model.grow(3).trees) == 3
