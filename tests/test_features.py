import math
import random
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tremorline.operators import activity as A
from tremorline.operators import coupling as C
from tremorline.operators import history as H
from tremorline.operators import matrix as M
from tremorline.plans.feature_matrix import build_feature_matrix, matrix_from_history
from tremorline.operators.complexity import complexity_features
from tremorline.schemas import CHURN_FEATURES, FEATURES


def test_churn_window_bounds_are_inclusive(make_facts):
    facts = make_facts([
        ("r", "1", "2024-03-31 10:00:00", "a", "m", "f", 10, 2),
        ("r", "2", "2024-03-01 10:00:00", "a", "m", "f", 5, 0),   # exactly 30 days before
        ("r", "3", "2024-03-01 09:59:59", "a", "m", "g", 7, 0),
    ])
    got = {r["file_path"]: r for r in A.churn_features(facts).collect()}
    assert (got["f"]["lines_changed_30d"], got["f"]["commit_count_30d"]) == (17, 2)
    assert (got["g"]["lines_changed_30d"], got["g"]["lines_changed_60d"]) == (0, 7)
    assert got["f"].asDict().keys() == {"repo", "file_path", *CHURN_FEATURES}


def test_unknown_lines_are_left_out_of_sums(make_facts):
    facts = make_facts([("r", "1", "2024-01-01 00:00:00", "a", "m", "f", None, 4), ("r", "2", "2024-01-01 00:00:00", "a", "m", "f", 3, 1),
                        ("r", "3", "2024-01-01 00:00:00", "a", "m", "g", None, None)])
    assert rows_of(A.churn_features(facts), "file_path", "total_lines_changed", "total_commits") == [("f", 4, 2), ("g", 0, 1)]


def test_spike(spark):
    df = spark.createDataFrame([("r", "f", 40, 60), ("r", "g", 0, 0)],
                               "repo string, file_path string, lines_changed_30d long, lines_changed_90d long")
    assert rows_of(A.churn_spike(df), "churn_spike_ratio") == [(1.0,), (2.0,)]


def test_age_is_whole_elapsed_days(make_facts):
    facts = make_facts([("r", "1", "2024-01-01 23:00:00", "a", "m", "f"), ("r", "2", "2024-01-03 01:00:00", "a", "m", "g")])
    assert rows_of(A.lifetime_activity(facts), "file_path", "file_age_days") == [("f", 1), ("g", 0)]


def test_authorship_cases(make_facts):
    day = "2024-01-01 00:00:00"
    rows = [("r", f"x{n}", day, "ab"[n % 2], "m", "even") for n in range(4)]
    rows += [("r", f"y{n}", day, "a", "m", "alone") for n in range(3)]
    rows += [("r", f"z{n}", day, "b" if n == 0 else "a", "m", "mostly") for n in range(4)]
    rows += [("r", "n", day, None, "m", "nobody"), ("r", "y0", day, "a", "m", "alone")]
    got = {r["file_path"]: r for r in A.authorship_features(make_facts(rows)).collect()}
    assert got["even"]["author_entropy"] == pytest.approx(1.0, abs=1e-9)
    assert got["alone"]["author_entropy"] == 0.0 and got["alone"]["bus_factor_score"] == 1.0
    assert got["mostly"]["bus_factor_score"] == 0.75
    assert (got["nobody"]["bus_factor_score"], got["nobody"]["unique_authors_total"]) == (0.0, 0)


def test_entropy_of_many_authors(make_facts):
    rng = random.Random(3)
    counts = [rng.randint(1, 9) for _ in range(60)]
    rows = [("r", f"{a}-{n}", "2024-01-01 00:00:00", f"a{a}", "m", "f") for a, c in enumerate(counts) for n in range(c)]
    total = sum(counts)
    expected = -sum(c / total * math.log2(c / total + 1e-12) for c in counts)
    assert A.author_entropy(make_facts(rows)).first()["author_entropy"] == pytest.approx(expected, abs=1e-11)


def random_history(seed, n_commits=60, n_files=9):
    rng = random.Random(seed)
    start = datetime(2023, 1, 1)
    rows = []
    for c in range(n_commits):
        sha = f"{rng.getrandbits(40):010x}"
        date = (start + timedelta(hours=rng.randint(0, 24 * 400))).strftime("%Y-%m-%d %H:%M:%S")
        message = rng.choice(["fix", "add", None, "bug"])
        for _ in range(rng.randint(1, 5)):
            rows.append(("hot" if c % 3 else f"r{c % 4}", sha, date, f"a{c % 4}",
                         message, f"f{rng.randrange(n_files)}", rng.randint(0, 40), rng.randint(0, 9)))
    return rows


def brute_coupling(rows, totals, max_files):
    commits = {}
    for repo, sha, *_rest in rows:
        commits.setdefault(repo, {}).setdefault(sha, []).append(_rest[3])
    expected = {}
    for repo, by_commit in commits.items():
        partners = {}
        for sha in sorted(by_commit):
            files = by_commit[sha]
            if len(files) > max_files:
                continue
            for a, b in combinations(sorted(set(files)), 2):
                for x, y in ((a, b), (b, a)):
                    partners.setdefault(x, {}).setdefault(y, 0)
                    partners[x][y] += 1
        values = sorted(totals[repo].values())
        spot = 0.75 * (len(values) - 1)
        low = int(spot)
        high = min(low + 1, len(values) - 1)
        threshold = values[low] + (values[high] - values[low]) * (spot - low)
        hot = {f for f, t in totals[repo].items() if t >= threshold}
        for file in totals[repo]:
            best = sorted(partners.get(file, {}).items(), key=lambda p: -p[1])  # stable: first seen stays first
            top = [n for _, n in best[:5]]
            n = len(by_commit)
            expected[(repo, file)] = (
                sum(top) / len(top) / n if top else 0.0, best[0][1] / n if best else 0.0,
                int(any(p in hot for p, _ in best[:3])), len(best))
    return expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_coupling_equals_brute_force(make_facts, seed):
    rows = random_history(seed)
    totals = {}
    for repo, _, _, _, _, file, added, deleted in rows:
        totals.setdefault(repo, {}).setdefault(file, 0)
        totals[repo][file] += added + deleted
    facts = make_facts(rows).repartition(5)
    got = C.coupling_features(facts, A.churn_features(facts), max_files=4)
    got = {(r["repo"], r["file_path"]): tuple(r)[2:] for r in got.collect()}
    expected = brute_coupling(rows, totals, 4)
    assert got.keys() == expected.keys()
    for key, want in expected.items():
        assert got[key] == pytest.approx(want, abs=1e-12), key


def commit(sha, files):
    return [("r", sha, "2024-01-01 00:00:00", "a", "m", f) for f in files]


def test_pairs(make_facts):
    pairs = C.co_change_pairs(make_facts(commit("1", "abc") + commit("2", "ab")))
    assert rows_of(pairs, "f1", "f2", "n_commits") == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def test_mass_commits_are_judged_by_rows(make_facts):
    many = [f"f{n:02d}" for n in range(31)]
    facts = make_facts(commit("1", many) + commit("2", many[:30] + ["f00"]) + commit("3", many[:30]))
    assert {r["n_commits"] for r in C.co_change_pairs(facts).collect()} == {1}
    assert C.co_change_pairs(facts).count() == 435
    assert rows_of(C.mass_commit_report(facts), "total_commits", "skipped_commits") == [(3, 2)]
    assert rows_of(C.mass_commit_filter(facts), "commit_hash", "n_rows") == [("3", 30)]


def test_partner_ties(make_facts):
    def order(facts):
        edges = C.partner_edges(C.co_change_pairs(make_facts(facts)))
        return [p for _, p in rows_of(C.top_partners(edges).filter("file_path = 'm'"), "position", "partner")]
    assert order(commit("h1", "mx") + commit("h2", "mw")) == ["x", "w"]
    assert order(commit("h1", "mxw")) == ["w", "x"]


def test_high_churn_threshold(spark):
    churn = spark.createDataFrame([("r", f"f{t}", t) for t in (1, 2, 3, 10)], "repo string, file_path string, total_lines_changed long")
    assert C.churn_threshold(churn).first()["threshold"] == 4.75
    assert rows_of(C.high_churn_files(churn), "file_path") == [("f10",)]


def test_partners_are_twice_the_pairs(make_facts):
    facts = make_facts(random_history(8))
    partners = C.coupling_features(facts, A.churn_features(facts)).agg(F.sum("unique_coupling_partners")).first()[0]
    assert partners == 2 * C.co_change_pairs(facts).count()


def test_matrix_fills_gaps(spark, make_facts):
    authors = spark.createDataFrame([("r", "only_authors", 2, 1, 0.5, 1.0)], "repo string, file_path string, "
                                    "unique_authors_total long, unique_authors_30d long, bus_factor_score double, author_entropy double")
    churn = A.churn_features(make_facts([("r", "1", "2024-01-01 00:00:00", "a", "m", "f")]))
    complexity = spark.createDataFrame([("r", "f", 0.0, 0, 0)], "repo string, file_path string, "
                                       "cyclomatic_complexity double, complexity_rank long, is_high_complexity long")
    got = {r["file_path"]: r for r in M.feature_matrix(churn, authors, complexity).collect()}
    assert got["only_authors"]["churn_spike_ratio"] == 0.0 and got["f"]["churn_spike_ratio"] == 3.0
    assert got["only_authors"]["complexity_rank"] == 1 and got["f"]["complexity_rank"] == 1
    assert M.canonical_features(authors).columns == ["repo", "file_path", "unique_authors_total", "unique_authors_30d",
                                                     "bus_factor_score", "author_entropy"]


def test_labels_and_split(make_facts):
    facts = make_facts([
        ("r", "1", "2024-12-31 00:00:00", "a", "fix", "late"), ("r", "2", "2024-06-30 00:00:00", "a", "fix", "at_cutoff"),
        ("r", "3", "2024-07-30 00:00:00", "a", "fix", "window_end"), ("r", "4", "2024-01-01 00:00:00", "a", "fix", "early"),
        ("r", "5", "2024-01-01 00:00:00", "a", "add", "both"), ("r", "6", "2024-07-01 00:00:00", "a", "add", "both"),
    ])
    assert rows_of(A.label_files(facts), "file_path", "label") == [
        ("at_cutoff", 1), ("both", 0), ("early", 0), ("late", 0), ("window_end", 0)]
    assert rows_of(A.temporal_split(facts), "file_path", "in_train", "in_test") == [
        ("at_cutoff", False, True), ("both", True, True), ("early", True, False), ("late", False, True),
        ("window_end", False, True)]
    report = M.split_report(A.split_flags(facts)).first()
    assert (report["train_files"], report["test_files"], report["no_test_positives"]) == (2, 4, False)


def test_both_matrix_paths_agree_and_ignore_order_and_other_repos(spark, make_facts):
    rows = random_history(11, 80)
    sources = spark.createDataFrame([], "repo string, file_path string, source string")
    facts = make_facts(rows)
    whole = matrix_from_history(facts, sources)
    churn = A.churn_features(facts)
    parts = build_feature_matrix(facts, churn, C.coupling_features(facts, churn), A.authorship_features(facts),
                                 complexity_features(facts, sources))
    assert whole.columns == ["repo", "file_path", *FEATURES, "label", "in_train", "in_test"] == parts.columns
    expected = sorted(whole.collect())
    assert sorted(parts.collect()) == expected
    shuffled = make_facts(random.Random(0).sample(rows, len(rows))).repartition(6)
    assert sorted(matrix_from_history(shuffled, sources).collect()) == expected
    single = make_facts([r for r in rows if r[0] == "hot"])
    assert sorted(matrix_from_history(single, sources).collect()) == [r for r in expected if r["repo"] == "hot"]
    for row in expected:
        authors = row["unique_authors_total"]
        assert 0 <= row["author_entropy"] <= math.log2(authors) + 1e-9
        assert 1 / authors - 1e-9 <= row["bus_factor_score"] <= 1


def test_empty_history_gives_empty_features(make_facts):
    facts = make_facts([("r", "1", "2024-01-01 00:00:00", "a", "m", "f")]).filter("false")
    churn = A.churn_features(facts)
    for frame in (churn, A.authorship_features(facts), C.coupling_features(facts, churn), H.history_bounds(facts)):
        assert frame.count() == 0


def test_matrix_as_of_is_that_of_the_earlier_history(spark, make_facts):
    facts = make_facts([("r", str(n), f"2024-0{1 + n % 6}-11 00:00:00", f"a{n % 3}", "fix" if n % 2 else "m", f"f{n % 4}.py") for n in range(24)])
    sources = spark.createDataFrame([("r", "f1.py", "def f(x):\n    return x and 1\n")], "repo string, file_path string, source string")
    early = facts.filter("commit_date < timestamp '2024-04-01'")
    assert early.count() < facts.count()
    got, want = (sorted(map(str, df.collect())) for df in (
        matrix_from_history(facts, sources, datetime(2024, 4, 1)), matrix_from_history(early, sources)))
    assert got == want


def test_author_sketches_merge(spark, make_facts):
    rows = [("r", f"c{i}", f"2024-{1 + i % 6:02d}-10 00:00:00", f"a{i % 3000}", None, "busy.py") for i in range(6000)]
    rows += [("r", f"d{i}", "2024-06-20 00:00:00", f"a{i % 7}", None, "few.py") for i in range(20)] + [("r", "e", "2024-01-01 00:00:00", None, None, "none.py")]
    facts = make_facts(rows)
    bounds = H.history_bounds(facts)
    exact = {r.file_path: r for r in A.unique_authors(facts, bounds).collect()}
    older, newer = facts.filter("commit_date < '2024-03-01'"), facts.filter("commit_date >= '2024-03-01'")
    for sketches in (A.author_sketches(facts), A.author_sketches(older).union(A.author_sketches(newer))):
        found = {r.file_path: r for r in A.unique_authors_approx(sketches, bounds).collect()}
        assert set(found) == {"busy.py", "few.py"} and found["few.py"][2:] == exact["few.py"][2:]
        for c in ("unique_authors_total", "unique_authors_30d"):
            assert abs(found["busy.py"][c] / exact["busy.py"][c] - 1) < 0.03


def test_churn_threshold_from_a_sketch(spark):
    churn = spark.range(20_000).selectExpr("if(id % 4 = 0, 'a', 'b') as repo", "cast(id as string) as file_path", "pmod(xxhash64(id), 100000) as total_lines_changed")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    threshold = C.churn_threshold_approx(churn)
    hot = C.high_churn_files(churn, approximate=True)
    assert len(tracker.getJobIdsForGroup(None)) == before
    for row in threshold.collect():
        below = churn.filter(F.col("repo") == row.repo).agg(F.avg((F.col("total_lines_changed") < row.threshold).cast("int"))).first()[0]
        assert abs(below - 0.75) < 0.01
    shares = {r.repo: r.n for r in hot.groupBy("repo").agg(F.count("*").alias("n")).collect()}
    assert abs(shares["a"] / 5000 - 0.25) < 0.01 and abs(shares["b"] / 15000 - 0.25) < 0.01


def test_rows_are_not_gathered_by_repository(make_facts):
    """A repository may own all rows: its bounds are sent to them, in place of all of them to one task."""
    facts = make_facts([("r", f"c{n}", "2024-01-01 00:00:00", "a", "m", f"f{n % 5}") for n in range(20)])
    for frame in (H.anchor_to_ref(facts), H.enough_history(facts, 5)):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    churn = A.churn_features(facts)
    assert "SortMergeJoin" not in churn._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in C.high_churn_files(churn)._jdf.queryExecution().sparkPlan().toString()


def test_pairs_carry_numbers_and_ties_stay_in_path_order(spark, make_facts):
    """One commit of nine files ties all partners of a file: the first of them by path are checked and averaged."""
    paths = ["b/z.py", "b/10.py", "b/9.py", "B.py", "a.py", "\u00e9.py", "a b.py", "a/b.py", "_.py"]
    facts = make_facts([("r", "c1", "2024-01-01 00:00:00", "a", "m", p, 1000 if p == "a.py" else 1, 0) for p in paths])
    touches = H.file_touches(facts)
    numbers = {r.file_path: r.file_no for r in C.file_numbers(touches).collect()}
    assert sorted(numbers, key=numbers.get) == sorted(paths, key=lambda p: p.encode())
    churn = A.churn_features(facts).withColumn("total_lines_changed", F.when(F.col("file_path") == "a.py", 1000).otherwise(F.expr("0L")))
    features = C.coupling_features(facts, churn)
    hot = {r.file_path: r.coupled_high_churn for r in features.collect()}
    assert hot.keys() == set(paths)
    partners = C.top_partners(C.partner_edges(C.pairs_of(touches)), 3).collect()
    by_path = {p: [r.partner for r in sorted(partners, key=lambda r: r.position) if r.file_path == p] for p in paths}
    assert all(by_path[p] == sorted((q for q in paths if q != p), key=lambda q: q.encode())[:3] for p in paths)
