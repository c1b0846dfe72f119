import random

from pyspark.sql import functions as F

from tremorline.operators.scaling import attach, running_totals


def test_attach_builds_without_a_job(spark):
    rows = [("hot" if n % 3 else f"k{n % 7}", n) for n in range(300)] + [(None, -1)]
    df = spark.createDataFrame(rows, "repo string, n int")
    lookup = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "repo string, v int")
    known = {"hot": 1, "k0": 2, "k3": 3}
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    left, inner = (attach(df, lookup.groupBy("repo").agg(F.max("v").alias("v")), ["repo"], how) for how in ("left", "inner"))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert left.columns == ["repo", "n", "v"]
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str((r, n, known.get(r))) for r, n in rows)
    assert sorted(map(tuple, inner.collect())) == sorted((r, n, known[r]) for r, n in rows if r in known)


def test_a_hot_group_is_spread_over_slices(spark):
    df = spark.range(600).select(F.lit("hot").alias("repo"), "id")
    ranged = df.repartitionByRange("repo", "id").groupBy(F.spark_partition_id().alias("slice")).count().collect()
    assert len(ranged) > 1 and max(r["count"] for r in ranged) < 400


def test_running_totals_over_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if n < 400 else f"r{n % 5}", n, rng.randint(0, 50), rng.randint(0, 9)) for n in range(600)]
    df = spark.createDataFrame(rows, "repo string, id int, rank_by int, amount int").repartition(7)
    result = running_totals(
        df, ["repo"], [F.col("rank_by").desc(), F.col("id")], {"total": F.col("amount"), "place": F.lit(1)})
    expected, sums, places = {}, {}, {}
    for repo, key, _, amount in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        sums[repo] = sums.get(repo, 0) + amount
        places[repo] = places.get(repo, 0) + 1
        expected[(repo, key)] = (sums[repo], places[repo])
    got = result.collect()
    assert {(r["repo"], r["id"]): (r["total"], r["place"]) for r in got} == expected
    assert all(r["total_total"] == sums[r["repo"]] and r["place_total"] == places[r["repo"]] for r in got)
