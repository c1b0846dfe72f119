import random

import pytest

import corpus_pipeline
from tests.llm.test_jaccard_join import brute as near_copies
from tests.llm.test_mixing import _poisson, _uniform
from tremorline.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        out.append((name, docs))
    return {name: (before, after) for (_, before), (name, after) in zip(out, out[1:])}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "sharding":
            assert after.columns == before.columns


def test_toxicity(stages, spark):
    before, after = stages["toxicity"]
    model = toxicity.fit_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(before, model).filter("toxic").collect()}
    assert ids(after) == sorted(set(ids(before)) - toxic)


def test_near_copies(stages):
    before, after = stages["near_copies"]
    assert ids(after) == sorted({c for _, c, _ in near_copies([(r.doc_id, r.text) for r in before.collect()])})


def test_leaks(stages, spark):
    before, after = stages["benchmark_leaks"]
    fold = lambda t: " ".join(t.lower().split())
    items = [fold(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in before.collect() if any(i in fold(r.text) for i in items)}
    assert leaked and leaked == set(ids(before)) - set(ids(after))


def test_mixing(stages):
    before, after = stages["mixing"]
    rows = before.collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(r.text.encode()) + 1
    weight = {s: round(n**0.5 * 1000) for s, n in size.items()}
    expected = []
    for r in rows:
        rate = weight[r.source] / sum(weight.values()) * sum(size.values()) / size[r.source]
        assert rate < 16
        expected += [r.doc_id] * _poisson(rate, _uniform("copies 0", r.doc_id, 1))
    assert ids(after) == sorted(expected)


def test_sharding_and_run(stages, spark):
    before, after = stages["sharding"]
    assert ids(after) == ids(before)
    key = lambda r: (r.shard, r.slot, r.doc_id)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, after.collect()))


def test_edges(spark):
    r = random.Random(1)
    rows = [(i, " ".join(str(r.randrange(99)) for _ in range(r.randrange(30))), None if i % 5 else "s") for i in range(20)]
    rows += [(None, None, None), (3, "", "s"), (3, "", "s")]
    docs = spark.createDataFrame([(*x, f"own {x[0]}") for x in rows], "doc_id long, text string, source string, own string").repartition(3)
    # Columns of names that operators use keep their values, too.
    clashing = docs.select("*", *[docs.own.alias(c) for c in ("toxic", "class_id", "n_copies", "leaks", "copy", "Rate")])
    for frame in (clashing, clashing.filter("false")):
        df = frame
        for name, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.materialize(stage(spark, df, SF), name)
            assert df.columns[:len(frame.columns)] == frame.columns
        found = df.collect()
        assert bool(found) == (frame is clashing)
        for r in found:
            assert r.own == f"own {r.doc_id}" == r.toxic == r.class_id == r.n_copies == r.leaks == r["copy"] == r["Rate"]
