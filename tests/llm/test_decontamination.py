import random

import pytest
from pyspark.sql import functions as F

from tremorline.llm.decontamination import Items, LeakRule, find_leaks, folded, leaks


def semi_global(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_every_passage_within_the_budget():
    r, positive = random.Random(5), 0
    for _ in range(120):
        m = r.choice([8, 15, 30, 60, 120])
        item = "".join(r.choice("abcdef ") for _ in range(m))
        changed = list(item)
        for _ in range(r.randrange(0, m // 6 + 2)):
            k, kind = r.randrange(len(changed) + 1), r.random()
            if kind < 0.4 and changed:
                changed[k % len(changed)] = r.choice("abcdef ")
            elif kind < 0.7:
                changed.insert(k, r.choice("abcdef "))
            elif changed:
                del changed[k % len(changed)]
        noise = ["".join(r.choice("abcdef ") for _ in range(r.randrange(60))) for _ in range(2)]
        text = noise[0] + "".join(changed) + noise[1]
        items = Items([(7, item)], LeakRule())
        found = leaks([None, "", text, item.upper()], items)
        within = semi_global(item, text) <= items.budget[0]
        positive += within
        assert bool(found[2]) == within and found[0] == found[1] == []
        assert found[3] == [(7, 0, m, 0)]
        for _, a, b, edits in found[2]:
            assert semi_global(item, text[a:b]) == edits <= items.budget[0]
    assert positive > 40


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([
        (1, "the quick brown fox jumps over the lazy dog near the river"), (2, "pack my box with five dozen liquor jugs before noon today"),
        (3, "short"), (4, None), (None, "an item without a number but of proper length"), (5, "pack my box with five dozen liquor jugs before noon today"),
    ], "item_id long, text string")


def test_documents(docs_of, benchmark):
    rows = [(1, "Before. THE QUICK BROWN\tFOX jumps over the lazy dog near the river! after"), (2, "the quick brown cat jumped over a lazy dog"),
            (3, "x pack my box with five dozn liquor jugs before noon todai y"), (4, "an item without a number but of proper length"), (5, "short")]
    found = {r.doc_id: [tuple(x) for x in r.leaks] for r in find_leaks(docs_of(rows), benchmark).collect()}
    assert found[1] == [(1, 8, 66, 0)] and found[2] == [] and found[5] == []
    assert [(i, e) for i, _, _, e in found[3]] == [(2, 2), (5, 2)]
    assert found[4] == [(None, 0, 45, 0)]


def test_blocks_find_the_same(docs_of, benchmark, sample, spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = find_leaks(sample, bench, carry=["doc_id"])
    many = find_leaks(sample, bench, LeakRule(block_chars=1500), carry=["doc_id"])
    as_rows = lambda df: sorted((r.doc_id, [tuple(x) for x in r.leaks]) for r in df.collect())
    assert as_rows(one) == as_rows(many)
    items = {r.item_id: "".join(map(chr, folded(r.text))) for r in bench.collect()}
    expected = {(r.doc_id, i) for r in sample.collect() for i, t in items.items() if t in "".join(map(chr, folded(r.text)))}
    exact = one.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*").filter("edits = 0").collect()
    assert {(r.doc_id, r.item_id) for r in exact} == expected and expected


def test_edges(docs_of, edge_rows, benchmark):
    df = docs_of(edge_rows, Leaks="old")
    rows = find_leaks(df, benchmark).collect()
    assert len(rows) == len(edge_rows) and all(r.leaks == [] for r in rows)
    assert find_leaks(df.filter("false"), benchmark).count() == 0
    assert all(r.leaks == [] for r in find_leaks(df, benchmark.filter("false")).collect())
