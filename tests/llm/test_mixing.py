import hashlib
import math
from collections import Counter

import pytest

from tremorline.llm.mixing import mix_sources


def _uniform(*parts):
    text = "|".join("~" if p is None else str(p) for p in parts)
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def _poisson(mean, u):
    k, term = 0, math.exp(-mean)
    total = term
    while total < u:
        k += 1
        term *= mean / k
        total += term
    return k


def test_counts_follow_the_inverse_distribution(docs_of, spark):
    rows = [(i, "x" * (i % 7), "a" if i % 3 else "b") for i in range(600)] + [(1000 + i, "tiny", "c") for i in range(4)] + [(2000, "n", None)]
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("gone", 4.0), ("zero", 0.0)], "source string, weight double")
    got = mix_sources(docs_of(rows), weights).collect()
    size = Counter()
    for i, t, s in rows:
        size[s] += len(t) + 1
    total, weight = sum(size.values()), {"a": 1.0, "b": 2.0, "c": 3.0}
    expected = Counter()
    for i, t, s in rows:
        if s in weight:
            rate = weight[s] / 6 * total / size[s]
            parts = max(1, math.ceil(rate / 16))
            expected[i] = sum(_poisson(rate / parts, _uniform("copies 0", i, p)) for p in range(1, parts + 1))
    assert Counter(r.doc_id for r in got) == +expected
    assert max(expected.values()) > 20  # the tiny source is repeated in parts
    mass = Counter()
    for r in got:
        mass[r.source] += len(r.text) + 1
    assert abs(mass["b"] / sum(mass.values()) - 1 / 3) < 0.08
    assert {(r.doc_id, r["copy"]) for r in got} == {(i, k) for i, n in expected.items() for k in range(1, n + 1)}


def test_order_is_global_and_repeatable(sample):
    a, b = (mix_sources(sample.repartition(n)) for n in (2, 5))
    rows = a.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, b.collect()))
    keys = [r.mix_key for r in rows]
    first = [r.doc_id for r in sorted(rows, key=lambda r: r.mix_key)][:40]
    assert len(set(keys)) == len(keys) and first != sorted(first)


def test_edges(docs_of, edge_rows):
    df = docs_of(edge_rows, copy="old", Rate="old")
    rows = mix_sources(df).collect()
    assert set(rows[0].asDict()) == {"doc_id", "text", "source", "copy", "rate", "mix_key"}
    counts = Counter((r.doc_id, r.text) for r in rows)
    assert counts[7, "the same row"] % 2 == 0  # equal rows get equal counts
    assert all(r.rate == pytest.approx(1.0) for r in rows)
    assert mix_sources(df.filter("false")).count() == 0
