import random
from collections import Counter, defaultdict

from tests.llm.brute import words
from tremorline.llm.components import components
from tremorline.llm.jaccard_join import JaccardJoin, _batch_of_runs, _order, _tokens, first_of_each, jaccard_join


def brute(rows):
    """(class, links) by row number."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    by_shingle, links = defaultdict(list), [set() for _ in rows]
    for i, s in enumerate(sets):
        shared = Counter(k for x in s for k in by_shingle[x])
        for k, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[k]) - n):
                links[i].add(k)
                links[k].add(i)
        for x in s:
            by_shingle[x].append(i)
    out = {}
    for i in range(len(rows)):
        if i not in out:
            group, todo = {i}, [i]
            while todo:
                for k in links[todo.pop()] - group:
                    group.add(k)
                    todo.append(k)
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            for k in group:
                out[k] = (min(ids) if ids else None, len(links[k]))
    return sorted(((rows[i][0], *out[i]) for i in out), key=repr)


def got(df, rule=JaccardJoin()):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(df, rule).collect()), key=repr)


def _near(r, base, most):
    w = list(base)
    for _ in range(r.randrange(most + 1)):
        w[r.randrange(len(w))] = str(r.randrange(9999))
    return " ".join(w)


def test_groups_of_near_copies(docs_of):
    r = random.Random(1)
    base = [str(r.randrange(9999)) for _ in range(100)]
    rows = [(i, _near(r, base, 3)) for i in range(90)]
    # A frequent passage, no near copies: one large bucket that has to be split.
    rows += [(1000 + i, " ".join(base[:50] + [str(r.randrange(9999)) for _ in range(50)])) for i in range(60)]
    rows += [(2000 + i, rows[3][1]) for i in range(5)] + [(3000, "x " * 500), (3001, "x " * 9), (3002, "a b c"), (3003, "a  b\nc"), (3004, "a b")]
    assert got(docs_of(rows), JaccardJoin(bucket=16, block=7)) == brute(rows)


def test_edges(docs_of, edge_rows):
    df = docs_of(edge_rows, Class_ID="old")
    assert got(df) == brute(edge_rows)
    kept = first_of_each(df)
    assert kept.columns == df.columns and {r["Class_ID"] for r in kept.collect()} == {"old"}
    found = sorted(((r.doc_id, (r.text or "")[:20]) for r in kept.collect()), key=repr)
    assert found == sorted([(1, ""), (2, ""), (3, " \n\t "), (4, "one"), (5, edge_rows[4][1][:20]), (7, "the same row"), (None, "no id here"), (None, ""),
                            (8, "é ü ß 日本"), (9, "x " * 10)], key=repr)
    assert jaccard_join(df.filter("false")).count() == 0


def test_table(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert got(sample) == brute(rows)
    classes = {c for _, c, _ in brute(rows)}
    assert {r.doc_id for r in first_of_each(sample).collect()} == classes


def test_components(spark):
    r = random.Random(2)
    edges = [(f"{a:03d}", f"{b:03d}") for a, b in [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
             + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    loops = {v for e in edges for v in e if e[0] == e[1]}
    rows = {x.v: x.root for x in components(spark.createDataFrame(edges, "v string, u string").repartition(4)).collect()}
    assert all(rows[v] == find(v) for v in rows)
    assert set(parent) - loops <= set(rows)
    assert components(spark.createDataFrame([], "v string, u string")).count() == 0


def test_near_pairs_inside_a_frequent_passage(docs_of):
    r = random.Random(5)
    passage = [str(r.randrange(9999)) for _ in range(80)]
    rows = []
    for i in range(60):
        own = [str(r.randrange(9999)) for _ in range(20)]
        rows.append((2 * i, " ".join(passage + own)))
        rows.append((2 * i + 1, " ".join(passage + own[:10] + [str(r.randrange(9999)) for _ in range(10)])))
    rule = JaccardJoin(bucket=16, block=7)
    df = docs_of(rows)
    assert got(df, rule) == brute(rows)
    records = _tokens(df.selectExpr("md5(text) AS tid", "text"), rule).collect()
    ends = {(e.tid, e.run): e for e in _batch_of_runs(_tokens(df.selectExpr("md5(text) AS tid", "text"), rule), rule, range(rule.runs)).collect()}
    split = 0
    for run in range(rule.runs):
        at = _order(rule, run)[0]
        size = Counter(x.tokens[at] for x in records)
        for x in records:
            if size[x.tokens[at]] > rule.bucket:  # split, so its depth has to be known, alone or not
                assert ends[x.tid, run].depth > 1 or ends[x.tid, run].size > rule.bucket
                split += ends[x.tid, run].size == 1
    assert split > 0
