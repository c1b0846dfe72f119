import random
from collections import Counter
from hashlib import sha256

from tests.llm.brute import words
from tremorline.llm.substring_dedup import remove_repeats


def brute(rows, length):
    found = [words(t) for _, t in rows]
    counts = Counter(tuple(w[j:j + length]) for w in found for j in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, found):
        gone = set()
        for j in range(len(w) - length + 1):
            if counts[tuple(w[j:j + length])] > 1:
                gone.update(range(j, j + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def got(df, length):
    rows = remove_repeats(df, length).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in rows), key=repr)


def test_against_brute_force(docs_of):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("ab" if i % 2 else "abcdefgh") for _ in range(r.choice([0, 3, 34, 35, 36, 70, 200])))) for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(500 + i, f"{'q ' * i}start{i} {passage} end{i}") for i in range(6)]
    rows += [(600, " ".join(f"p{i}" for i in range(34))), (601, passage[:150]), (602, rows[7][1])]
    for length in (35, 7, 2, 1):
        assert got(docs_of(rows), length) == brute(rows, length)


def test_edges(docs_of, edge_rows):
    df = docs_of(edge_rows, n_words="old")
    assert got(df, 35) == brute(edge_rows, 35)
    assert remove_repeats(df.filter("false")).count() == 0
    assert "kept_text" not in remove_repeats(df, texts=False).columns


def test_table(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert got(sample, 35) == brute(rows, 35)
