import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tests.llm.brute import words
from tremorline.llm import gru, lm
from tremorline.llm.lm import LmRule, count_tokens, fit_language_model, score_corpus

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SMALL = gru.Shape(hidden=4, classes=3, members=5, groups=2)


@pytest.fixture()
def weights():
    random = np.random.default_rng(1)
    w = gru.start(np.arange(15, 0, -1) * 10.0, np.array([30.0, 20.0]), SMALL, 1)
    return {k: v.astype(np.float64) if "bias" in k else random.standard_normal(v.shape) for k, v in w.items()}


def test_probabilities_sum_to_one(weights):
    h = np.random.default_rng(2).standard_normal((3, 4))
    total = sum(np.exp(gru.log_probabilities(weights, h, np.full(3, t), SMALL)) for t in range(17))
    assert np.allclose(total, 1)


def test_gradients(weights):
    random = np.random.default_rng(3)
    tokens, valid = random.integers(0, 17, (6, 3)), np.ones((6, 3), bool)
    valid[4:, 1] = False

    def mean(w):
        h, total = np.zeros((3, 4)), 0
        for t in range(6):
            total += (gru.log_probabilities(w, h, tokens[t], SMALL) * valid[t]).sum()
            h = gru._advance(w, tokens[t], h)
        return total / valid.sum()

    gradients, _ = gru._gradients(weights, tokens, valid, np.zeros((3, 4)), SMALL)
    for name, values in weights.items():
        for _ in range(8):
            at = tuple(random.integers(0, s) for s in values.shape)
            up, down = ({k: v.copy() for k, v in weights.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert abs((mean(up) - mean(down)) / 2e-5 - gradients[name][at]) < 1e-7


def test_state_is_carried_across_windows(weights):
    tokens, begins = np.random.default_rng(4).integers(0, 17, 40), np.array([0, 25, 26, 40])
    for window in (3, 100):
        for (a, b), score in zip(zip(begins[:-1], begins[1:]), gru.score_texts(weights, tokens, begins, SMALL, window)):
            h, total = np.zeros((1, 4)), 0
            for t in tokens[a:b]:
                total += gru.log_probabilities(weights, h, np.array([t]), SMALL)[0]
                h = gru._advance(weights, np.array([t]), h)
            assert score == pytest.approx(total)


def brute(rows):
    tokens = [[*words((t or "").translate(LOW)), None] for _, t in rows]
    out = [crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for ws, held in zip(tokens, out) for w in ws if not held)
    n, v = sum(c.values()), len(c)
    return [(held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
            for ws, held in zip(tokens, out)]


def check(rows, expected):
    assert len(rows) == len(expected)
    key = lambda x: (x[0], x[1], x[2], round(x[4], 6))
    for r, e in zip(sorted(((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=key), sorted(expected, key=key)):
        assert r[:4] == e[:4] and r[4] == pytest.approx(e[4], rel=1e-9)


@pytest.mark.parametrize("table", [262_144, 300, 1])
def test_base_scores_whatever_the_table_holds(sample, table):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    found = score_corpus(sample, LmRule(table=table, every=50)).collect()
    check(found, brute(rows))
    assert all(r.score < 0 for r in found)


def test_same_scores_from_table_and_join(sample):
    a, b = ({r.doc_id: r.score for r in score_corpus(sample, LmRule(table=t, every=10**9, shape=gru.Shape(classes=2, members=8))).collect()}
            for t in (262_144, 400))
    assert all(a[i] == pytest.approx(b[i], rel=1e-5) for i in a)


def test_beats_word_frequencies_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = score_corpus(docs).filter("held_out").collect()
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.9 * len(rows)


def test_training_does_not_depend_on_partitions(sample):
    rule = LmRule(task_tokens=3000)
    models = [fit_language_model(df, count_tokens(df, rule), rule) for df in (sample.repartition(2), sample.repartition(5))]
    assert np.allclose(models[0].weights, models[1].weights)
    untrained = fit_language_model(sample, count_tokens(sample, rule), LmRule(task_tokens=3000, every=10**15))
    assert np.abs(models[0].weights - untrained.weights).max() > 0.01  # a step or two of 0.01 each at this size


def test_edges(docs_of, edge_rows):
    df = docs_of(edge_rows, score="old", n_tokens="old")
    check(score_corpus(df).collect(), brute(edge_rows))
    empty = df.filter("false")
    assert score_corpus(empty).count() == 0
    held = [(i, t) for i, t in edge_rows if crc32(("" if i is None else str(i)).encode()) % 5 == 1] + [(1, "x y")]
    only_held = docs_of([(i, t) for i, t in held if crc32(str(i).encode()) % 5 == 1])
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in score_corpus(only_held).collect())


def test_every_block_trains_once_in_rounds(sample, monkeypatch):
    rule = LmRule(task_tokens=6000)
    counted = count_tokens(sample, rule)
    total = sum(r.c for r in counted.collect())
    shares, trained = [], lm._trained

    def watched(blocks, start, rule):
        rows = blocks.collect()
        shares.append((len({r.task for r in rows}), sum(len(r.tokens) for r in rows) // np.dtype(lm._packed(rule.shape)).itemsize, start))
        return trained(blocks, start, rule)

    monkeypatch.setattr(lm, "_trained", watched)
    lm.fit_language_model(sample, counted, rule)
    assert sum(tokens for _, tokens, _ in shares) == total
    assert [n for n, _, _ in shares] == list(range(1, len(shares) + 1)) and len(shares) > 2
    assert all(not np.array_equal(a, b) for (_, _, a), (_, _, b) in zip(shares, shares[1:]))


def test_rounds_grow_with_the_tokens():
    assert [lm._rounds(x) for x in (0, 1, 1.1, 3, 3.1, 6, 5050)] == [1, 1, 2, 2, 3, 3, 100]


def test_logits_are_worked_on_in_pieces_and_without_their_maxima():
    """A window's logits were held whole, and the largest of each row was looked for."""
    shape, room = gru.Shape(), gru._Room()
    random = np.random.default_rng(5)
    weights = gru.start(np.full(shape.words, 3), np.full(shape.groups, 5), shape, 1)
    tokens = random.integers(0, shape.words + shape.groups, (32, 64))
    gru._gradients(weights, tokens, np.ones((32, 64), bool), np.zeros((64, shape.hidden), np.float32), shape, room)
    assert max(len(held) for (name, _), held in room.held.items() if "error" in name) <= gru._ROWS * (shape.classes + shape.groups)
    top = np.concatenate([weights["by_class"], weights["class_bias"][None]])
    states = gru._with_one(random.uniform(-1, 1, (99, shape.hidden)).astype(np.float32), np.empty((99, shape.hidden + 1), np.float32))
    plain, moved = states @ top, top.copy()
    assert gru._shifted(moved) and (np.abs((states @ moved).max(1)) <= gru._REACH / 2).all()
    assert np.allclose(gru._log_of(states @ moved, np.arange(99) % 64, True), gru._log_of(plain.copy(), np.arange(99) % 64, False), atol=1e-5)


def test_wide_logits_keep_their_maxima():
    shape = SMALL
    weights = {k: v.astype(np.float64) for k, v in gru.start(np.ones(shape.words), np.ones(shape.groups), shape, 1).items()}
    weights["by_class"] *= 5000
    weights["by_word"] *= 5000
    random = np.random.default_rng(2)
    states, tokens = random.uniform(-1, 1, (60, shape.hidden)), random.integers(0, shape.words + shape.groups, 60)
    top = np.concatenate([weights["by_class"], weights["class_bias"][None]])
    assert not gru._shifted(top) and (top[-1] == weights["class_bias"]).all()
    found = gru.log_probabilities(weights, states, tokens, shape)

    def log_of(logits, at):
        return logits[at] - logits.max() - np.log(np.exp(logits - logits.max()).sum())

    for state, token, log in zip(states, tokens, found):
        c = token // shape.members if token < shape.words else token - shape.words + shape.classes
        expected = log_of(state @ weights["by_class"] + weights["class_bias"], c)
        if token < shape.words:
            expected += log_of(state @ weights["by_word"][c] + weights["word_bias"][c], token % shape.members)
        assert np.isfinite(log) and abs(log - expected) < 1e-8 * max(1, abs(expected))


def test_tokens_are_found_without_sorting_them(monkeypatch):
    """Hashes that share their leading bits, hashes next to these, an empty table and no tokens."""
    from types import SimpleNamespace

    random = np.random.default_rng(8)
    table = np.unique(np.concatenate([random.integers(0, 2**64, 500, np.uint64), np.uint64(5) + np.arange(0, 60, 3, dtype=np.uint64),
                                      ~np.arange(7, dtype=np.uint64)]))
    counts, numbers = random.integers(1, 99, len(table)), np.where(random.random(len(table)) < 0.5, np.arange(len(table)), -1)
    hashes = np.concatenate([table, table + np.uint64(1), table - np.uint64(1), random.integers(0, 2**64, 300, np.uint64)])
    random.shuffle(hashes)
    tokens = SimpleNamespace(hashes=hashes, groups=random.integers(0, 32, len(hashes)))
    model = lm.LanguageModel(LmRule(), table, counts, numbers, 1, 1, np.ones(32), np.ones(32), np.zeros(1))
    monkeypatch.setattr(np, "unique", None)
    at = {int(h): i for i, h in enumerate(table)}
    found, times = model.find(tokens)
    for h, group, number, c in zip(hashes.tolist(), tokens.groups, found, times):
        i = at.get(h)
        assert c == (-1 if i is None else counts[i])
        assert number == (gru.Shape().words + group if i is None or numbers[i] < 0 else numbers[i])
    none = SimpleNamespace(hashes=hashes[:0], groups=tokens.groups[:0])
    assert [len(x) for x in model.find(none)] == [0, 0]
    empty = lm.LanguageModel(LmRule(), table[:0], counts[:0], numbers[:0], 0, 0, np.ones(32), np.ones(32), np.zeros(1))
    assert (empty.find(tokens)[1] == -1).all() and (empty.find(tokens)[0] >= gru.Shape().words).all()
