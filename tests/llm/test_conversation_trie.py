"""The trie against a brute-force one, over random conversations and each way of cutting them into blocks and shards."""
import hashlib
import math
import random
from collections import defaultdict
from zlib import crc32

import pytest

from tremorline.llm import conversation_trie
from tremorline.llm.conversation_trie import prefix_trie, rebuild_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_order(row):
    role, text = row[2] or "", row[3] or ""
    return row[1] is not None, row[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=turn_order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = crc32(str(c).encode()) % 6
        path = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, ids in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(ids) - 1) * len(path[-1][1]) if path else 0
    return sorted((len(p), min(m), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def found(df):
    rows = [tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in prefix_trie(rebuild_conversations(df)).collect()]
    return sorted(rows)


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 3), n):
        for t in range(rng.choice([1, 2, 3, 5, 8, 30])):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["", "a", "bé", "日本", None])))
    return rows


@pytest.mark.parametrize("cells, fan", [(1 << 20, 256), (50, 2), (7, 2)])
def test_random(spark, monkeypatch, cells, fan):
    monkeypatch.setattr(conversation_trie, "CELLS", cells)
    monkeypatch.setattr(conversation_trie, "FAN", fan)
    rows = random_rows(cells, 150)
    rows += [(100 * i + 7, t, "user", "hot") for i in range(10, 150) for t in range(6)]  # one large group of copies
    rows += [(5_000_000 + i, 0, "user", "the same first turn") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df) == brute(rows)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "IDS", 3)
    long = [(10_000, t, "user", f"t{t}") for t in range(150)] + [(20_000, t, "user", f"t{t}") for t in range(149)]
    rows = [(None, 0, "user", "left out"), (0, None, None, None), (0, 0, "user", "x"), (1, 0, "user", "x" * 100_000), (301, 5, "a", "b"), (301, 5, "a", "b"),
            (301, 5, "b", "a"), (-5, 1, "user", "neg"), (402, 0, "only", "base is absent"), *long]
    # Conversations whose shared part is longer than their own and whose base is absent have no turns.
    lone = next(c for c in range(901, 999) if crc32(str(c).encode()) % 6 == 5)
    rows += [(lone, 0, "user", "gone")] + [(c, 0, "user", "gone") for c in range(1101, 1199)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("own", "head", "base", "turns", "path"):
        df = df.selectExpr("*", f"'clash' as {c}")
    assert found(df) == brute(rows)
    assert found(df.filter("false")) == []


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
