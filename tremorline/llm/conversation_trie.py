"""Prefix trie of conversations from padded matrices of turn ids.

Conversations are sorted by their turns and dealt to range shards. A shard is worked off in blocks: a matrix with a row for each
conversation and a column for each turn, padded with 0, sorted by numpy's lexsort. OR-ing the changes from row to row along the
columns marks where a node starts, and reduceat over these marks sums up every depth, deepest first.
Nodes that hold neither the first nor the last row of a block are complete. The others lie on two paths, which stand for the block
from then on: two rows with partial sums, joined to the rows of the next block, then to those of other shards, and folded again.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorline.llm.text import whole
from tremorline.llm.words import mix
from tremorline.session import materialize

#: Cells of a block's matrix; a longer conversation is a block of its own.
CELLS = 1 << 20
#: So many shards are joined at once; their paths are two rows each.
FAN = 256
#: Ids in one piece of a list that spans blocks.
IDS = 10_000
#: Conversations by the hundred share a first one; at most so many turns of it lead another.
BASE, MOST_SHARED = 100, 5
_NONE = np.iinfo(np.int64).max
_KEY = 16  # bytes of a turn's MD5
_SUMS = ("n", "least", "ended", "children", "leaves", "saved")

FOUND = T.StructType([
    T.StructField("kind", T.StringType()),
    # a node; its parent is given by id, or by the open path (of a block) that it lies on
    *[T.StructField(c, T.LongType()) for c in ("depth", "conv_id", "parent_conv_id", "parent_side", "n_convs", "n_children", "n_leaves",
                                               "saved_tokens", "low", "high")],
    T.StructField("ends", T.StringType()),
    T.StructField("ends_open", T.BooleanType()), T.StructField("was_open", T.BooleanType()),
    # where it was found, and a path with the keys (and, for the last ones of a shard, the sums) of its nodes
    *[T.StructField(c, T.LongType()) for c in ("level", "shard", "block", "side")],
    T.StructField("lows", T.ArrayType(T.LongType())), T.StructField("highs", T.ArrayType(T.LongType())),
    T.StructField("path", T.BinaryType()), T.StructField("sizes", T.ArrayType(T.IntegerType())),
    *[T.StructField(c, T.ArrayType(T.LongType())) for c in _SUMS],
])


def rebuild_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, ``path`` (the MD5s of its turns end to end) and ``sizes`` (code points of their texts).

    Turns are ordered by number, null first, equal numbers by the MD5 of role and text; null roles and texts read as empty. The first h
    turns are those of the conversation at the start of its hundred, h = crc32(decimal id) % 6, or none if there is no such
    conversation; its own turns after the first h follow. Rows without conv_id belong to no conversation and are left out.
    """
    role, text, conv = whole("role"), whole("text"), F.col("conv_id").cast("long")
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.length(text).alias("size"))
    turns = conversations.select(conv.alias("conv_id"), turn.alias("turn")).filter("conv_id is not null")
    # Dealt by hundreds, so that neither the grouping nor the window moves rows again.
    grouped = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE).repartition("base").groupBy("base", "conv_id").agg(
        F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, MOST_SHARED))).over(W.partitionBy("base"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    rebuilt = grouped.select("conv_id", "own", head.alias("head"), shared.alias("shared")).select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("shared")), F.slice("own", 1, 0)),
        F.slice("own", F.col("shared") + 1, F.size("own"))).alias("turns"))
    return rebuilt.select("conv_id", F.unhex(F.array_join("turns.key", "")).alias("path"), F.col("turns.size").alias("sizes"))


@dataclass
class Rows:
    """Paths with sums for each of their nodes: row i has ``length[i]`` turns and ``length[i] + 1`` nodes, the root first."""

    length: np.ndarray
    turns: np.ndarray  # two unsigned numbers for each turn
    size: np.ndarray
    sums: dict[str, np.ndarray]
    carried: np.ndarray  # stands for rows that were folded before
    ids: np.ndarray

    @classmethod
    def of_conversations(cls, batch: pa.RecordBatch) -> Rows:
        length, turns, size = _paths(batch)
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False).astype(np.int64)
        nodes = int(length.sum()) + len(length)
        sums = {c: np.zeros(nodes, np.int64) for c in _SUMS}
        sums["n"][:] = 1
        sums["least"] = np.repeat(ids, length + 1)
        sums["ended"][np.cumsum(length + 1) - 1] = 1
        return cls(length, turns, size, sums, np.zeros(len(length), bool), ids)

    @classmethod
    def of_edges(cls, batch: pa.RecordBatch) -> Rows:
        length, turns, size = _paths(batch)
        sums = {c: _values(batch.column(c)) for c in _SUMS}
        return cls(length, turns, size, sums, np.ones(len(length), bool), np.zeros(len(length), np.int64))

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        def both(get):
            return np.concatenate([get(p) for p in parts])
        return cls(both(lambda p: p.length), both(lambda p: p.turns), both(lambda p: p.size),
                   {c: both(lambda p, c=c: p.sums[c]) for c in _SUMS}, both(lambda p: p.carried), both(lambda p: p.ids))

    def path(self) -> bytes:
        return self.turns.astype(">u8").tobytes()


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _paths(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    paths = batch.column("path").cast(pa.large_binary())
    at = np.frombuffer(paths.buffers()[1], np.int64)[paths.offset:paths.offset + len(paths) + 1] if len(paths) else np.zeros(1, np.int64)
    data = paths.buffers()[2]
    turns = np.frombuffer(data, np.uint8)[at[0]:at[-1]].tobytes() if data is not None else b""
    return np.diff(at) // _KEY, np.frombuffer(turns, ">u8").astype(np.uint64).reshape(-1, 2), _values(batch.column("sizes"))


def _matrix(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, values.dtype)
    out[rows, columns] = values
    return out


class Folded:
    """Complete nodes of some rows, and, if ``open_ends``, the first and last path with the sums of the others."""

    def __init__(self, rows: Rows, open_ends: bool):
        n, deepest = len(rows.length), int(rows.length.max())
        of_turn = np.repeat(np.arange(n), rows.length)
        turn_at = np.arange(len(of_turn)) - np.repeat(np.cumsum(rows.length) - rows.length, rows.length)
        ids = self._sorted_ids(rows, of_turn, turn_at, (n, deepest))
        order = np.lexsort(ids.T[::-1]) if deepest else np.arange(n)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.rows, self.order, self.length, ids = rows, order, rows.length[order], ids[order]
        carried = rows.carried[order]

        self.starts = np.ones((n, deepest + 1), bool)  # a node of depth d starts in this row, if the row is that long
        self.starts[1:, 0] = False
        np.logical_or.accumulate(ids[1:] != ids[:-1], axis=1, out=self.starts[1:, 1:])
        node_at = np.arange(len(of_turn) + n) - np.repeat(np.cumsum(rows.length + 1) - rows.length - 1, rows.length + 1)
        of_node = place[np.repeat(np.arange(n), rows.length + 1)]
        sums = {c: _matrix(of_node, node_at, v, (n, deepest + 1)) for c, v in rows.sums.items()}
        size = _matrix(place[of_turn], turn_at + 1, rows.size, (n, deepest + 1))
        self.low, self.high = self._node_keys(rows.turns, place[of_turn], turn_at, (n, deepest))

        self.first = {c: np.zeros(self.length[0] + 1, np.int64) for c in _SUMS}
        self.last = {c: np.zeros(self.length[-1] + 1, np.int64) for c in _SUMS}
        self.last["least"][:] = _NONE  # nodes on both paths are summed in the first
        self.ends_open = np.zeros(n, bool)  # rows of which members end in an open node
        found = []
        for d in range(deepest, -1, -1):
            alive = np.flatnonzero(self.length >= d)
            at = np.flatnonzero(self.starts[alive, d])
            begins = alive[at]
            total = {c: (np.minimum if c == "least" else np.add).reduceat(sums[c][alive, d], at) for c in _SUMS}
            is_open = np.zeros(len(at), np.int64)
            if open_ends and alive[-1] == n - 1:
                is_open[-1] = 2
                for c in _SUMS:
                    self.last[c][d] = total[c][-1]
            if open_ends and alive[0] == 0:
                if is_open[0]:
                    for c in _SUMS:
                        self.last[c][d] = _NONE if c == "least" else 0
                is_open[0] = 1
                for c in _SUMS:
                    self.first[c][d] = total[c][0]
            done = is_open == 0
            self.ends_open[begins[~done]] |= self.length[begins[~done]] == d
            total["leaves"] += total["children"] == 0
            total["saved"] += (total["n"] - 1) * size[begins, d]
            if d:
                sums["children"][begins[done], d - 1] += 1
                sums["leaves"][begins[done], d - 1] += total["leaves"][done]
                sums["saved"][begins[done], d - 1] += total["saved"][done]
            found.append((begins, total, is_open, np.logical_or.reduceat(carried[alive], at)))
        self.depths = found[::-1]

    @staticmethod
    def _sorted_ids(rows: Rows, of_turn, turn_at, shape) -> np.ndarray:
        """Turns as numbers from 1 in the order of their keys, a row for each path, 0 where it has ended."""
        by_key = np.lexsort((rows.turns[:, 1], rows.turns[:, 0]))
        ordered = rows.turns[by_key]
        number = np.ones(len(by_key), np.int64)
        number[by_key] = 1 + np.concatenate([[0], np.cumsum((ordered[1:] != ordered[:-1]).any(axis=1))])[:len(by_key)]
        return _matrix(of_turn, turn_at, number, shape)

    @staticmethod
    def _node_keys(turns, of_turn, turn_at, shape) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each node, chained along its path; the same in every block."""
        keys = []
        for lane, other in ((0, 1), (1, 0)):
            own = _matrix(of_turn, turn_at, mix(turns[:, lane]) ^ turns[:, other], shape)
            chain = np.full((shape[0], shape[1] + 1), 0x9E3779B97F4A7C15 + lane, np.uint64)
            for d in range(shape[1]):
                chain[:, d + 1] = mix(chain[:, d] * np.uint64(0xD1342543DE82EF95) + own[:, d] + np.uint64(1))
            keys.append(chain.view(np.int64))
        return keys[0], keys[1]

    def end_runs(self) -> tuple[np.ndarray, list[str | None], list[tuple[int, int, int, str]]]:
        """For each row that starts a run of equal paths: whether the run or its node goes on in other blocks, the digest of its ids if not,
        else these ids in pieces."""
        n = len(self.length)
        fresh = np.ones(n, bool)
        if n > 1:
            same = self.length[1:] == self.length[:-1]
            fresh[1:] = ~(same & ~self.starts[np.arange(1, n), self.length[1:]])
        begins = np.flatnonzero(fresh)
        ends = np.append(begins[1:], n)
        carried = self.rows.carried[self.order]
        shared = np.logical_or.reduceat(carried, begins) | self.ends_open[begins]
        is_shared = np.zeros(n, bool)
        is_shared[begins] = shared
        ids = self.rows.ids[self.order]
        digests, pieces = [None] * n, []
        for begin, end, more in zip(begins.tolist(), ends.tolist(), shared.tolist()):
            own = np.sort(ids[begin:end][~carried[begin:end]]).tolist()
            if not more:
                digests[begin] = hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
                continue
            at = self.length[begin]
            pieces += [(int(self.low[begin, at]), int(self.high[begin, at]), own[i], ",".join(map(str, own[i:i + IDS])))
                       for i in range(0, len(own), IDS)]
        return is_shared, digests, pieces

    def paths(self) -> list[Rows]:
        """The first and the last path, each with the sums of its open nodes."""
        out = []
        at = np.cumsum(self.rows.length) - self.rows.length
        for row, sums in ((0, self.first), (-1, self.last)):
            i = self.order[row]
            turns = slice(at[i], at[i] + self.rows.length[i])
            out.append(Rows(self.length[[row]], self.rows.turns[turns], self.rows.size[turns], sums, np.ones(1, bool), np.zeros(1, np.int64)))
        return out


def _batch(**columns) -> pa.RecordBatch:
    """A batch of FOUND with the given columns, the others null."""
    n = len(next(v for v in columns.values() if not isinstance(v, (str, int))))
    arrays = []
    for field in FOUND.fields:
        kind = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
                "array<int>": pa.list_(pa.int32())}[field.dataType.simpleString()]
        value = columns.get(field.name)
        if value is None:
            arrays.append(pa.nulls(n, kind))
        elif isinstance(value, (str, int)):
            arrays.append(pa.array([value] * n, kind))
        else:
            arrays.append(value if isinstance(value, pa.Array) else pa.array(value, kind))
    return pa.RecordBatch.from_arrays(arrays, FOUND.names)


_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _told(folded: Folded, open_ends: bool, level: int, shard: int, block: int) -> Iterator[pa.RecordBatch]:
    """What one fold found, as rows of FOUND."""
    where = {"level": level, "shard": shard, "block": block}
    is_shared, digests, pieces = folded.end_runs()
    if pieces:
        low, high, first, text = zip(*pieces)
        yield _batch(kind="ids", low=low, high=high, conv_id=first, ends=text)
    above = None
    for d, (begins, total, is_open, was_open) in enumerate(folded.depths):
        done = np.flatnonzero(is_open == 0)
        if len(done):
            b = begins[done]
            columns = {"kind": "node", "depth": d, **where, "conv_id": total["least"][done], "n_convs": total["n"][done],
                       "n_children": total["children"][done], "n_leaves": total["leaves"][done], "saved_tokens": total["saved"][done],
                       "low": folded.low[b, d], "high": folded.high[b, d], "was_open": was_open[done]}
            if above is not None:
                parent = np.searchsorted(above[0], b, "right") - 1
                side = above[2][parent]
                columns["parent_side"] = side
                columns["parent_conv_id"] = pa.array(above[1]["least"][parent], pa.int64(), mask=side > 0)
            else:
                columns["parent_side"] = np.zeros(len(done), np.int64)
            in_block = (folded.length[b] == d) & ~is_shared[b]
            columns["ends_open"] = ~in_block & (total["ended"][done] > 0)
            columns["ends"] = [digests[row] if here else _NO_ENDS for row, here in zip(b.tolist(), in_block.tolist())]
            yield _batch(**columns)
        above = begins, total, is_open
    if open_ends:
        rows = (0, len(folded.length) - 1)
        lows, highs = ([m[r, :folded.length[r] + 1].tolist() for r in rows] for m in (folded.low, folded.high))
        yield _batch(kind="path", **where, side=[1, 2], lows=lows, highs=highs)


def _edges(paths: list[Rows], level: int, shard: int) -> pa.RecordBatch:
    return _batch(kind="edge", level=level, shard=shard, side=[1, 2], path=[p.path() for p in paths], sizes=[p.size.tolist() for p in paths],
                  **{c: [p.sums[c].tolist() for p in paths] for c in _SUMS})


def _blocks(rows: Rows, spare: int) -> Iterator[Rows]:
    """Consecutive rows whose matrix, with a column for each of ``spare`` turns at least, has about CELLS cells."""
    start, widest = 0, spare
    at = np.concatenate([[0], np.cumsum(rows.length)])

    def cut(a, b):
        nodes = slice(at[a] + a, at[b] + b)
        return Rows(rows.length[a:b], rows.turns[at[a]:at[b]], rows.size[at[a]:at[b]], {c: v[nodes] for c, v in rows.sums.items()},
                    rows.carried[a:b], rows.ids[a:b])

    for i, length in enumerate(rows.length.tolist()):
        wider = max(widest, length)
        if i > start and (i - start + 1) * (wider + 1) > CELLS:
            yield cut(start, i)
            start, wider = i, max(spare, length)
        widest = wider
    if start < len(rows.length):
        yield cut(start, len(rows.length))


def _fold_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard, block by block; the open paths of a block are rows of the next."""
    shard, carry, block = TaskContext.get().partitionId(), [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        for rows in _blocks(Rows.of_conversations(batch), max((int(p.length[0]) for p in carry), default=0)):
            folded = Folded(Rows.joined([*carry, rows]), True)
            yield from _told(folded, True, 0, shard, block)
            carry, block = folded.paths(), block + 1
    if carry:
        yield _edges(carry, 0, shard)


def _fold_edges(level: int, open_ends: bool):
    """Fold the paths of some shards that follow one another; they become one shard of the level above."""
    def fold(key, table):
        rows = Rows.joined([Rows.of_edges(b) for b in table.combine_chunks().to_batches()])
        folded, shard = Folded(rows, open_ends), key[0].as_py()
        out = [*_told(folded, open_ends, level, shard, 0)]
        if open_ends:
            out.append(_edges(folded.paths(), level, shard))
        return pa.Table.from_batches(out)
    return fold


def _digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key, over its pieces in order; a list passes by as a stream."""
    key, digest = None, None
    for batch in batches:
        found = []
        for low, high, text in zip(*[batch.column(c).to_pylist() for c in ("low", "high", "ends")]):
            if (low, high) != key:
                if key is not None:
                    found.append((*key, digest.hexdigest()))
                key, digest = (low, high), hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if found:
            yield _digests(found)
    if key is not None:
        yield _digests([(*key, digest.hexdigest())])


def _digests(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
    low, high, text = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(text, pa.string())], ["low", "high", "ends"])


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """Nodes of the trie over ``rebuilt`` (see ``rebuild_conversations``), one row each.

    conv_id is the smallest member, parent_conv_id that of the parent (null for the root), n_convs the members, n_children and n_leaves
    count children and childless nodes of the subtree, saved_tokens sums (n_convs - 1) * code points of the last text over the
    subtree, ends_sha256 digests the ids of the members that end in the node (decimal, ascending, comma-joined); node_id is the node's
    own key. No conversations give no rows, not even a root; one without turns is a member of the root only. A task holds one block
    and two paths; a conversation's turns (24 bytes each) have to fit. Ids that share an end are hashed as one stream, as
    SHA-256 has no parts, but in pieces of 10,000 that blocks have joined before.
    """
    spark = rebuilt.sparkSession
    stored = materialize(rebuilt.select("conv_id", "path", "sizes"), "rebuilt")
    # Sorting by id as well lets copies of one conversation be dealt to several shards.
    shards = stored.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    levels = [materialize(shards.mapInArrow(_fold_shard, FOUND), "trie")]
    while True:
        edges = levels[-1].filter("kind = 'edge'").select("shard", "path", "sizes", *_SUMS)
        last = (edges.agg(F.max("shard")).first()[0] or 0) < FAN
        grouped = edges.groupBy((F.col("shard") / FAN).cast("long").alias("group"))
        levels.append(materialize(grouped.applyInArrow(_fold_edges(len(levels), not last), FOUND), "trie"))
        if last:
            break
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)

    nodes, by_key = found.filter("kind = 'node'"), ["low", "high"]
    lists = found.filter("kind = 'ids'").select(*by_key, "conv_id", "ends").repartition(*by_key).sortWithinPartitions(*by_key, "conv_id")
    digests = lists.mapInArrow(_digest_lists, "low long, high long, ends string")
    # Open paths by block, so that the many children of a node find it in their own block's table, not all under one key.
    place = ["level", "shard", "block", "side", "depth"]
    on_paths = found.filter("kind = 'path'").select(*place[:-1], F.posexplode(F.arrays_zip("lows", "highs")).alias("depth", "node")).select(
        *place, F.col("node.lows").alias("low"), F.col("node.highs").alias("high"))
    parents = on_paths.join(nodes.filter("was_open").select(*by_key, F.col("conv_id").alias("parent")), by_key).select(*place, "parent")
    orphans = nodes.filter("parent_side > 0").withColumns({"side": F.col("parent_side"), "_depth": F.col("depth"), "depth": F.col("depth") - 1})
    adopted = orphans.drop("parent_conv_id").join(parents, place).withColumns({"parent_conv_id": F.col("parent"), "depth": F.col("_depth")})
    nodes = nodes.filter("parent_side = 0").select(*FOUND.names).unionByName(adopted.select(*FOUND.names))
    told = nodes.filter("not ends_open").unionByName(nodes.filter("ends_open").drop("ends").join(digests, by_key).select(*FOUND.names))
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.col("ends").alias("ends_sha256"), F.lower(F.concat(F.lpad(F.hex("low"), 16, "0"), F.lpad(F.hex("high"), 16, "0"))).alias("node_id"))
