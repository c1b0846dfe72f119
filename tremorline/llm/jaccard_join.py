"""Joining documents of high word n-gram Jaccard similarity along chosen paths."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.llm.components import components
from tremorline.llm.text import set_aside, whole, without
from tremorline.llm.words import Texts, pieces, slice_hashes, texts_of
from tremorline.session import materialize


@dataclass(frozen=True)
class JaccardJoin:
    shingle: int = 5
    threshold: float = 0.8
    #: Runs are repeated in batches until a pair at the threshold is met with at least this probability.
    recall: float = 0.999
    runs: int = 8
    #: Sampled tokens (minima of seeded hashes over the shingles) kept for each document.
    tokens: int = 48
    #: Buckets up to this size are compared by brute force, larger ones are split.
    bucket: int = 4096
    #: Buckets are compared in tiles of two such blocks.
    block: int = 256
    #: A bucket whose pairs agree in so many sampled tokens on average is mostly links: it is compared, not split.
    dense: float = 0.7
    #: A bucket that is still larger after so many splits is compared in tiles.
    depth: int = 6
    #: Pairs that agree in a smaller share of the sampled tokens are not compared; a pair at the threshold falls short of one half
    #: with a probability under one in 100,000.
    sketch: float = 0.5
    seed: int = 11


def _shingles(texts: Texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and where those of each text begin; a text of fewer words is one shingle."""
    first, hashes = texts.windows(length)
    counts = np.bincount(texts.owner[first], minlength=len(texts)) if len(first) else np.zeros(len(texts), np.int64)
    n_words = np.diff(texts.bounds)
    short = np.flatnonzero((n_words > 0) & (n_words < length))
    if len(short):
        whole_text = slice_hashes(texts.word_hashes, texts.bounds[short], texts.bounds[short + 1])
        at = np.concatenate([[0], np.cumsum(counts)])[short]
        hashes = np.insert(hashes, at, whole_text)
        counts[short] = 1
    return hashes, np.concatenate([[0], np.cumsum(counts)])


def _tokens(docs: DataFrame, rule: JaccardJoin) -> DataFrame:
    """``(tid, n, tokens)`` of every distinct text that has words; n counts its documents."""
    factors = np.random.default_rng(rule.seed).integers(1, 2**63, rule.tokens, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = texts_of(batch.column("text"))
            hashes, begins = _shingles(texts, rule.shingle)
            some = np.flatnonzero(np.diff(begins))
            minima = np.zeros((len(some), rule.tokens), np.int32)
            if len(some):
                for k, factor in enumerate(factors):
                    minima[:, k] = np.minimum.reduceat((hashes * factor) >> np.uint64(33), begins[some]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * rule.tokens), pa.array(minima.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(some)), lists], ["tid", "tokens"])

    found = docs.select("tid", "text").mapInArrow(run, "tid string, tokens array<int>")
    return found.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.first("tokens").alias("tokens"))


def _path(run: Column, *steps: Column) -> Column:
    return F.xxhash64(run, *steps)


def _order(rule: JaccardJoin, run: int) -> list[int]:
    """Which token a run splits by at each depth."""
    return np.random.default_rng([rule.seed, run]).permutation(rule.tokens)[:rule.depth + 8].tolist()


def _sized(rows: DataFrame, alone: bool = False) -> DataFrame:
    """Bucket rows with the size of their bucket, without those that are alone, or with them at path 0 and size 1."""
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    key = F.bitwise_not("path")  # not the key of the groups: AQE can then split the rows of a hot bucket
    out = rows.withColumn("_key", key).join(sizes.select(key.alias("_key"), "size"), "_key", "left" if alone else "inner").drop("_key")
    if not alone:
        return out
    return out.withColumn("path", F.when(F.col("size").isNull(), F.lit(0)).otherwise(F.col("path"))).withColumn("size", F.coalesce("size", F.lit(1)))


def _batch_of_runs(records: DataFrame, rule: JaccardJoin, runs: range) -> DataFrame:
    """``(tid, run, path, size, depth)``: the bucket in which each text ends in each run. A text that is alone before any split has no row;
    one that a split leaves alone has one of path 0 and size 1, as its depth counts for the chance to miss."""
    by_depth = {r: _order(rule, r) for r in runs}
    first = F.array(*[F.struct(F.lit(r).alias("run"), _path(F.lit(r), F.get("tokens", F.lit(by_depth[r][0]))).alias("path")) for r in runs])
    rows = records.select("tid", F.explode(first).alias("_b")).select("tid", "_b.run", "_b.path")
    rows = materialize(_sized(rows), "buckets")
    done = [rows.filter(F.col("size") <= rule.bucket).withColumn("depth", F.lit(1))]
    large = rows.filter(F.col("size") > rule.bucket)
    for depth in range(1, rule.depth + 1):
        if large.isEmpty():
            break
        if depth == rule.depth:
            done.append(large.withColumn("depth", F.lit(depth)))
            break
        orders = F.create_map(*[F.lit(x) for r in runs for x in (r, F.array(*[F.lit(i) for i in by_depth[r]]))])
        with_tokens = large.join(records.select("tid", "tokens"), "tid").withColumn("_order", orders[F.col("run")])
        with_tokens = materialize(with_tokens, "large")
        # Average similarity of a bucket's pairs, from the last eight tokens of the run's order.
        probes = with_tokens.select("path", "size", F.explode(F.slice("_order", -8, 8)).alias("_at"), "tokens").select(
            "path", "size", "_at", F.get("tokens", F.col("_at")).alias("_value"))
        dense = (
            probes.groupBy("path", "size", "_at", "_value").agg(F.count(F.lit(1)).alias("c")).groupBy("path", "size")
            .agg((F.sum(F.col("c").cast("double") * F.col("c")) / 8 / F.first("size") / F.first("size")).alias("likeness"))
            .select(F.bitwise_not("path").alias("_key"), (F.col("likeness") >= rule.dense).alias("dense"))
        )
        judged = materialize(with_tokens.withColumn("_key", F.bitwise_not("path")).join(dense, "_key").drop("_key"), "judged")
        done.append(judged.filter("dense").select("tid", "run", "path", "size", F.lit(depth).alias("depth")))
        split = judged.filter("not dense").select("tid", "run", _path(
            F.col("run"), F.col("path"), F.get("tokens", F.get("_order", F.lit(depth)))).alias("path"))
        rows = materialize(_sized(split, alone=True), "split")
        done.append(rows.filter(F.col("size") <= rule.bucket).withColumn("depth", F.lit(depth + 1)))
        large = rows.filter(F.col("size") > rule.bucket)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _missed(ends: DataFrame, rule: JaccardJoin, runs: int) -> float:
    """The largest probability, over texts, that all runs part it from a text at the threshold."""
    miss = F.ln(1 - F.pow(F.lit(rule.threshold), F.col("depth")))
    plain = math.log(1 - rule.threshold)
    worst = ends.filter("depth > 1").groupBy("tid").agg(
        (F.sum(miss) + (F.lit(runs) - F.count(F.lit(1))) * F.lit(plain)).alias("log")).agg(F.max("log")).first()[0]
    return math.exp(max(plain * runs, plain * runs if worst is None else worst))


def _with_paths(ends: DataFrame, runs: int) -> DataFrame:
    """The bucket rows with ``paths``: the text's bucket in each run, 0 if alone."""
    def of_run(r: Column) -> Column:
        return F.coalesce(F.get(F.filter("_ends", lambda e: e["run"] == r), F.lit(0))["path"], F.lit(0))

    by_text = ends.groupBy("tid").agg(F.collect_list(F.struct("run", "path", "size")).alias("_ends"))
    return by_text.withColumn("paths", F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), of_run)).select(
        "tid", "paths", F.explode("_ends").alias("_end")).select("tid", "paths", "_end.*")


def _tiled(rows: DataFrame, rule: JaccardJoin) -> DataFrame:
    """Bucket rows dealt and sorted by tile: a whole bucket or, of one over ``rule.block``, two of its blocks (or one, with itself)."""
    return (
        rows.withColumn("_blocks", F.ceil(F.col("size") / rule.block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("tid"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("one", F.col("_other") == F.col("block"))
        .withColumn("tile", F.xxhash64("path", F.least("block", "_other"), F.greatest("block", "_other")))
        .drop("_blocks", "_other")
        .repartition("tile").sortWithinPartitions("tile")
    )


class _Tile:
    """The texts of one tile by tid, its two sides, and which pairs meet here first."""

    def __init__(self, rows: dict[str, list]):
        self.order = np.argsort(np.array(rows["tid"], dtype=object), kind="stable")
        self.rows = rows
        self.tid = self.column("tid")
        block = np.array(self.column("block"))
        sides = np.unique(block)
        self.alone = bool(rows["one"][0])
        self.left = np.flatnonzero(block == sides[0])
        self.right = self.left if self.alone else np.flatnonzero(block == sides[1]) if len(sides) > 1 else self.left[:0]
        run = rows["run"][0]
        met = np.array([p[:run] for p in self.column("paths")], np.int64).reshape(len(self.tid), run)
        self.fresh = np.ones((len(self.left), len(self.right)), bool)
        if self.alone:
            self.fresh = np.triu(self.fresh, 1)
        for r in range(run):
            a, b = met[self.left, r][:, None], met[self.right, r][None, :]
            self.fresh &= (a != b) | (a == 0)

    def column(self, name: str) -> list:
        values = self.rows[name]
        return [values[i] for i in self.order]


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    sets = left + right
    ids, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(inverse, minlength=len(ids)) > 1
    column = np.cumsum(often) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = often[inverse]
    owner, at = owner[keep], column[inverse[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for start in range(0, int(often.sum()), 8192):
        a, b = np.searchsorted(at, [start, start + 8192])
        block = np.zeros((len(sets), 8192), np.float32)
        block[owner[a:b], at[a:b] - start] = 1
        out += block[:len(left)] @ block[len(left):].T
    return out


def _likely(rows: dict[str, list], least: int) -> Iterator[tuple]:
    """(tid, paths, run, path, size) of the texts of a tile that agree in ``least`` sampled tokens with one they meet here first."""
    tile = _Tile(rows)
    tokens = np.array(tile.column("tokens"), np.int32)
    agree = np.zeros(tile.fresh.shape, np.int16)
    if tile.fresh.any():
        for k in range(tokens.shape[1]):
            agree += tokens[tile.left, k][:, None] == tokens[tile.right, k][None, :]
    pairs = tile.fresh & (agree >= least)
    some = np.unique(np.concatenate([tile.left[pairs.any(1)], tile.right[pairs.any(0)]]))
    paths, run, path, size = (tile.column(c) for c in ("paths", "run", "path", "size"))
    for i in some.tolist():
        yield tile.tid[i], paths[i], run[i], path[i], size[i]


def _linked(rows: dict[str, list], threshold: float) -> Iterator[tuple]:
    """(tid, root, linked documents, linked texts) of the texts of one tile that have a link there.

    A pair that already met in an earlier run is left to that run, so that each link counts once.
    """
    tile = _Tile(rows)
    tid, left, right = tile.tid, tile.left, tile.right
    n = np.array(tile.column("n"), np.int64)
    sets = [np.frombuffer(x, np.uint64) for x in tile.column("shingles")]
    sizes = np.array([len(x) for x in sets])
    fresh = tile.fresh & (np.minimum.outer(sizes[left], sizes[right]) >= threshold * np.maximum.outer(sizes[left], sizes[right]))
    i, j = np.flatnonzero(fresh.any(1)), np.flatnonzero(fresh.any(0))
    if not len(i):
        return
    shared = shared_counts([sets[x] for x in left[i]], [sets[x] for x in right[j]])
    total = sizes[left[i]][:, None] + sizes[right[j]][None, :] - shared
    linked = fresh[np.ix_(i, j)] & (shared >= threshold * total - 1e-6 * total)
    union = _Union(len(tid))
    docs, texts = np.zeros(len(tid), np.int64), np.zeros(len(tid), np.int64)
    a, b = np.nonzero(linked)
    a, b = left[i][a], right[j][b]
    np.add.at(docs, a, n[b])
    np.add.at(docs, b, n[a])
    np.add.at(texts, a, 1)
    np.add.at(texts, b, 1)
    for x, y in zip(a.tolist(), b.tolist()):
        union.join(x, y)
    for x in np.flatnonzero(texts).tolist():
        yield tid[x], tid[union.find(x)], int(docs[x]), int(texts[x])


def _by_tile(judge: Callable[[dict[str, list]], Iterator[tuple]], kinds: dict[str, pa.DataType]):
    """A function over batches sorted by tile that gives ``judge`` the rows of each tile, and returns what it yields."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[] for _ in kinds]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))
            out.clear()
            return batch

        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a).to_pydict()
                if held and held["tile"][0] != part["tile"][0]:
                    out += judge(held)
                    held = {}
                held = {c: held.get(c, []) + values for c, values in part.items()}
            if len(out) > 4096:
                yield packed()
        if held:
            out += judge(held)
        yield packed()

    return run


def jaccard_join(docs: DataFrame, rule: JaccardJoin = JaccardJoin()) -> DataFrame:
    """``docs`` with class_id, n_links, n_text_links, n_copies, first_of_class; one row in, one row out, whole texts.

    Two documents are linked if the Jaccard similarity of their sets of ``shingle``-word runs reaches ``threshold``. A text
    of fewer words is one shingle; a text without words (or null) is linked to none, not even to its copies. ``class_id`` is
    the least doc_id of the connected component (own doc_id without links; null if none is known), ``n_links`` counts the linked
    documents, copies included, ``n_text_links`` the linked different texts and ``n_copies`` the documents of the same text. ``first_of_class`` holds for one text of the class, in its documents with the least
    doc_id, and for every text without words.

    Each run puts every distinct text on a path: buckets are split by the value of one sampled token after another (a minimum
    of a seeded hash over the shingles, equal in two texts with probability of their similarity) until small enough for brute force.
    A bucket of texts that mostly resemble each other is not split, but compared in tiles of two blocks. Runs are
    repeated in batches until the recall at the threshold is reached for all texts. Tiles are first judged by the sampled tokens, so that
    shingle sets are sent only for pairs that may be links. Links are checked on the whole shingle
    sets (64-bit hashes); a link is counted in the first run in which its texts meet, so pairs are never listed. Every tile gives
    the links of a text as a count and its local root, which ``components`` connects.
    Input columns named like results are replaced.
    """
    added = ["class_id", "n_links", "n_text_links", "n_copies", "first_of_class"]
    docs = without(docs, *added, "_tid")
    keyed = docs.withColumn("_tid", F.md5(whole("text").cast("binary")))
    plain = keyed.select(F.col("_tid").alias("tid"), whole("text").alias("text"))
    records = materialize(_tokens(plain, rule), "records")

    runs = rule.runs
    ends = _batch_of_runs(records, rule, range(runs))
    # Texts that were never split off a large bucket have met their like; the others, also if alone since, go on.
    again = None
    while _missed(ends, rule, runs) > 1 - rule.recall:
        if again is None:
            deep = ends.filter("depth > 1").select("tid").distinct()
            again = materialize(records.join(deep, "tid", "left_semi"), "again")
        ends = ends.unionByName(_batch_of_runs(again, rule, range(runs, runs + rule.runs)))
        runs += rule.runs

    least = int(rule.sketch * rule.tokens)
    meeting = _with_paths(ends.filter("size > 1"), runs).join(records.select("tid", "tokens"), "tid")
    kinds = {"tid": pa.string(), "paths": pa.list_(pa.int64()), "run": pa.int32(), "path": pa.int64(), "size": pa.int64()}
    likely = _tiled(meeting, rule).mapInArrow(
        _by_tile(lambda rows: _likely(rows, least), kinds), "tid string, paths array<long>, run int, path long, size long")
    members = likely.groupBy("tid").agg(F.collect_set(F.struct("run", "path", "size")).alias("_ends"), F.first("paths").alias("paths"))

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, begins = _shingles(texts_of(batch.column("text")), rule.shingle)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sets, pa.binary())], [*names, "shingles"])

    distinct = plain.groupBy("tid").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    met = distinct.join(members, "tid")
    schema = met.drop("text").schema.add("shingles", "binary")
    sets = met.mapInArrow(shingle_sets, schema).select("tid", "n", "paths", "shingles", F.explode("_ends").alias("_end")).select(
        "tid", "n", "paths", "shingles", "_end.*")
    kinds = {"v": pa.string(), "u": pa.string(), "links": pa.int64(), "text_links": pa.int64()}
    links = _tiled(sets, rule).mapInArrow(
        _by_tile(lambda rows: _linked(rows, rule.threshold), kinds), "v string, u string, links long, text_links long")
    linked = materialize(links, "links")
    counts = linked.groupBy("v").agg(F.sum("links").alias("_links"), F.sum("text_links").alias("_texts"))
    roots = components(linked.select("v", "u"))
    of_text = (
        records.select("tid", "n").join(counts, F.col("tid") == F.col("v"), "left").drop("v")
        .join(roots, F.col("tid") == F.col("v"), "left")
        .select("tid", "n", F.coalesce("root", "tid").alias("root"), F.coalesce("_links", F.lit(0)).alias("_links"),
                F.coalesce("_texts", F.lit(0)).alias("_texts"))
    )
    firsts = keyed.groupBy("_tid").agg(F.min("doc_id").alias("_first"))
    of_text = of_text.join(firsts, F.col("tid") == F.col("_tid")).drop("_tid")
    least = F.min(F.struct(F.col("_first").isNull().alias("unknown"), F.col("_first").alias("id"), F.col("tid").alias("tid")))
    classes = of_text.groupBy("root").agg(least.alias("_class"))
    of_text = materialize(of_text.join(classes, "root"), "classes")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return keyed.join(of_text, F.col("_tid") == F.col("tid"), "left").select(
        *kept,
        F.when(F.col("tid").isNull(), F.col("doc_id")).otherwise(F.col("_class.id")).alias("class_id"),
        F.coalesce(F.col("_links") + F.col("n") - 1, F.lit(0)).alias("n_links"),
        F.coalesce(F.col("_texts"), F.lit(0)).alias("n_text_links"),
        F.coalesce(F.col("n"), F.lit(1)).alias("n_copies"),
        (F.col("tid").isNull() | ((F.col("tid") == F.col("_class.tid")) & F.col("doc_id").eqNullSafe(F.col("_first")))).alias("first_of_class"),
    )


def first_of_each(docs: DataFrame, rule: JaccardJoin = JaccardJoin()) -> DataFrame:
    """``docs`` with one row for each class of ``jaccard_join``, that of the least doc_id; texts without words all stay.

    Repeated rows and documents without an id count as copies, of which one stays.
    """
    rows, as_before = set_aside(docs, "doc_id", "text")
    first = jaccard_join(rows, rule).filter("first_of_class")
    return as_before(first.filter("n_copies = 1").unionByName(first.filter("n_copies > 1").dropDuplicates(["text"])))
