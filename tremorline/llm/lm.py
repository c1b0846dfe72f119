"""Scoring documents by a gated recurrent language model that is trained over the corpus in Spark tasks."""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tremorline.llm import gru
from tremorline.llm.text import whole, without
from tremorline.llm.words import Texts, mix, pieces, slice_hashes, texts_of
from tremorline.session import materialize

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: The token after the last word of a text.
_END = np.uint64(0x5EED_0F_E2D)


@dataclass(frozen=True)
class LmRule:
    shape: gru.Shape = field(default_factory=gru.Shape)
    #: Words with at least the count that leaves no more than so many are looked up in a table; the rest in a join.
    table: int = 262_144
    #: Training takes one in so many blocks of each document, chosen by hash; counts take all.
    every: int = 1
    #: Tokens of a block; two windows of backpropagation.
    block: int = 64
    #: Blocks are dealt to training tasks by hash, at most about so many tokens to each.
    task_tokens: int = 1_000_000
    #: Counts held in a task before they are summed.
    held: int = 2_000_000
    #: Texts that are scored side by side take about so many bytes.
    side_by_side: int = 12_000_000
    seed: int = 17


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 1. A null id reads as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


class _Tokens:
    """Token hashes and groups of some texts; each ends with the end token."""

    def __init__(self, texts: Texts, groups: int):
        low = Texts(_LOWER[texts.data], texts.offsets)
        counts = np.diff(low.bounds)
        self.begins = np.concatenate([[0], np.cumsum(counts + 1)])
        at = np.arange(len(low.starts)) + low.owner
        self.hashes = np.full(self.begins[-1], _END, np.uint64)
        self.hashes[at] = low.word_hashes
        # The group of a rarer word follows from its last two bytes, which tell languages and endings apart.
        last = low.data[low.ends - 1].astype(np.int64) if len(low.ends) else np.zeros(0, np.int64)
        long = low.ends - low.starts > 1
        second = np.where(long, low.data[np.maximum(low.ends - 2, 0)] if len(low.ends) else last, 0).astype(np.int64)
        self.groups = np.zeros(self.begins[-1], np.int64)
        self.groups[at] = (mix((last * 256 + second).astype(np.uint64)) >> np.uint64(32)).astype(np.int64) % groups



def count_tokens(docs: DataFrame, rule: LmRule = LmRule()) -> DataFrame:
    """``(hash, grp, c)`` of every token of the training documents; tasks sum their own counts before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            hashes, groups, counts = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            found, first = np.unique(hashes[order], return_index=True)
            return found, groups[order][first], np.add.reduceat(counts[order], first)

        def packed(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            table = pa.RecordBatch.from_arrays([pa.array(rows[0].view(np.int64)), pa.array(rows[1].astype(np.int32)), pa.array(rows[2])],
                                               ["hash", "grp", "c"])
            for at in range(0, table.num_rows, 100_000):
                yield table.slice(at, 100_000)

        for batch in pieces(batches):
            tokens = _Tokens(texts_of(batch.column("text")), rule.shape.groups)
            found, first, counts = np.unique(tokens.hashes, return_index=True, return_counts=True)
            parts.append((found, tokens.groups[first], counts))
            held += len(found)
            if held > rule.held:
                parts[:] = [summed()]
                held = len(parts[0][0])
                if held > rule.held // 2:
                    yield from packed(parts.pop())
                    held = 0
        if parts:
            yield from packed(summed())

    train = docs.filter(~held_out(F.col("doc_id"))).select(whole("text").alias("text"))
    return train.mapInArrow(run, "hash long, grp int, c long").groupBy("hash").agg(F.min("grp").alias("grp"), F.sum("c").alias("c"))


@dataclass
class LanguageModel:
    """What scoring needs beside the counts of the rarest words; its size is bounded by the rule."""

    rule: LmRule
    #: Token hashes in ascending order, with counts and numbers for the network.
    hashes: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray
    #: Training tokens and distinct ones; the same per group of words that have no number of their own.
    total: int
    distinct: int
    group_total: np.ndarray
    group_distinct: np.ndarray
    weights: np.ndarray

    @cached_property
    def _leads(self) -> tuple[np.uint64, np.ndarray]:
        """How far a hash is shifted to its leading bits, some four values of these for each hash, and where the hashes of each value begin."""
        bits = min(24, len(self.hashes).bit_length() + 1)
        shift = np.uint64(64 - bits)
        return shift, np.concatenate([[0], np.cumsum(np.bincount((self.hashes >> shift).astype(np.int64), minlength=1 << bits))])

    def find(self, tokens: _Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Network number and count of each token; count -1 where the table does not know it."""
        hashes, known = tokens.hashes, np.zeros(len(tokens.hashes), bool)
        at = np.zeros(len(hashes), np.int64)
        if len(self.hashes):
            shift, first = self._leads
            lead = (hashes >> shift).astype(np.int64)
            at = first[lead]
            known = self.hashes.take(at, mode="clip") == hashes
            rest = np.flatnonzero(~known)
            while len(rest):
                at[rest] += 1
                rest = rest[at[rest] < first[lead[rest] + 1]]
                hit = self.hashes[at[rest]] == hashes[rest]
                known[rest[hit]] = True
                rest = rest[~hit]
        number, counts = (np.where(known, x.take(at, mode="clip") if len(x) else -1, -1) for x in (self.numbers, self.counts))
        return np.where(number >= 0, number, self.rule.shape.words + tokens.groups), counts


def _vocabulary(counted: DataFrame, rule: LmRule) -> LanguageModel:
    sizes = sorted((int(r["c"]), int(r["words"])) for r in counted.groupBy("c").agg(F.count(F.lit(1)).alias("words")).collect())
    total, distinct = sum(c * n for c, n in sizes), sum(n for _, n in sizes)
    floor, held = 1, distinct
    for c, n in sizes:  # the least count that keeps the table in its bound
        if held <= rule.table:
            break
        floor, held = c + 1, held - n
    rows = counted.filter(F.col("c") >= floor).select("hash", "grp", "c").toArrow()
    hashes = rows["hash"].to_numpy().astype(np.int64).view(np.uint64)
    groups, counts = rows["grp"].to_numpy().astype(np.int64), rows["c"].to_numpy().astype(np.int64)
    rank = np.lexsort((hashes, -counts))[:rule.shape.words]
    numbers = np.full(len(hashes), -1)
    numbers[rank] = np.arange(len(rank))
    order = np.argsort(hashes)
    by_group = {int(r["grp"]): r for r in counted.groupBy("grp").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("words")).collect()}
    own = numbers >= 0
    group_total = np.array([int(by_group[g]["c"]) if g in by_group else 0 for g in range(rule.shape.groups)])
    group_distinct = np.array([int(by_group[g]["words"]) if g in by_group else 0 for g in range(rule.shape.groups)])
    group_total -= np.bincount(groups[own], counts[own], rule.shape.groups).astype(np.int64)
    group_distinct -= np.bincount(groups[own], minlength=rule.shape.groups)
    weights = gru.start(counts[rank], group_total, rule.shape, rule.seed)
    return LanguageModel(rule, hashes[order], counts[order], numbers[order], total, distinct, group_total, group_distinct,
                         gru.flat(weights, rule.shape))


def _packed(shape: gru.Shape) -> type:
    return np.uint16 if shape.words + shape.groups <= 1 << 16 else np.int32


def _blocks(docs: DataFrame, model: LanguageModel, tasks: int) -> DataFrame:
    """``(task, rank, tokens)``: the blocks of training documents that training takes, dealt and ordered by hash."""
    rule = model.rule

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            tokens = _Tokens(texts_of(batch.column("text")), rule.shape.groups)
            numbers, _ = model.find(tokens)
            sizes = np.diff(tokens.begins)
            blocks = -(-sizes // rule.block)
            owner = np.repeat(np.arange(len(sizes)), blocks)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            firsts = tokens.begins[:-1][owner] + place * rule.block
            lasts = np.minimum(firsts + rule.block, tokens.begins[1:][owner])
            # The text takes part, so that rows without an id, or with one id, spread.
            inside = slice_hashes(tokens.hashes, firsts, lasts)
            rank = mix(batch.column("_key").to_numpy().view(np.uint64)[owner] + inside + place.astype(np.uint64))
            taken = np.flatnonzero(rank % np.uint64(rule.every) == 0)
            packed = numbers.astype(_packed(rule.shape))
            lists = [packed[a:b] for a, b in zip(firsts[taken].tolist(), lasts[taken].tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(((rank[taken] >> np.uint64(20)) % np.uint64(tasks)).astype(np.int32)), pa.array(rank[taken].view(np.int64)),
                pa.array([x.tobytes() for x in lists], pa.binary()),
            ], ["task", "rank", "tokens"])

    train = docs.filter(~held_out(F.col("doc_id"))).select(F.xxhash64(F.lit(rule.seed), "doc_id").alias("_key"), whole("text").alias("text"))
    return train.mapInArrow(run, "task int, rank long, tokens binary")


_CHUNK = 16_384


def _trained(blocks: DataFrame, start: np.ndarray, rule: LmRule) -> DataFrame:
    """``(chunk, part, n, sums)``: per task, its weights times its number of blocks, in chunks. A task's blocks are in one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def finished() -> pa.RecordBatch:
            weights = gru.flat(gru.train(gru.unflat(start, rule.shape), held, rule.shape), rule.shape).astype(np.float64) * len(held)
            chunks = [weights[a:a + _CHUNK].tobytes() for a in range(0, len(weights), _CHUNK)]
            return pa.RecordBatch.from_arrays([
                pa.array(range(len(chunks)), pa.int32()), pa.array([task] * len(chunks), pa.int32()),
                pa.array([len(held)] * len(chunks), pa.int64()), pa.array(chunks, pa.binary())], ["chunk", "part", "n", "sums"])

        for batch in batches:
            for t, x in zip(batch.column("task").to_pylist(), batch.column("tokens").to_pylist()):
                if t != task and held:
                    yield finished()
                    held = []
                task = t
                held.append(np.frombuffer(x, _packed(rule.shape)).astype(np.int64))
        if held:
            yield finished()

    dealt = blocks.sortWithinPartitions("task", "rank", "tokens")
    return dealt.mapInArrow(run, "chunk int, part int, n long, sums binary")


def _added(parts: DataFrame, tasks: int) -> np.ndarray | None:
    """Mean of the tasks' weights, added up 64 at a time."""
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table["sums"][0].as_py()) // 8)
        order = np.argsort(table["part"].to_numpy(), kind="stable")
        sums = table["sums"].to_pylist()
        for i in order.tolist():
            total += np.frombuffer(sums[i], np.float64)
        return pa.table({"chunk": table["chunk"][:1].cast(pa.int32()), "part": table["_of"][:1].cast(pa.int32()),
                         "n": pa.array([int(table["n"].to_numpy().sum())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    while True:
        parts = parts.withColumn("_of", F.floor(F.col("part") / 64).cast("int"))
        parts = parts.groupBy("chunk", "_of").applyInArrow(add, "chunk int, part int, n long, sums binary")
        tasks = -(-tasks // 64)
        if tasks <= 1:
            break
    rows = sorted(parts.collect(), key=lambda r: r["chunk"])
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r["sums"], np.float64) / r["n"] for r in rows]).astype(np.float32)


def _rounds(shares: float) -> int:
    """The least number of rounds of 1, 2, 3, ... tasks that have so many tasks in all."""
    rounds = 1
    while rounds * (rounds + 1) // 2 < shares:
        rounds += 1
    return rounds


def fit_language_model(docs: DataFrame, counted: DataFrame, rule: LmRule = LmRule()) -> LanguageModel:
    """Train on the documents that are not held out; ``counted`` comes from ``count_tokens``.

    The most frequent tokens have numbers of their own, others that of a group. Blocks of every training document, one in
    ``rule.every`` by hash (all), are dealt by hash to tasks whose number follows the tokens, and every task trains once, on its own share.
    Round r has r tasks, which start from the mean of the weights of the round before, by blocks: so both the rounds, one after
    the other, and the tasks of a round grow with the square root of the corpus. Order and shares follow from hashes, so the same documents
    give the same shares however they are partitioned. Without training documents the starting weights stay.
    """
    model = _vocabulary(counted, rule)
    rounds = _rounds(model.total / rule.every / rule.task_tokens)
    # In order of tasks, so that a round's pages are found without reading the others'.
    blocks = _blocks(docs, model, rounds * (rounds + 1) // 2).sortWithinPartitions("task")
    blocks = materialize(blocks, "blocks")
    for r in range(rounds):
        first = r * (r + 1) // 2
        share = blocks.filter(F.col("task").between(first, first + r)).withColumn("task", F.col("task") - first)
        # Task numbers are partition numbers: hashed, several tasks would share a partition and others stay empty.
        share = share.repartitionById(r + 1, F.col("task"))
        trained = _added(_trained(share, model.weights, rule), r + 1)
        model.weights = model.weights if trained is None else trained
    return model


_ROW = {"n_tokens": "long", "n_known": "long", "base": "double", "score": "double", "hash": "long", "grp": "integer", "n": "long"}


def _in_order(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts take about ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column("text").nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def score_documents(docs: DataFrame, model: LanguageModel, counted: DataFrame) -> DataFrame:
    """``docs`` without text, with held_out, n_tokens, n_known, train_tokens, base_score, score; one row in, one row out.

    Tokens are the words, A-Z in lower case, and one end. ``n_known`` counts those with a training count. ``base_score`` sums
    log10((c + 0.5) / (N + 0.5 (V + 1))). ``score`` is the network's log10 probability of the whole text: of the class given all
    before it, and of the word within the class; rarer words are spread over their group by (c + 0.5) / (C + 0.5 (V' + 1)), the group's
    count and words, an unseen word taking the place of one. A null or empty text is one end. Counts of words that are not
    in the table are joined from ``counted``. Input columns named like results are replaced.
    """
    rule, shape = model.rule, model.rule.shape
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = without(docs, *added, "_row")
    carried = {c: f"_c{i}" for i, c in enumerate(x for x in docs.columns if x != "text")}
    base_log = math.log10(model.total + 0.5 * (model.distinct + 1))
    group_log = np.log10(model.group_total + 0.5 * (model.group_distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = gru.unflat(model.weights, shape)
        for some in _in_order(pieces(batches), rule.side_by_side):
            found = [(lambda t: (t, *model.find(t)))(_Tokens(texts_of(b.column("text")), shape.groups)) for b in pieces(iter([some]))]
            numbers = np.concatenate([n for _, n, _ in found])
            counts = np.concatenate([c for _, _, c in found])
            hashes, groups = np.concatenate([t.hashes for t, _, _ in found]), np.concatenate([t.groups for t, _, _ in found])
            sizes = np.concatenate([np.diff(t.begins) for t, _, _ in found])
            begins = np.concatenate([[0], np.cumsum(sizes)])
            del found
            owner = np.repeat(np.arange(len(sizes)), sizes)
            score = gru.score_texts(weights, numbers, begins, shape) / math.log(10)
            here = counts >= 0
            logs = np.log10(np.maximum(counts, 0) + 0.5)
            base = np.bincount(owner, np.where(here, logs - base_log, 0), len(sizes))
            rare = here & (numbers >= shape.words)
            score += np.bincount(owner[rare], logs[rare] - group_log[groups[rare]], len(sizes))
            known = np.bincount(owner, here, len(sizes)).astype(np.int64)
            rows = some.column("_row")
            names = ["_row", *carried.values(), *_ROW]
            own = [some.column(c) for c in carried.values()]
            # A main row joins with nothing: its hash only deals it out.
            yield pa.RecordBatch.from_arrays([
                rows, *own, pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score),
                pa.array(mix(rows.to_numpy().astype(np.uint64)).view(np.int64)), pa.nulls(len(sizes), pa.int32()), pa.array(np.zeros(len(sizes), np.int64)),
            ], names)
            away = np.flatnonzero(~here)
            order = away[np.lexsort((hashes[away], owner[away]))]
            change = np.ones(len(order), bool)
            change[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            first = np.flatnonzero(change)
            times = np.diff(np.concatenate([first, [len(order)]]))
            order = order[first]
            for at in range(0, len(order), 100_000):
                part = order[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([
                    rows.take(pa.array(owner[part])), *[pa.nulls(len(part), c.type) for c in own],
                    *[pa.nulls(len(part), k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64())],
                    pa.array(hashes[part].view(np.int64)), pa.array(groups[part].astype(np.int32)), pa.array(times[at:at + 100_000].astype(np.int64)),
                ], names)

    # The other columns travel on a document's main row: its number holds for one evaluation only, so nothing is joined back by it.
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), whole("text").alias("text"),
                           *[F.col(f"`{c}`").alias(k) for c, k in carried.items()])
    schema = numbered.drop("text").schema
    for name, kind in _ROW.items():
        schema = schema.add(name, kind)
    schema = StructType([StructField(f.name, f.dataType) for f in schema])
    rows = numbered.mapInArrow(run, schema)
    floor = int(model.counts.min()) if len(model.counts) else 1
    rarest = counted.filter(F.col("c") < floor).select("hash", F.col("c").alias("_c"))
    by_group = F.get(F.array(*[F.lit(float(x)) for x in group_log]), F.col("grp"))
    c = F.coalesce("_c", F.lit(0))
    logs = F.log10(c + F.lit(0.5))
    tail = F.col("n") > 0
    joined = rows.join(rarest, "hash", "left").groupBy("_row").agg(
        *[F.first(k, ignorenulls=True).alias(k) for k in carried.values()],
        F.max("n_tokens").alias("n_tokens"),
        (F.sum(F.coalesce("n_known", F.lit(0))) + F.sum(F.when(tail & (c > 0), F.col("n")).otherwise(0))).alias("n_known"),
        (F.sum(F.coalesce("base", F.lit(0.0))) + F.sum(F.when(tail, F.col("n") * (logs - F.lit(base_log))).otherwise(0.0))).alias("base_score"),
        (F.sum(F.coalesce("score", F.lit(0.0))) + F.sum(F.when(tail, F.col("n") * (logs - by_group)).otherwise(0.0))).alias("score"),
    )
    return joined.select(
        *[F.col(k).alias(c) for c, k in carried.items()], held_out(F.col(carried["doc_id"])).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def score_corpus(docs: DataFrame, rule: LmRule = LmRule()) -> DataFrame:
    """Count, train and score in one go."""
    counted = materialize(count_tokens(docs, rule), "counts")
    return score_documents(docs, fit_language_model(docs, counted, rule), counted)
