"""Severity of toxic language by cumulative-link ordinal regression on hashed words."""
from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from tremorline.llm.text import whole, without
from tremorline.llm.words import Texts, mix, pieces, slice_hashes, texts_of

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class ToxicityRule:
    #: Labelled documents used for fitting: those with the lowest hash of doc_id, at most so many.
    labelled: int = 6_000
    #: Features are hashed to 2**bits weights.
    bits: int = 18
    #: Besides words, their beginnings of these lengths in bytes are features.
    beginnings: tuple[int, ...] = (5, 6, 7)
    #: Power of a row's length that its values are divided by.
    scaling: float = 0.5
    #: Levels above 0 that toxic documents without given grades are divided into.
    grades: int = 3
    #: Rows with the average share of grades above 0 that each feature's log-odds start from.
    prior: float = 5.0
    #: Features whose log-odds are smaller are left out.
    telling: float = 0.5
    #: Strength of the L2 penalty for each labelled document, number of steps and their size.
    penalty: float = 1e-5
    steps: int = 300
    rate: float = 0.1
    #: Documents with at least this probability of a grade above 0 are toxic.
    threshold: float = 0.35
    seed: int = 3


def features(texts: Texts, rule: ToxicityRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: where each text's entries begin, their feature numbers and values.

    Words are runs of letters, digits and bytes beyond ASCII, in lower case (ASCII and Latin-1). A value is ln(1 + count), the row is
    scaled to length 1.
    """
    data = _LOWER[texts.data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = second[(data[second] < 0x9F) & (data[second] != 0x97)]
    data[upper] += 32
    letter = _LETTER[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[texts.offsets] = True
    before = np.concatenate([[False], letter[:-1]]) if len(letter) else letter
    after = np.concatenate([letter[1:], [False]]) if len(letter) else letter
    starts = np.flatnonzero(letter & (~before | fresh[:-1]))
    ends = np.flatnonzero(letter & (~after | fresh[1:])) + 1
    owner = np.searchsorted(texts.offsets, starts, "right") - 1
    values = data.astype(np.uint64) + np.uint64(1)
    hashed, owners = [slice_hashes(values, starts, ends)], [owner]
    for length in rule.beginnings:
        longer = ends - starts >= length
        hashed.append(slice_hashes(values, starts[longer], starts[longer] + length) ^ np.uint64(0xABCDEF * length))
        owners.append(owner[longer])
    number = mix(np.concatenate(hashed)) >> np.uint64(64 - rule.bits)
    cells, counts = np.unique(np.concatenate(owners).astype(np.uint64) << np.uint64(rule.bits) | number, return_counts=True)
    row = (cells >> np.uint64(rule.bits)).astype(np.int64)
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(row, value * value, len(texts)))
    begins = np.searchsorted(row, np.arange(len(texts) + 1))
    return begins, (cells & np.uint64((1 << rule.bits) - 1)).astype(np.int64), (value / np.maximum(norm, 1e-9)[row] ** rule.scaling)


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(weights . features - thresholds[k - 1]): one set of weights for all thresholds, which ascend."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, begins: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        score = np.bincount(row, self.weights[number] * value, len(begins) - 1)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(begins: np.ndarray, number: np.ndarray, value: np.ndarray, grade: np.ndarray, rule: ToxicityRule) -> OrdinalModel:
    """Proportional odds by full-batch gradient steps (Adam) on the likelihood of the grades.

    ``grade`` holds 0..K; thresholds ascend by construction (the first, then logs of gaps). A grade that no row has gets no
    probability of its own: its gap shrinks. Without rows, or with one grade only, the model predicts that grade (0 without rows).
    """
    top = max(1, int(grade.max(initial=0)))
    if not len(grade) or grade.min() == grade.max():
        constant = int(grade[0]) if len(grade) else 0
        return OrdinalModel(np.zeros(1 << rule.bits), np.where(np.arange(1, top + 1) <= constant, -40.0, 40.0))
    row = np.repeat(np.arange(len(grade)), np.diff(begins))
    used, number = np.unique(number, return_inverse=True)
    # Features are scaled by their log-odds between grade 0 and the rest, so that rare ones cannot explain single rows.
    share = (grade > 0).mean()
    yes = np.bincount(number[grade[row] > 0], minlength=len(used))
    no = np.bincount(number, minlength=len(used)) - yes
    odds = np.log((yes + rule.prior * share) / (no + rule.prior * (1 - share)) * (1 - share) / share)
    telling = np.abs(odds)[number] >= rule.telling
    row, number, value = row[telling], number[telling], (value * odds[number])[telling]
    weights, first, gaps = np.zeros(len(used)), 1.0, np.zeros(top - 1)
    n = len(grade)
    state = [np.zeros(len(used) + top) for _ in range(2)]
    for step in range(1, rule.steps + 1):
        score = np.bincount(row, weights[number] * value, n)
        limits = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - limits[None, :], -40, 40)))  # P(grade >= k)
        padded = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        here, nxt = padded[at, grade], padded[at, grade + 1]
        chance = np.maximum(here - nxt, 1e-12)
        slope_here, slope_next = here * (1 - here) / chance, nxt * (1 - nxt) / chance  # d log P / d (score - limit)
        by_score = slope_here - slope_next
        by_limit = np.zeros(top)
        np.add.at(by_limit, np.maximum(grade - 1, 0), np.where(grade > 0, -slope_here, 0))
        np.add.at(by_limit, np.minimum(grade, top - 1), np.where(grade < top, slope_next, 0))
        grad_weights = np.bincount(number, value * by_score[row], len(used)) / n - rule.penalty * weights
        tail = np.cumsum(by_limit[::-1])[::-1]
        grad = np.concatenate([grad_weights, [tail[0] / n], tail[1:] * np.exp(gaps) / n - rule.penalty * gaps])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad * grad
        move = rule.rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        weights, first, gaps = weights + move[:len(used)], first + move[len(used)], np.clip(gaps + move[len(used) + 1:], -8, 8)
    full = np.zeros(1 << rule.bits)
    full[used] = weights * odds
    return OrdinalModel(full, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def grade_toxic(begins: np.ndarray, number: np.ndarray, value: np.ndarray, toxic: np.ndarray, rule: ToxicityRule) -> np.ndarray:
    """Grades 0..rule.grades from toxic flags: toxic rows are ranked by the weight of marked features and cut into equal parts.

    A feature is marked if it is over 4 times as frequent among toxic rows (smoothed).
    """
    row = np.repeat(np.arange(len(toxic)), np.diff(begins))
    yes = np.bincount(number[toxic[row] > 0], minlength=1 << rule.bits) + 0.5
    no = np.bincount(number[toxic[row] == 0], minlength=1 << rule.bits) + 0.5
    marked = yes / (toxic.sum() + 1) > 4 * no / ((toxic == 0).sum() + 1)
    weight = np.bincount(row, np.where(marked[number], value * value, 0), len(toxic))
    out = np.zeros(len(toxic), np.int64)
    those = np.flatnonzero(toxic)
    order = those[np.lexsort((those, weight[those]))]
    out[order] = 1 + np.arange(len(order)) * rule.grades // max(1, len(order))
    return out


def _id_type(*tables: DataFrame) -> str:
    """In which type the tables' ids are compared: as numbers where all are whole numbers, else as text."""
    return "long" if all(isinstance(t.select("doc_id").schema[0].dataType, IntegralType) for t in tables) else "string"


def _labelled_features(docs: DataFrame, labels: DataFrame, rule: ToxicityRule) -> DataFrame:
    kind = _id_type(docs, labels)
    own_id = F.col("doc_id").cast(kind).alias("doc_id")
    level = F.max("grade" if "grade" in labels.columns else "toxic").cast("int").alias("level")
    known = labels.filter("doc_id is not null").groupBy(own_id).agg(level).filter("level is not null")
    # Labels of documents that are not here must not fill the sample; only ids are joined.
    known = known.join(docs.select(own_id).distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64(F.lit(rule.seed), "doc_id"), "doc_id").limit(rule.labelled)
    given = "grade" in labels.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            begins, number, value = features(texts_of(batch.column("text")), rule)
            parts = list(zip(begins[:-1].tolist(), begins[1:].tolist()))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("level"), pa.array([given] * batch.num_rows),
                pa.array([number[a:b].astype(np.int32).tobytes() for a, b in parts], pa.binary()),
                pa.array([value[a:b].astype(np.float32).tobytes() for a, b in parts], pa.binary()),
            ], ["doc_id", "level", "given", "numbers", "amounts"])

    # At most rule.labelled rows of two numbers, so the sample may be broadcast; of a repeated doc_id one text counts.
    found = docs.select(own_id, whole("text").alias("text")).join(F.broadcast(chosen), "doc_id").mapInArrow(
        run, f"doc_id {kind}, level int, given boolean, numbers binary, amounts binary")
    return found.groupBy("doc_id").agg(F.min(F.struct("level", "given", "numbers", "amounts")).alias("row")).select("doc_id", "row.*")


def fit_toxicity(docs: DataFrame, labels: DataFrame, rule: ToxicityRule = ToxicityRule()) -> OrdinalModel:
    """Fit on at most ``rule.labelled`` labelled documents, chosen by hash of doc_id; one task fits on their sparse features.

    ``labels`` has doc_id and either ``grade`` (0..K) or ``toxic`` (0/1), which is split into grades by ``grade_toxic``. Null labels and ids are
    left out, of repeated labels the highest counts, of the texts of a repeated doc_id the one whose features come first in order. Ids may be
    numbers or texts; a number matches the text of its digits. Without labelled documents nothing is toxic.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        numbers = [np.frombuffer(r["numbers"], np.int32).astype(np.int64) for r in rows]
        begins = np.concatenate([[0], np.cumsum([len(n) for n in numbers])]).astype(np.int64)
        number = np.concatenate([*numbers, np.zeros(0, np.int64)])
        value = np.concatenate([*[np.frombuffer(r["amounts"], np.float32) for r in rows], np.zeros(0)]).astype(np.float64)
        level = np.array([r["level"] for r in rows], np.int64)
        if not (rows and rows[0]["given"]):
            level = grade_toxic(begins, number, value, (level > 0).astype(np.int64), rule)
        model = fit_ordinal(begins, number, value, level, rule)
        used = np.flatnonzero(model.weights)
        packed = pickle.dumps((used.astype(np.int32), model.weights[used].astype(np.float32), model.thresholds))
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["model"])

    rows = _labelled_features(docs, labels, rule).repartition(1).sortWithinPartitions("doc_id")
    used, weights, thresholds = pickle.loads(rows.mapInArrow(run, "model binary").first()["model"])
    full = np.zeros(1 << rule.bits, np.float32)
    full[used] = weights
    return OrdinalModel(full, thresholds)


def score_toxicity(docs: DataFrame, model: OrdinalModel, rule: ToxicityRule = ToxicityRule(),
                   carry: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with severity, toxic_chance, grade, toxic; one row in, one row out, whole texts.

    ``severity`` is the expected grade, ``toxic_chance`` the probability of a grade above 0, ``grade`` the most probable one (the lower at ties),
    ``toxic`` whether the chance reaches ``rule.threshold``. A null or empty text has no features, so it gets the base rates.
    Input columns named like results are replaced; ``carry`` names the input columns returned (all).
    """
    added = ["severity", "toxic_chance", "grade", "toxic"]
    docs = without(docs, *added)
    carry = docs.columns if carry is None else list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            above = model.at_least(*features(texts_of(batch.column("text")), rule))
            padded = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in carry], pa.array(above.sum(1)), pa.array(above[:, 0]),
                pa.array((padded[:, :-1] - padded[:, 1:]).argmax(1).astype(np.int32)), pa.array(above[:, 0] >= rule.threshold),
            ], [*carry, *added])

    schema = StructType([docs.schema[c] for c in carry])
    schema = schema.add("severity", "double").add("toxic_chance", "double").add("grade", "integer").add("toxic", "boolean")
    return docs.mapInArrow(run, schema)
