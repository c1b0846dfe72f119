"""Finding benchmark passages in documents by the q-gram lemma and banded alignment."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tremorline.llm.text import without
from tremorline.llm.words import pieces

_BASE = 0x9E3779B97F4A7C15
_PAD = 0x200000  # no code point
_FAR = 1 << 20
#: Bands that are aligned at once.
_ALIGNED = 2048
#: Index bits of the table that most q-grams of a document are looked up in first.
_TABLE_BITS = 22


@dataclass(frozen=True)
class LeakRule:
    #: Characters of a q-gram.
    q: int = 8
    #: Edits allowed for each character of an item.
    edits: float = 0.1
    #: Items are searched for in blocks of about so many characters; each block is one pass over the documents.
    block_chars: int = 4_000_000


def folded(text: str) -> np.ndarray:
    """Code points in lower case, white space as spaces; as many as the text has."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points >= 9) & (points <= 13)] = 32
    return points


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash for each run of q code points, by its first."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    out, length = None, 0
    part, size, left = points.astype(np.uint64) + np.uint64(1), 1, q
    while left:
        if left & 1:
            if out is None:
                out, length = part, size
            else:
                n = len(points) - length - size + 1
                out = out[:n] * np.uint64(pow(_BASE, size, 2**64)) + part[length:length + n]
                length += size
        left >>= 1
        if left:
            n = len(points) - 2 * size + 1
            part = part[:n] * np.uint64(pow(_BASE, size, 2**64)) + part[size:size + n]
            size *= 2
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(29))


class Items:
    """An index over the q-grams of some benchmark items."""

    def __init__(self, items: Sequence[tuple[int | None, str]], rule: LeakRule):
        self.q = rule.q
        self.ids = [i for i, _ in items]
        self.points = [folded(t) for _, t in items]
        sizes = np.array([len(p) for p in self.points], np.int64)
        #: Edits allowed; fewer for short items, so that at least one q-gram must be shared.
        self.budget = np.minimum((sizes * rule.edits + 1e-9).astype(np.int64), (sizes - rule.q) // rule.q)
        self.least = sizes - rule.q + 1 - self.budget * rule.q
        grams = [_grams(p, rule.q) for p in self.points]
        values = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values, self.first, self.count = np.unique(values[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.arange(len(items)), [len(g) for g in grams])[order]
        self.place = (np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64))[order]
        self.pad = int(self.budget.max(initial=0)) + 1
        self._known: np.ndarray | None = None

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, diagonal) of each q-gram that the points share with an item; diagonal = place here - place in the item."""
        if self._known is None:  # built where it is used, not shipped
            self._known = np.zeros(1 << _TABLE_BITS, bool)
            self._known[self.values >> np.uint64(64 - _TABLE_BITS)] = True
        grams = _grams(points, self.q)
        at = np.flatnonzero(self._known[grams >> np.uint64(64 - _TABLE_BITS)])
        found = np.searchsorted(self.values, grams[at])
        same = found < len(self.values)
        same[same] = self.values[found[same]] == grams[at][same]
        at, found = at[same], found[same]
        times = self.count[found]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(self.first[found], times) + step
        return self.item[entry], np.repeat(at, times) - self.place[entry]


def banded(patterns: Sequence[np.ndarray], points: np.ndarray, low: np.ndarray, width: int, start: int | None = None) -> np.ndarray:
    """Least edits from each whole pattern to points, by final diagonal, inside the ``width`` diagonals from its ``low``.

    Without ``start`` an alignment may begin on any diagonal of its band, else only on that one (counted in the band).
    """
    sizes = np.array([len(p) for p in patterns], np.int64)
    order = np.argsort(-sizes, kind="stable")  # the patterns that go on are then a prefix
    longest = int(sizes.max(initial=0))
    matrix = np.zeros((longest, len(patterns)), np.uint32)
    for k, c in enumerate(order.tolist()):
        matrix[:sizes[c], k] = patterns[c]
    going = len(patterns) - np.searchsorted(np.sort(sizes), np.arange(longest), "right")
    steps = np.arange(width, dtype=np.int32)
    shift = max(width, -int(low.min(initial=0)))
    fill = np.full(shift + longest + width, _PAD, np.uint32)
    points = np.concatenate([fill[:shift], points, fill])
    at = (np.minimum(low[order], len(points) - longest - width - shift) + shift)[:, None] + steps[None, :]
    costs = np.zeros((len(patterns), width), np.int32)
    if start is not None:
        costs[:] = np.where(steps >= start, steps - start, _FAR)
    for i in range(longest):
        n = going[i]
        swap = costs[:n] + (points[at[:n] + i] != matrix[i, :n, None])
        swap[:, :-1] = np.minimum(swap[:, :-1], costs[:n, 1:] + 1)
        swap -= steps
        np.minimum.accumulate(swap, axis=1, out=costs[:n])
        costs[:n] += steps
    out = np.empty_like(costs)
    out[order] = costs
    return out


def leaks(texts: Sequence[str | None], items: Items) -> list[list[tuple[int | None, int, int, int]]]:
    """For each text the leaks (item id, start, end, edits), by start, end and item."""
    out: list[list[tuple[int | None, int, int, int]]] = [[] for _ in texts]
    if not len(items.values):
        return out
    pad = np.full(items.pad, _PAD, np.uint32)
    parts, begins, total = [pad], [], len(pad)
    for text in texts:
        points = folded(text or "")
        begins.append(total)
        parts += [points, pad]
        total += len(points) + len(pad)
    points = np.concatenate(parts)
    item, diagonal = items.hits(points)
    half = 2 * items.budget[item] + 1
    cell = (diagonal + _FAR) // half  # bands overlap by half, so some band holds any 2 * budget + 1 diagonals
    keys = np.concatenate([item * (1 << 40) + cell, item * (1 << 40) + cell - 1])
    bands, shared = np.unique(keys, return_counts=True)
    owner = bands >> 40
    bands, owner = bands[shared >= items.least[owner]], owner[shared >= items.least[owner]]
    for some in np.array_split(np.arange(len(bands)), -(-len(bands) // _ALIGNED)) if len(bands) else []:
        numbers, budget = owner[some], items.budget[owner[some]]
        low = (bands[some] & ((1 << 40) - 1)) * (2 * budget + 1) - _FAR
        patterns = [items.points[n] for n in numbers.tolist()]
        edits = banded(patterns, points, low, int(2 * (2 * budget.max() + 1)))
        best = edits.argmin(1)
        cost = edits[np.arange(len(some)), best]
        good = np.flatnonzero(cost <= budget)
        if not len(good):
            continue
        ends = low[good] + best[good] + np.array([len(patterns[k]) for k in good.tolist()])
        # Backwards from each end: the nearest start that the same edits reach.
        side = int(budget.max())
        back = banded([patterns[k][::-1] for k in good.tolist()], points[::-1], len(points) - ends - side, 2 * side + 1, side)
        reached = back == back.min(1, keepdims=True)
        offset = np.where(reached, np.abs(np.arange(2 * side + 1) - side), _FAR).argmin(1) - side
        found = sorted(zip(cost[good].tolist(), (ends - offset).tolist(), ends.tolist(), good.tolist()))
        for edit, shifted_end, end, k in found:
            number, start = int(numbers[k]), shifted_end - len(patterns[k])
            text = int(np.searchsorted(begins, start, "right")) - 1
            shift = begins[text]
            mine = out[text]
            if not any(n == number and a < end - shift and start - shift < b for n, a, b, _ in mine):
                mine.append((number, start - shift, end - shift, edit))
    return [[(items.ids[n], a, b, e) for n, a, b, e in sorted(m, key=lambda f: (f[1], f[2], f[0]))] for m in out]


def _blocks(benchmark: DataFrame, rule: LeakRule) -> Iterator[Items]:
    """The items in blocks; short or null texts are left out. Only one block is on the driver at a time."""
    block: list[tuple[int | None, str]] = []
    size = 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if row.text is None or len(row.text) < rule.q:
            continue
        if block and size + len(row.text) > rule.block_chars:
            yield Items(block, rule)
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    yield Items(block, rule)


LEAKS = T.StructField("leaks", T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("edits", T.IntegerType()),
])))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rule: LeakRule = LeakRule(), carry: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``leaks``: where benchmark items lie in the whole text, with up to ``rule.edits`` edits a character.

    One row in, one row out; ``leaks`` is an array of (item_id, start, end, edits) in code points of the text, end exclusive, empty if
    there is none. Case is ignored and any white space reads as a space. Of overlapping finds of one item the one with fewest edits stays;
    equal items are each found.

    An item of m characters within k edits of a passage shares at least m - q + 1 - kq q-grams with it, on at most 2k + 1 neighbouring
    diagonals. Shared q-grams are counted in overlapping bands of diagonals; bands that reach the bound are aligned with the item inside
    the band. Short items get fewer edits, so that the bound stays positive; items under q characters, and null ones, are not searched
    for. Null and empty texts have no leaks. The benchmark is searched block by block, each a pass without a shuffle, so neither
    its size nor a frequent passage gathers rows anywhere. An input column named leaks is replaced; ``carry`` names the columns returned.
    """
    docs = without(docs, "leaks")
    carry = docs.columns if carry is None else list(carry)
    need_text = "text" not in carry

    def with_block(rows: DataFrame, items: Items, first: bool, last: bool) -> DataFrame:
        names = carry + ["text"] * (need_text and not last)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                found = leaks(batch.column("text").to_pylist(), items)
                if not first:
                    before = batch.column("leaks").to_pylist()
                    found = [[*[tuple(x.values()) for x in old], *new] for old, new in zip(before, found)]
                    found = [sorted(f, key=lambda x: (x[1], x[2], x[0] is None, x[0] or 0)) for f in found]
                made = [[dict(zip(("item_id", "start", "end", "edits"), x)) for x in f] for f in found]
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(made, kind)], [*names, "leaks"])

        schema = T.StructType([docs.schema[c] for c in names])
        return rows.mapInArrow(run, schema.add(LEAKS))

    waiting, rows, first = None, docs, True
    for items in _blocks(benchmark, rule):
        if waiting is not None:
            rows, first = with_block(rows, waiting, first, False), False
        waiting = items
    return with_block(rows, waiting, first, True)
