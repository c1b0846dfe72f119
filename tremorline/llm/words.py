"""Words and windows of Arrow string columns as numpy arrays, for use inside tasks.

Everything works on the UTF-8 bytes of a whole batch at once. Words are runs of bytes other than ASCII white space.
Equality is decided by 64-bit hashes: prefix sums of ``value[i] * base**i`` modulo 2**64 give the hash of any slice as a
difference, and a final mixing step spreads it over all bits.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A batch is worked off in pieces of about so many bytes; a longer text is a piece of its own.
PIECE_BYTES = 1_500_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """base**i and base**-i for i below a growing length."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair; equal slices get equal hashes wherever they lie."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Texts:
    """Some texts: their bytes end to end, and where each begins (one offset more than texts)."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes().decode("utf-8", "replace")

    def counts(self, marked: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
        """How many bytes are marked in each text (or between other offsets)."""
        sums = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=sums[1:])
        return np.diff(sums[self.offsets if offsets is None else offsets])

    @cached_property
    def byte_values(self) -> np.ndarray:
        return _BYTE[self.data]

    @cached_property
    def space(self) -> np.ndarray:
        return _SPACE[self.data]

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        word = ~self.space
        fresh = np.zeros(len(word) + 1, bool)
        fresh[self.offsets] = True
        before = np.concatenate([[False], word[:-1]]) if len(word) else word
        after = np.concatenate([word[1:], [False]]) if len(word) else word
        starts = np.flatnonzero(word & (~before | fresh[:-1]))
        ends = np.flatnonzero(word & (~after | fresh[1:])) + 1
        return starts, ends

    @property
    def starts(self) -> np.ndarray:
        return self._edges[0]

    @property
    def ends(self) -> np.ndarray:
        return self._edges[1]

    @cached_property
    def bounds(self) -> np.ndarray:
        """Words of text i are those from bounds[i] up to bounds[i + 1]."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return slice_hashes(self.byte_values, self.starts, self.ends)

    @cached_property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``length`` words inside one text."""
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))
        first = np.flatnonzero(np.arange(len(self.starts)) + length <= last)
        return first, slice_hashes(self.word_hashes, first, first + length)


def texts_of(column: pa.Array) -> Texts:
    """Null reads as the empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(data, at - at[0])


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows again, in batches whose texts take about PIECE_BYTES or that are one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(texts_of(batch.column(column)).offsets)
        start = total = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > PIECE_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def covered(count: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``count`` words lie in a window of ``length`` words at one of ``starts``."""
    steps = np.zeros(count + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, starts + length, 1)
    return np.cumsum(steps[:-1]) > 0


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    ordered = np.sort(values)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    return twice[at] == values
