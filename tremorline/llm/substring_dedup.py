"""Removing passages that repeat anywhere in the corpus, by windows of doubling length."""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.llm.text import whole, without
from tremorline.llm.words import Texts, covered, pieces, texts_of

_NONE = np.uint64(2**64 - 1)
_SITES = "tid binary, hash long, pos int, n long"


def _least_of(values: np.ndarray, width: int, ahead: bool) -> np.ndarray:
    """Least of each value and the ``width - 1`` next ones (or, not ``ahead``, previous ones); past the ends, of what is there."""
    out, reach = values.copy(), 1
    while reach < width:
        step = min(reach, width - reach)
        moved = out.copy()
        if ahead:
            np.minimum(out[:-step], out[step:], out=moved[:-step])
        else:
            np.minimum(out[step:], out[:-step], out=moved[step:])
        out, reach = moved, reach + step
    return out


class _Levels:
    """Windows of half length and whole length of some texts, by the word where they begin."""

    def __init__(self, texts: Texts, length: int):
        self.texts, self.length, self.half = texts, length, (length + 1) // 2
        self.count = len(texts.starts)
        self.hashes = np.full(self.count, _NONE, np.uint64)
        first, hashes = texts.windows(self.half)
        self.hashes[first] = hashes
        self.first, self.whole_hashes = texts.windows(length)
        #: Windows of half length inside one of whole length.
        self.inside = length - self.half + 1
        least = _least_of(self.hashes, self.inside, ahead=True) if self.count else self.hashes
        #: The least half window inside each whole one; none where no whole window begins.
        self.anchor_hash = np.full(self.count, _NONE, np.uint64)
        self.anchor_hash[self.first] = least[self.first]

    def anchors(self) -> np.ndarray:
        """Half windows that are the least inside some whole window around them."""
        if not self.count:
            return np.zeros(0, np.int64)
        chosen = ~_least_of(~np.where(self.anchor_hash == _NONE, np.uint64(0), self.anchor_hash), self.inside, ahead=False)
        return np.flatnonzero((chosen == self.hashes) & (self.hashes != _NONE))

    def extended(self, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole windows whose least half window is among the words marked ``alive``: where they begin, and their hashes."""
        if not self.count:
            return self.first, self.whole_hashes
        least = _least_of(np.where(alive, self.hashes, _NONE), self.inside, ahead=True)
        chosen = least[self.first] == self.anchor_hash[self.first]
        return self.first[chosen], self.whole_hashes[chosen]


def _marks(texts: Texts, column: pa.Array) -> np.ndarray:
    """Words marked by one list of positions per text (null: none)."""
    marked = np.zeros(len(texts.starts), bool)
    lists = column.fill_null([]) if column.null_count else column
    sizes = np.diff(lists.offsets.to_numpy())
    at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    marked[at + np.repeat(texts.bounds[:-1], sizes)] = True
    return marked


def _sites(batch: pa.RecordBatch, texts: Texts, begins: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    owner = texts.owner[begins] if len(begins) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([
        batch.column("tid").take(pa.array(owner)), pa.array(hashes.view(np.int64)),
        pa.array((begins - texts.bounds[owner]).astype(np.int32)), batch.column("n").take(pa.array(owner)),
    ], ["tid", "hash", "pos", "n"])


def _repeated_sites(sites: DataFrame, as_name: str) -> DataFrame:
    """Per text that occurs once, the positions whose window occurs elsewhere, too: ``(tid, as_name array<int>)``."""
    # Under another key than that of the count both sides of the join are plain exchanges, so that AQE can split a hot window's sites.
    often = sites.groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1").select(F.bitwise_not("hash").alias("_key"))
    once = sites.filter("n = 1").withColumn("_key", F.bitwise_not("hash"))
    return once.join(often, "_key", "left_semi").groupBy("tid").agg(F.collect_list("pos").alias(as_name))


def remove_repeats(docs: DataFrame, length: int = 35, texts: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and kept_text; one row in, one row out, whole texts.

    A word goes if a window of ``length`` words around it occurs at another place of the corpus, in the same text or another; windows
    are judged on the input. Kept words are joined by one space.

    Equal texts are worked on once, with their count. Level one counts windows of half the length; of these, only those are
    looked at that have the least hash within some whole window, as equal whole windows choose equal halves. Whole windows around
    a half that occurs once are dropped unseen. Level two extends the others to twice the length and counts those. Longer repeats
    consist of such windows, so the levels end there. Windows are compared by 64-bit hashes.
    The places of a window are never gathered; a text's places are, which its own length bounds.

    Null and empty texts have no words. Texts of fewer than ``length`` words lose none, however often they occur; equal texts of
    more lose all. Input columns named like results are replaced; ``texts=False`` leaves kept_text out.
    """
    added = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    docs = without(docs, *added, "_tid")
    tid = F.unhex(F.md5(whole("text").cast("binary")))
    distinct = docs.select(tid.alias("tid"), whole("text").alias("text")).groupBy("tid").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))

    def half_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            levels = _Levels(texts_of(batch.column("text")), length)
            at = levels.anchors()
            yield _sites(batch, levels.texts, at, levels.hashes[at])

    def whole_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            levels = _Levels(texts_of(batch.column("text")), length)
            alive = _marks(levels.texts, batch.column("alive"))
            often = batch.column("n").to_numpy() > 1
            yield _sites(batch, levels.texts, *levels.extended(alive | often[levels.texts.owner]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = texts_of(batch.column("text"))
            gone = np.zeros(len(found.starts), bool)
            at = np.flatnonzero(_marks(found, batch.column("repeats")))
            if len(at):
                gone = covered(len(found.starts), at, length)
            n_words = np.diff(found.bounds)
            gone |= ((batch.column("n").to_numpy() > 1) & (n_words >= length))[found.owner]
            removed = np.bincount(found.owner, gone, len(found)).astype(np.int64)
            raw, kept_texts = found.data.tobytes(), []
            for i in range(len(found)):
                words = raw[found.offsets[i]:found.offsets[i + 1]].split()
                if removed[i]:
                    words = [w for w, g in zip(words, gone[found.bounds[i]:found.bounds[i + 1]].tolist()) if not g]
                kept_texts.append(b" ".join(words))
            columns = [batch.column("tid"), pa.array(n_words.astype(np.int64)), pa.array(removed),
                       pa.array([sha256(k).hexdigest() for k in kept_texts], pa.string())]
            if texts:
                columns.append(pa.array([k.decode("utf-8", "replace") for k in kept_texts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["tid", *added[:len(columns) - 1]])

    halves = _repeated_sites(distinct.mapInArrow(half_windows, _SITES), "alive")
    # Texts that occur several times are extended whole, as each of their windows repeats.
    candidates = distinct.join(halves, "tid", "left").filter("alive is not null or n > 1").select("tid", "text", "n", "alive")
    wholes = _repeated_sites(candidates.mapInArrow(whole_windows, _SITES), "repeats")
    schema = "tid binary, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    results = distinct.join(wholes, "tid", "left").select("tid", "text", "n", "repeats").mapInArrow(cut, schema)
    return docs.withColumn("_tid", tid).join(results, F.col("_tid") == F.col("tid")).drop("_tid", "tid")
