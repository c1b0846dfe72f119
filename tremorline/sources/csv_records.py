"""CSV files with quoted line breaks, read by many tasks a file.

Spark's line reader cuts a file into blocks by itself, but a line may begin inside a quoted text. What a block does to that state is
worked out for both states it may begin in; chaining these small functions along a file tells how each block begins, and then every
block is cut into records alone. A record that crosses blocks leaves a piece in each, and only such pieces are put together.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A field that opens a quote runs to the next single quote, then to the next comma; quotes elsewhere are plain characters.
_FIELDS = re.compile(r'(?:(?:"(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+),)*+("(?:[^"]++|"")*+\Z)?')
_CLOSING = re.compile(r'(?:[^"]++|"")*+(?:("[^,]*+)(?:,|\Z))?')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted text is open at the end of a line (without its line break) that begins inside one or not."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        closing = _CLOSING.match(line)
        if closing[1] is None:
            return True
        at = closing.end()
    return _FIELDS.match(line, at)[1] is not None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, list[str]]]:
    """Lines of one block, in order; a block may come in several runs."""
    for batch in batches:
        files, blocks = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        numbers = files.indices.to_numpy()
        change = np.flatnonzero((numbers[1:] != numbers[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            if b > a:
                inside = "inside" in batch.schema.names and batch.column("inside")[a].as_py()
                yield (files.dictionary[int(numbers[a])].as_py(), int(blocks[a])), inside, batch.column("value")[a:b].to_pylist()


class _Side:
    """A block read as if it began outside a quoted text, or inside one: what it leaves to its neighbours."""

    def __init__(self, inside: bool):
        self.state = inside
        #: Lines of the record that began in an earlier block; then of the record that is open now.
        self.head: list[str] | None = None
        self.lines: list[str] = []
        self.begun = inside

    def add(self, line: str) -> None:
        if '"' not in line and not self.state:
            return
        self.state = ends_inside(line, self.state)
        self.lines.append(line)
        if not self.state:
            if self.begun:
                self.head, self.begun = self.lines, False
            self.lines = []

    def pieces(self) -> list[str | None]:
        """The end of the record that began before, and the start of the one that goes on, if any."""
        head = self.lines if self.begun else self.head
        tail = None if self.begun or not self.lines else self.lines
        return [None if x is None else "\n".join(x) for x in (head, tail)]


_TURN = "file string, block long, " + ", ".join(f"{side} struct<state:boolean, head:string, tail:string>" for side in ("outside", "within"))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: for a block that begins outside a quoted text, and inside one, its end and the pieces it leaves."""
    kind = pa.struct([("state", pa.bool_()), ("head", pa.string()), ("tail", pa.string())])

    def row(block: tuple[str, int], sides: tuple[_Side, _Side]) -> pa.RecordBatch:
        told = [pa.array([dict(zip(("state", "head", "tail"), (s.state, *s.pieces())))], kind) for s in sides]
        return pa.RecordBatch.from_arrays([pa.array([block[0]]), pa.array([block[1]]), *told], ["file", "block", "outside", "within"])

    block, sides = None, None
    for here, _, lines in _runs(batches):
        if here != block:
            if block is not None:
                yield row(block, sides)
            block, sides = here, (_Side(False), _Side(True))
        outside, within = sides
        for line in lines:
            if '"' in line or outside.state:
                outside.add(line)
            if '"' in line or within.state:
                within.add(line)
    if block is not None:
        yield row(block, sides)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that lie in one block as a whole; the header is left out."""
    out: list[str] = []
    size = 0
    block, state, begun, header, held = None, False, False, False, []

    def packed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])
        out.clear()
        return batch

    for here, inside, lines in _runs(batches):
        if here != block:
            block, state, begun, held = here, inside, inside, []
            header = here[1] == 0  # still to come
        for line in lines:
            held.append(line)
            if '"' in line:
                state = ends_inside(line, state)
            if state:
                continue
            record = line if len(held) == 1 else "\n".join(held)
            held.clear()
            if begun:  # belongs to a record of an earlier block
                begun = False
            elif header and record.rstrip("\r"):
                header = False
            else:
                out.append(record)
                size += len(record)
                if size > 4_000_000 or len(out) >= 10_000:
                    yield packed()
                    size = 0
    if out:
        yield packed()


def _chained(turns: DataFrame) -> DataFrame:
    """``(file, state, blocks, open, records)``: the blocks that begin inside a quoted text, and the records that cross blocks.

    A file's blocks are gathered: one row of two pieces of records for each, while the driver holds as many splits.
    """
    in_order = F.array_sort(F.collect_list(F.struct("block", "outside", "within")))
    none, text = F.array().cast("array<bigint>"), F.array().cast("array<string>")

    def follow(at: Column, turn: Column) -> Column:
        side = F.when(at["state"], turn["within"]).otherwise(turn["outside"])
        joined = F.when(at["state"], F.concat(at["open"], F.array(side["head"]))).otherwise(at["open"])
        # A block inside one quoted text as a whole has neither end nor start of a record: it only adds to the open one.
        closed = at["state"] & (~side["state"] | side["tail"].isNotNull())
        left = F.when(closed | ~at["state"], F.when(side["tail"].isNotNull(), F.array(side["tail"])).otherwise(text)).otherwise(joined)
        return F.struct(
            side["state"].alias("state"),
            F.concat(at["blocks"], F.when(at["state"], F.array(turn["block"])).otherwise(none)).alias("blocks"),
            left.alias("open"),
            F.concat(at["records"], F.when(closed, F.array(F.array_join(joined, "\n"))).otherwise(text)).alias("records"))

    start = F.struct(F.lit(False).alias("state"), none.alias("blocks"), text.alias("open"), text.alias("records"))
    return turns.groupBy("file").agg(F.aggregate(in_order, start, follow).alias("c")).select("file", "c.*")


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(record)``: the records of CSV files as text without headers; nothing runs until they are used.

    A header is the first line of its file that is not empty; it has to end in the file's first block. Lines end in ``\\n`` or
    ``\\r\\n``, texts keep theirs; quotes open at the start of a field and are doubled inside. A quote that is never closed takes
    the rest of its file as one record. Blocks are read for their quotes first, then for their records.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    chained = _chained(lines.mapInArrow(_turns, _TURN))
    opened = chained.select("file", F.explode("blocks").alias("block"), F.lit(True).alias("_inside"))
    # Broadcast, so that lines keep their order: at most one row per block, as the driver holds one split for each.
    marked = lines.join(F.broadcast(opened), ["file", "block"], "left").select("file", "block", F.coalesce("_inside", F.lit(False)).alias("inside"), "value")
    never_closed = F.when(F.size("open") > 0, F.array(F.array_join("open", "\n"))).otherwise(F.array().cast("array<string>"))
    crossing = chained.select(F.explode(F.concat("records", never_closed)).alias("record"))
    return marked.mapInArrow(_cut, "record string").unionByName(crossing)


def csv_rows(spark: SparkSession, path: str | list[str], header: list[str], malformed: str) -> DataFrame:
    """Records as text columns named by ``header``, and in ``malformed`` the text of those with too many or too few fields."""
    names = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*header, malformed])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": malformed}
    records = csv_records(spark, path).select(F.regexp_replace("record", r"\r\z", "").alias("record")).filter("record != ''")
    return records.select(F.from_csv("record", names, options).alias("r")).select("r.*")
