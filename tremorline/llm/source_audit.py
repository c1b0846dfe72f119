"""How far each source of a language is from the others, over the terms that enough documents of the language hold.

The terms are found by refining prefixes, level by level: a level counts the documents that hold a term with a given byte
prefix, drops prefixes below the threshold, and hands the others on to be lengthened. A term that is no longer than the
level is complete and is counted as it is. No extension of a dropped prefix can reach the threshold, so rare strings, however many
and long, cost a short prefix.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorline.llm.text import whole
from tremorline.llm.words import Texts, mix, pieces, slice_hashes, texts_of
from tremorline.operators.scaling import attach
from tremorline.session import materialize

#: A kept term stands in so many documents of its language.
THRESHOLD = 3
#: Bytes of the first prefixes; each level doubles them.
FIRST_LEVEL = 6
#: Kept prefixes reach the next level as a filter of two to this power bits, whatever their number. A prefix that it lets pass by
#: chance is dropped by the next count.
FILTER_BITS = 25
#: Up to so many pairs of language and source are broadcast; more are joined by shuffling.
SMALL = 100_000
#: Ranks of terms that are reported.
TOP_TERMS = 200
SCALE = 1_000_000_000

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class _Terms(Texts):
    """Texts whose words are the terms; ``data`` has A-Z in lower case."""

    @cached_property
    def space(self) -> np.ndarray:
        return ~_IN_TERM[self.data]


def _terms_of(column: pa.Array) -> _Terms:
    found = texts_of(column)
    upper = (found.data >= 0x41) & (found.data <= 0x5A)
    return _Terms(found.data + (upper * np.uint8(0x20)), found.offsets)


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each row's place in the list of distinct values, that list, and a hash of each value."""
    found = column.fill_null("").dictionary_encode()
    values = texts_of(found.dictionary)
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary, \
        slice_hashes(values.byte_values, values.offsets[:-1], values.offsets[1:])


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])]).cast(pa.binary())


def _positions(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.int64((1 << bits) - 1)
    return keys & mask, (keys >> np.int64(bits)) & mask


def _level(low: int, high: int, kept: np.ndarray | None, bits: int):
    """Counts of terms of more than ``low`` bytes with a kept prefix: complete ones, by source, and prefixes of ``high`` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            terms = _terms_of(batch.column("text"))
            lang, langs, lang_hash = _coded(batch.column("lang"))
            source, sources, _ = _coded(batch.column("source"))
            at = np.flatnonzero(terms.ends - terms.starts > low)
            if kept is not None:
                begun = terms.starts[at]
                keys = mix(slice_hashes(terms.byte_values, begun, begun + low) + lang_hash[lang[terms.owner[at]]]).view(np.int64)
                one, two = _positions(keys, bits)
                at = at[(kept[one >> 6] >> (one & 63) & kept[two >> 6] >> (two & 63) & 1).astype(bool)]
            starts, ends, owner = terms.starts[at], terms.ends[at], terms.owner[at]
            whole_term = ends - starts <= high
            ends = np.minimum(ends, starts + high)
            group = np.where(whole_term, lang[owner] * (len(sources) + 1) + source[owner] + 1, lang[owner] * (len(sources) + 1)).astype(np.uint64)
            prefix = slice_hashes(terms.byte_values, starts, ends)
            together = mix(prefix + mix(group))
            order = np.lexsort((owner, together))
            if not len(order):
                continue
            ordered, by = together[order], owner[order]
            fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            begins = np.flatnonzero(fresh)
            new_doc = fresh | np.concatenate([[True], by[1:] != by[:-1]])
            first = order[begins]
            told = whole_term[first]
            # A source, complete or not, is told by its place; prefixes have none.
            yield pa.RecordBatch.from_arrays([
                langs.take(pa.array(lang[owner[first]])),
                sources.take(pa.array(source[owner[first]], mask=~told)),
                _slices(terms.data, starts[first], ends[first]), pa.array(told),
                pa.array(np.add.reduceat(new_doc.astype(np.int64), begins)),
                pa.array(np.diff(np.append(begins, len(order)))),
                pa.array(mix(prefix[first] + lang_hash[lang[owner[first]]]).view(np.int64)),
            ], ["lang", "source", "term", "complete", "docs", "n", "key"])
    return run


def _filter(survivors: DataFrame, bits: int) -> np.ndarray | None:
    """The keys' two bits each, as words of 64; None without keys. At most 2 ** (bits - 6) rows reach the driver."""
    mask = F.lit((1 << bits) - 1)
    places = F.array(F.col("key").bitwiseAND(mask), F.shiftright("key", bits).bitwiseAND(mask))
    spots = survivors.select(F.explode(places).alias("at")).select(
        F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    found = spots.groupBy("word").agg(F.bit_or("bit").alias("word_bits")).toArrow()
    if not found.num_rows:
        return None
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found.column("word").to_numpy()] = found.column("word_bits").to_numpy()
    return words


def kept_terms(docs: DataFrame, threshold: int = THRESHOLD, first_level: int = FIRST_LEVEL, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, term, docs (documents of the language with the term), n (occurrences) and entries (source, n) of every kept term.

    Texts are read whole; null text, lang and source read as empty. A term is a run of ASCII letters and characters beyond ASCII, A-Z in
    lower case. Every row is a document, also repeated ones and ones without an id. Within 1.5 MB of text, terms are told apart
    by 64-bit hashes, beyond that by their bytes. Each level reads the documents once; there are as many as the longest prefix of
    ``threshold`` documents takes doublings. A task holds one piece of text and the filter; the entries of a term are as many as its sources.
    """
    rows = docs.select(whole("text").alias("text"), whole("lang").alias("lang"), whole("source").alias("source"))
    low, high, kept, levels = 0, first_level, None, []
    while True:
        counted = rows.mapInArrow(_level(low, high, kept, filter_bits),
                                  "lang string, source string, term binary, complete boolean, docs long, n long, key long")
        by_source = counted.groupBy("lang", "source", "term", "complete").agg(
            F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.max("key").alias("key"))
        whole_lang = by_source.groupBy("lang", "term", "complete").agg(
            F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.max("key").alias("key"),
            F.collect_list(F.when(F.col("complete"), F.struct("source", "n"))).alias("entries"))
        levels.append(materialize(whole_lang.filter(F.col("docs") >= threshold), "terms"))
        kept = _filter(levels[-1].filter("not complete").select("key"), filter_bits)
        if kept is None:
            break
        low, high = high, 2 * high
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.filter("complete").select("lang", F.col("term").cast("string").alias("term"), "docs", "n", "entries")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / (total + terms)), exactly."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return 1 + F.call_function("div", top, (total + terms).cast("decimal(20,0)"))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _np_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For both orders of two sources that share a term: what the sum over each alone gets wrong by leaving out the other's count.

    Rows of a term follow one another, each with its place among them. Sources are paired with the next one, the one after, and so on.
    """
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        batch = table.to_batches()[0] if table.num_rows else batch
        begins = np.flatnonzero(batch.column("at").to_numpy(zero_copy_only=False) == 0)
        # The last term may go on in the next batch.
        cut = int(begins[-1]) if len(begins) else 0
        rest = batch.slice(cut)
        if cut:
            yield from _paired(batch.slice(0, cut), begins[:-1])
    if rest is not None and rest.num_rows:
        yield from _paired(rest, np.zeros(1, np.int64))


def _paired(batch: pa.RecordBatch, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    end = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
    group = batch.column("group").to_numpy(zero_copy_only=False)
    known, code = np.unique(group, return_inverse=True)
    p, p0 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "p0"))
    left, keys, values = np.arange(n), [], []
    for step in range(1, n):
        left = left[left + step < end[left]]
        if not len(left):
            break
        right = left + step
        for a, b in ((left, right), (right, left)):
            value = _np_distance(p[a], p[b]) - _np_distance(p[a], p0[b]) - _np_distance(p0[a], p[b]) + _np_distance(p0[a], p0[b])
            key = code[a] * len(known) + code[b]
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            keys.append(key[order][first])
            values.append(np.add.reduceat(value[order], first))
    if keys:
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        at = key[order][first]
        yield pa.RecordBatch.from_arrays([
            pa.array(known[at // len(known)]), pa.array(known[at % len(known)]), pa.array(np.add.reduceat(value[order], first))],
            ["group", "other", "value"])


def audit_sources(docs: DataFrame, terms: DataFrame | None = None, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: distances of each (lang, source) to the other sources of the lang, and its most telling terms.

    Each kept term has the share p = 1 + floor(10^9 (n + 1) / (N + V)) in a group, n its occurrences there, N their sum, V the kept
    terms of the lang; the distance is floor((p - q)^2 / q). Part ``pair`` sums it over all kept terms, q of another source; part
    ``term`` gives the ``top`` kept terms that a group has and has more of than its whole lang, q of the lang. Ranks start at 1, by
    value descending, then by item. Groups without terms take part; a lang without kept terms has value 0 for each pair. No rows in, no rows out.

    A pair's sum is taken apart, so that a term costs its own sources only: all terms at the counts 0, corrected for the terms of
    one source, then of the other (by how many terms have each count), then for the terms of both (source by source, in place).
    """
    stored = materialize(kept_terms(docs) if terms is None else terms, "kept_terms")
    entries = stored.select("lang", "term", F.col("n").alias("n_lang"), F.posexplode("entries").alias("at", "entry")).select(
        "lang", "term", "n_lang", "at", F.col("entry.source").alias("source"), F.col("entry.n").alias("n"))
    counts = materialize(entries.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("n_terms")), "counts")
    of_lang = stored.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    of_group = counts.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("n_terms")).alias("total"))
    groups = docs.select(whole("lang").alias("lang"), whole("source").alias("source")).distinct().join(of_lang, "lang", "left").join(
        of_group, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "total"]).withColumn(
        "group", F.xxhash64("lang", "source"))
    groups = materialize(groups.withColumn("p0", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms")))), "groups")

    is_small = groups.count() <= SMALL
    if is_small:
        joined = entries.join(F.broadcast(groups), ["lang", "source"])
    else:
        joined = attach(entries, groups, ["lang", "source"])
        joined = joined.repartition("lang", "term").sortWithinPartitions("lang", "term", "at")
    shares = joined.withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))

    q = _share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))
    telling = shares.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                                               _distance(F.col("p"), F.col("q")).alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    telling = telling.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    a = groups.filter("terms > 0").select("lang", "terms", *[F.col(c).alias(f"a_{c}") for c in ("source", "group", "total", "p0")])
    b = groups.select("lang", *[F.col(c).alias(f"b_{c}") for c in ("source", "group", "total", "p0")])
    pairs = a.join(b, "lang").filter("a_source != b_source").withColumn("at_zero", _distance(F.col("a_p0"), F.col("b_p0")))
    summed = [pairs.select("lang", "a_source", "b_source", (F.col("terms").cast("decimal(20,0)") * F.col("at_zero")).alias("value"))]
    for own in ("a", "b"):
        n_here = counts.withColumnRenamed("source", f"{own}_source")
        p = _share(F.col("n"), F.col(f"{own}_total"), F.col("terms"))
        apart = _distance(p, F.col("b_p0")) if own == "a" else _distance(F.col("a_p0"), p)
        change = F.col("n_terms").cast("decimal(20,0)") * (apart - F.col("at_zero")).cast("decimal(18,0)")
        summed.append(pairs.join(n_here, ["lang", f"{own}_source"]).select("lang", "a_source", "b_source", change.alias("value")))
    both = shares.select("group", "at", "p", "p0").mapInArrow(_shared_terms, "group long, other long, value long").groupBy("group", "other").agg(
        F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    summed.append(both.join(pairs.select("lang", "a_source", "b_source", F.col("a_group").alias("group"), F.col("b_group").alias("other")),
                            ["group", "other"]).select("lang", "a_source", "b_source", "value"))
    total = None
    for part in summed:
        part = part.select("lang", "a_source", "b_source", F.col("value").cast("decimal(38,0)").alias("value"))
        total = part if total is None else total.unionByName(part)
    total = total.groupBy("lang", "a_source", "b_source").agg(F.sum("value").cast("long").alias("value"))
    unkept = groups.filter("terms = 0").select("lang", F.col("source").alias("a_source")).join(
        groups.filter("terms = 0").select("lang", F.col("source").alias("b_source")), "lang").filter("a_source != b_source")
    total = total.unionByName(unkept.withColumn("value", F.lit(0).cast("long")))
    paired = total.select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), "value").withColumn(
        "rank", F.row_number().over(by_value))
    return paired.unionByName(telling)
