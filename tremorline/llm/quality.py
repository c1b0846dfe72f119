"""Line-first cleaning: judge lines, drop the failing ones, then judge what is left of the document."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tremorline.llm.text import without
from tremorline.llm.words import Texts, covered, mix, pieces, repeated, slice_hashes, texts_of

# Phrases of notices around a text, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "use cookies", "enable javascript", "lorem ipsum", "powered by", "subscribe to our", "sign up for", "click here",
    "share on facebook", "share this", "read more", "back to top", "skip to content", "copyright (c)",
)
SYMBOLS = "#*$%&|<>"
_SENTENCE_MARKS = ".!?:;"
#: Marks of other scripts: whatever Unicode says ends a sentence, and wide forms of the marks above.
_OTHER_MARKS = "".join(c for c in map(chr, range(0x80, 0x20000)) if regex.match(r"\p{Sentence_Terminal}", c)) + "\uff1a\uff1b\u061b"


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; a line fails if any rule says so."""

    #: Navigation: more marks like | or > than this share of the words.
    symbols_per_word: float = 0.2
    #: Shouting: more than this share of the letters is upper case, in lines of three words or more.
    upper_share: float = 0.5
    #: Stutter: more than this share of the words equals the word before, in lines of four words or more.
    stutter_share: float = 0.3
    #: Punctuation: lines without a sentence mark need so many words.
    bare_words: int = 12
    #: Boilerplate: a line with a phrase fails if it has no more than so many words to each phrase in it.
    words_per_phrase: int = 30
    #: A document goes if it loses more than this share of its words.
    lost_share: float = 0.5


def _table(characters: str) -> np.ndarray:
    marked = np.zeros(256, bool)
    marked[list(characters.encode())] = True
    return marked


_IS_SYMBOL, _IS_MARK = _table(SYMBOLS), _table(_SENTENCE_MARKS)
_IS_UPPER, _IS_LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that make an upper or lower case letter, of ASCII or Latin-1."""
    upper, lower = _IS_UPPER[data], _IS_LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper[second] |= data[second] < 0x9F
    lower[second] |= data[second] >= 0x9F
    return upper, lower


def _lines(texts: Texts) -> np.ndarray:
    """Where lines begin, over all texts, and the end; a text begins a line."""
    breaks = np.flatnonzero(texts.data == 0x0A) + 1
    return np.unique(np.concatenate([breaks, texts.offsets])) if len(texts.data) else np.zeros(1, np.int64)


def judge(texts: Texts, rules: LineRules) -> dict[str, np.ndarray]:
    """Counts and verdicts per text, and ``lines`` / ``line_fails`` for the cleaned text."""
    data, n_texts = texts.data, len(texts)
    begins = _lines(texts)
    n_lines = len(begins) - 1
    line_text = np.searchsorted(texts.offsets, begins[:-1], "right") - 1

    words = np.zeros(len(data) + 1, np.int64)
    if len(data):
        np.add.at(words, texts.starts + 1, 1)
    words = np.diff(np.cumsum(words)[begins])
    upper, lower = _letters(data) if len(data) else (data, data)
    uppers, letters = texts.counts(upper, begins), texts.counts(upper | lower, begins)
    symbols, marks = texts.counts(_IS_SYMBOL[data], begins), texts.counts(_IS_MARK[data], begins)
    same = np.zeros(len(texts.starts), np.int64)
    line_of_word = np.searchsorted(begins, texts.starts, "right") - 1
    if len(same) > 1:
        hashes = texts.word_hashes
        same[1:] = (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    stutter = np.bincount(line_of_word, same, n_lines)
    if n_lines:
        line_array = pa.LargeStringArray.from_buffers(n_lines, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(data))
        bare = np.flatnonzero((marks == 0) & (words > 0) & (words < rules.bare_words) & (texts.counts(data >= 0x80, begins) > 0))
        found = pc.match_substring_regex(line_array.take(pa.array(bare)), f"[{_OTHER_MARKS}]")
        marks[bare] += found.to_numpy(zero_copy_only=False)
    fails = (
        (symbols > rules.symbols_per_word * words)
        | ((words >= 3) & (uppers > rules.upper_share * letters))
        | ((words >= 4) & (stutter > rules.stutter_share * words))
        | ((marks == 0) & (words < rules.bare_words))
    )
    if n_lines:
        pattern = "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE)
        phrases = pc.count_substring_regex(line_array, pattern, ignore_case=True).to_numpy(zero_copy_only=False)
        fails |= (phrases > 0) & (words <= rules.words_per_phrase * phrases)
    fails &= words > 0

    content_ends = begins[1:] - (data[begins[1:] - 1] == 0x0A) if n_lines else begins[1:]
    seen = mix(slice_hashes(texts.byte_values, begins[:-1], content_ends) + line_text.astype(np.uint64) * np.uint64(0x9E3779B1))
    full = np.flatnonzero(words > 0)
    _, first = np.unique(seen[full], return_index=True)
    again = np.ones(len(full), np.int64)
    again[first] = 0
    start, hashes = texts.windows(8)
    twice = repeated(mix(hashes + texts.owner[start].astype(np.uint64) * np.uint64(0x9E3779B1)))
    in_repeat = covered(len(texts.starts), start[twice], 8)

    n_words = np.diff(texts.bounds)
    n_repeat = np.bincount(texts.owner, in_repeat, n_texts).astype(np.int64)
    lost = np.bincount(line_text, words * fails, n_texts)
    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    return {
        "n_words": n_words,
        "word_chars": texts.counts(~texts.space & ((data & 0xC0) != 0x80)),
        "n_symbols": texts.counts(_IS_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_text[full], again, n_texts).astype(np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "n_lost_words": lost.astype(np.int64),
        "kept": ~base_failed & (lost <= rules.lost_share * n_words),
        "lines": begins, "line_text": line_text, "line_fails": fails,
    }


def _cleaned(texts: Texts, found: dict[str, np.ndarray]) -> list[str]:
    out: list[str] = []
    cuts = np.searchsorted(found["line_text"], np.arange(len(texts) + 1))
    for i in range(len(texts)):
        mine = slice(cuts[i], cuts[i + 1])
        if not found["line_fails"][mine].any():
            out.append(texts.text(i))
            continue
        ends = found["lines"][1:][mine]
        kept = [texts.data[a:b].tobytes() for a, b, bad in zip(found["lines"][:-1][mine], ends, found["line_fails"][mine])
                if not bad]
        out.append(b"".join(kept).decode("utf-8", "replace").rstrip("\n"))
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words")


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), texts: bool = True,
                carry: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with line-cleaned text, counts and verdict per document; one row in, one row out.

    A line (split at ``\\n``) with a word fails for navigation marks, shouting, stuttering, missing sentence marks (of any
    script) or phrases of ``BOILERPLATE`` that are a fair share of it (one to ``rules.words_per_phrase`` words). ``clean_text`` keeps the other lines; ``n_lost_words`` counts the words lost. The base rule fails
    documents of under 20 words, or with over 30 % of their words in 8-word windows that occur twice in the document;
    ``kept`` is false for these and for documents that lose more than ``rules.lost_share`` of their words. Null and empty texts
    count 0 throughout and fail. Input columns named like results are replaced; ``texts=False`` leaves ``clean_text`` out, ``carry`` names the input columns returned (all).
    """
    added = [*COUNTS, "base_failed", "kept", "clean_text"]
    docs = without(docs, *added)
    carry = docs.columns if carry is None else list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts_ = texts_of(batch.column("text"))
            found = judge(texts_, rules)
            arrays = [*[batch.column(c) for c in carry], *[pa.array(found[c].astype(np.int64)) for c in COUNTS],
                      pa.array(found["base_failed"]), pa.array(found["kept"])]
            names = [*carry, *COUNTS, "base_failed", "kept"]
            if texts:
                arrays.append(pa.array(_cleaned(texts_, found), pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = StructType([docs.schema[c] for c in carry])
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean")
    return docs.mapInArrow(run, schema.add("clean_text", "string") if texts else schema)
