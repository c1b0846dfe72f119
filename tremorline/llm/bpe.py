"""Byte-pair encoding as a streaming transducer of bounded lookahead, and decoding as a byte-to-text state machine.

A text goes through three machines in turn, each holding back only what later input could still change: special
tokens are cut out, the rest is cut into pretokens, and the bytes of a pretoken are merged in a window. The window
works because a merge list has a *sufficient lookahead*: bytes further away than that cannot change a token any more
(Berglund and van der Merwe, "Formalizing BPE Tokenization", 2023), so tokens leave the window once that much is known behind them.
"""
from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tremorline.llm.text import without
from tremorline.llm.words import pieces

# Fixed values of byte-level vocabularies: how they cut a text, and the bytes they write as the character of the same number.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN_BYTES = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
#: What may follow the last character that a pretoken depends on: the longest contraction has three characters.
_HELD = 3
_RUNS = [regex.compile(p) for p in (r"\s+", r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")]
_SPACE = _RUNS[0]
#: Characters of a text that are taken in at once.
CHUNK = 1 << 16
#: Pretokens of more characters pass through the window; shorter ones are merged at once and remembered.
_SHORT = 48
#: So many short pretokens are remembered, then the memory starts anew.
_REMEMBERED = 300_000


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: its own, or the next free one from 256 on."""
    plain = {b for r in _PLAIN_BYTES for b in r}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def sufficient_lookahead(merges: Sequence[tuple[int, int, int]], size: Sequence[int]) -> int:
    """Bytes behind a token after which nothing can change it, for ``merges`` as (left, right, made) in order of rank.

    Take two inputs that agree up to some byte and merge both, rule by rank. Their tokens agree up to a frontier, which
    only moves back when a rule joins the last token before it, its ``left``, to a token that starts there in one
    input only. From then on a token that starts at the new frontier has that ``left`` at the bottom of its left side. So the frontier
    moves along a chain of rules of rising rank, each with the ``left`` of the one before on the left side of its own
    ``right``, by the size of each ``left``: the heaviest chain bounds the way, and ranks make it one pass.
    """
    first_part = {made: left for left, _, made in merges}
    heaviest: dict[int, int] = {}
    bound = 0
    for left, right, _ in merges:
        before, token = 0, right
        while token is not None:
            before = max(before, heaviest.get(token, 0))
            token = first_part.get(token)
        chain = size[left] + before
        heaviest[left] = max(heaviest.get(left, 0), chain)
        bound = max(bound, chain)
    return bound


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level vocabulary, as the JSON text of a tokenizer file."""

    definition: str

    @classmethod
    def read(cls, path: str) -> Tokenizer:
        """The file is read where the query is built; its text travels with the tasks."""
        with open(path, encoding="utf-8") as file:
            return cls(file.read())

    @cached_property
    def tables(self) -> Tables:
        return Tables(json.loads(self.definition))


class Tables:
    """Ids of bytes, merges by pair, bytes of ids, special tokens and the sufficient lookahead."""

    def __init__(self, definition: dict):
        model = definition["model"]
        vocabulary, letters = model["vocab"], _byte_letters()
        splitter = definition.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") \
                or not splitter.get("use_regex", True) or definition.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only byte-level BPE without normalizer, dropout or prefix space is supported")
        added = definition.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.special = {t["content"]: t["id"] for t in added}
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = vocabulary[letter]
        known = set(self.of_byte)
        self.rank_of: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        rules = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            # The lookahead holds for lists in which every merge makes a new token from tokens made before.
            if left not in known or right not in known or made in known:
                raise ValueError(f"merge {rank} does not make a new token of earlier ones")
            known.add(made)
            self.rank_of[left, right] = rank
            self.made.append(made)
            rules.append((left, right, made))
        self.lookahead = sufficient_lookahead(rules, [len(b) for b in self.bytes_of])

    def merged(self, data: bytes) -> list[int]:
        """Tokens of some bytes that stand alone."""
        ids = [self.of_byte[b] for b in data]
        return self._merged_few(ids) if len(ids) <= 4 * _SHORT else self._merged_many(ids)

    def _merged_few(self, ids: list[int]) -> list[int]:
        find, none = self.rank_of.get, len(self.made)
        ranks = [find(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            ids[i:i + 2] = [self.made[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = find((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = find((ids[i], ids[i + 1]), none)
        return ids

    def _merged_many(self, ids: list[int]) -> list[int]:
        """The same through a heap of (rank, place), for windows of some thousand bytes."""
        find, n = self.rank_of.get, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        alive = [True] * n
        heap = [(rank, i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if (rank := find(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue  # one of the two was merged otherwise meanwhile
            ids[i], alive[j], after[i] = self.made[rank], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (rank := find((ids[a], ids[after[a]]))) is not None:
                    heapq.heappush(heap, (rank, a, ids[a], ids[after[a]]))
        return [t for t, kept in zip(ids, alive) if kept]


class _Window:
    """Merges the bytes of one pretoken of any length; tokens leave once the lookahead behind them is known."""

    def __init__(self, tables: Tables):
        self.tables, self.held = tables, bytearray()
        self.full = tables.lookahead + max(tables.lookahead, 4096)

    def feed(self, data: bytes) -> list[int]:
        out = []
        for start in range(0, len(data), self.full):
            self.held += data[start:start + self.full]
            if len(self.held) >= self.full:
                settled, end = len(self.held) - self.tables.lookahead, 0
                for token in self.tables.merged(bytes(self.held)):
                    size = len(self.tables.bytes_of[token])
                    if end + size > settled:
                        break
                    out.append(token)
                    end += size
                del self.held[:end]
        return out

    def finish(self) -> list[int]:
        tokens = self.tables.merged(bytes(self.held))
        self.held.clear()
        return tokens


class Encoder:
    """Token ids of a text that comes in pieces: ``feed`` each, then ``finish``; afterwards the next text may follow."""

    def __init__(self, tables: Tables):
        self.tables, self.window = tables, _Window(tables)
        self.short: dict[str, tuple[int, ...]] = {}
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(tables.special, key=len, reverse=True))) \
            if tables.special else None
        self.beginnings = {s[:n] for s in tables.special for n in range(1, len(s))}
        self.longest = max(map(len, self.beginnings), default=0)
        self._reset()

    def _reset(self) -> None:
        self.unsplit = self.rest = ""  # may begin a special token; may change as a pretoken
        self.run: regex.Pattern | None = None  # the kind of a long pretoken that is open

    def feed(self, text: str) -> list[int]:
        text, self.unsplit = self._whole_specials(self.unsplit + text)
        return self._cut(text)

    def finish(self) -> list[int]:
        out = self._cut(self.unsplit)
        out += self._pretokens("", True)
        self._reset()
        return out

    def _whole_specials(self, text: str) -> tuple[str, str]:
        """The text up to an end that may begin a special token, and that end."""
        for n in range(min(self.longest, len(text)), 0, -1):
            if text[len(text) - n:] in self.beginnings:
                return text[:len(text) - n], text[len(text) - n:]
        return text, ""

    def _cut(self, text: str) -> list[int]:
        out, at = [], 0
        for found in self.special.finditer(text) if any(s in text for s in self.tables.special) else ():
            out += self._pretokens(text[at:found.start()], True)
            out.append(self.tables.special[found.group()])
            at = found.end()
        out += self._pretokens(text[at:], False)
        return out

    def _pretokens(self, text: str, last: bool) -> list[int]:
        """Tokens of the pretokens that are settled; the others are kept in ``rest``, a long open one as ``run``."""
        text, self.rest, out, at = self.rest + text, "", [], 0
        if self.run is not None:
            found = self.run.match(text)
            at = found.end() if found else 0
            ends = last or at < len(text)
            # White space leaves its last character to what follows, unless the text ends.
            if self.run is _SPACE and at and not (last and at == len(text)):
                at -= 1
            out += self.window.feed(text[:at].encode())
            if not ends:
                self.rest = text[at:]
                return out
            out += self.window.finish()
            self.run = None
        pretokens = _PRETOKEN.findall(text, at)
        held = 0
        if not last:
            while pretokens and held < _HELD:
                held += len(pretokens.pop())
        known = self.short.get
        for pretoken in pretokens:
            out += known(pretoken) or self._tokens(pretoken)
        self.rest = text[len(text) - held:]
        if held > CHUNK // 4 and (found := _PRETOKEN.match(self.rest)).end() == held:
            self.run = next(r for r in _RUNS if r.match(text[-1]))
            fed = held - (self.run is _SPACE)
            out += self.window.feed(self.rest[:fed].encode())
            self.rest = self.rest[fed:]
        return out

    def _tokens(self, pretoken: str) -> Sequence[int]:
        if len(pretoken) > _SHORT:
            return self.window.feed(pretoken.encode()) + self.window.finish()
        if len(self.short) >= _REMEMBERED:
            self.short.clear()
        tokens = self.short[pretoken] = tuple(self.tables.merged(pretoken.encode()))
        return tokens


class Decoder:
    """Text of token ids that come in pieces; bytes that do not form a character yet are held, ones that never do become U+FFFD."""

    def __init__(self, tables: Tables):
        self.bytes_of, self.machine = tables.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Sequence[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        text = self.machine.decode(b"", True)
        self.machine.reset()
        return text


def encode_documents(docs: DataFrame, tokenizer: Tokenizer, column: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with n_tokens and ids, the token ids of the text in ``column``.

    Special tokens of the vocabulary are recognised where their strings stand in a text; none are added. A null or empty text has no tokens.
    Rows are worked off on their own, so repeated rows, ties and null ids each keep their row; columns of the input with
    the names of new ones are replaced; no rows in, no rows out. A text is taken in by pieces of 65,536 characters; besides text and
    result, a task holds the vocabulary, up to 300,000 short pretokens and a window of twice the lookahead or more.
    """
    rows = without(docs, "n_tokens", "ids")
    carry = [*(rows.columns if carry is None else carry)]
    rows = rows.select(*[f"`{c}`" for c in dict.fromkeys([*carry, column])])

    def run(batches):
        encoder = Encoder(tokenizer.tables)
        for batch in pieces(batches, column):
            ids = []
            for text in batch.column(column).to_pylist():
                text = text or ""
                own = []
                for start in range(0, len(text), CHUNK):
                    own += encoder.feed(text[start:start + CHUNK])
                own += encoder.finish()
                ids.append(own)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carry], pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                [*carry, "n_tokens", "ids"])

    schema = T.StructType([rows.schema[c] for c in carry]).add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, tokenizer: Tokenizer, column: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of the token ids in ``column`` as ``name``; null ids (or a null among them) give no text (are passed over).

    Special tokens come out as their strings. Ids outside the vocabulary fail the job. A column called ``name`` is replaced.
    """
    rows = without(encoded, name)
    names = rows.columns

    def run(batches):
        decoder = Decoder(tokenizer.tables)
        for batch in batches:
            texts = []
            for ids in batch.column(column):
                values = ids.values.drop_null().to_numpy(zero_copy_only=False) if ids.is_valid else ()
                parts = [decoder.feed(values[start:start + CHUNK].tolist()) for start in range(0, len(values), CHUNK)]
                texts.append("".join([*parts, decoder.finish()]) if ids.is_valid else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))
