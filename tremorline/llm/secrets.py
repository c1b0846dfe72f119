"""Finding credentials by pattern and by novelty against a primed compressor."""
from __future__ import annotations

import math
import random
import re
import string as chars
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tremorline.llm.text import without
from tremorline.llm.words import pieces

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

# Words that make what follows them sensitive.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey",
             "private_key", "privatekey", "credential", "bearer", "authorization", "auth_key", "signing_key", "client_id")
# Identifiers that are common in code and configuration; strings made of them are not novel.
IDENTIFIERS = (
    "configuration", "application", "development", "production", "environment", "default", "example", "placeholder", "changeme",
    "your_password_here", "your_api_key", "username", "password", "passphrase", "authentication", "authorization", "credentials",
    "certificate", "connection", "database", "localhost", "endpoint", "resource", "repository", "organization", "identifier",
    "parameter", "property", "attribute", "interface", "implementation", "abstract", "factory", "provider", "manager", "controller",
    "service", "client", "server", "session", "request", "response", "handler", "listener", "callback", "function", "undefined",
    "process.env", "os.environ", "getenv", "System.getProperty", "settings", "secrets", "client_secret", "access_token",
    "refresh_token", "token_type", "private_key", "public_key", "secret_key", "api_key", "example.com", "https://www.", "http://",
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "00000000000000000000", "xxxxxxxxxxxxxxxxxxxx",
)
_PRIMER = "\n".join(IDENTIFIERS).encode()
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{16,}")
_NEAR = re.compile("|".join(re.escape(w) for w in SENSITIVE), re.IGNORECASE | re.ASCII)
#: What any text with a span must match, for RE2: documents without it need no closer look.
_WORTH = "(?i:" + "|".join(re.escape(w) for w in (*SENSITIVE, "apikey", "api_key")) + ")|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"


@dataclass(frozen=True)
class Novelty:
    """When a string near a sensitive word is reported as novel."""

    #: The sensitive word ends at most so many characters before the string.
    reach: int = 48
    #: So many characters on either side prime the compressor, besides the identifiers.
    surround: int = 1024
    #: Least marginal compressed bytes for each character.
    ratio: float = 0.8
    #: A string of evenly used characters may be smaller: as small as this share of the size of the same characters in random order.
    shuffled: float = 0.95
    #: Characters are used evenly if their entropy is at most so many bits below what a random string of the length has.
    uneven: float = 0.25
    #: The string has at least so many digits, and so many letters.
    digits: int = 2
    letters: int = 2


def _long_hex(text: str) -> Iterator[tuple[int, int]]:
    for m in _HEX.finditer(text):  # a maximal run of 16 or more is what the greedy pattern finds
        yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index into KINDS, end) of the patterns' matches, leftmost and non-overlapping per kind, failing ones dropped."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(a, 2, b) for a, b in _long_hex(text)]
    return sorted(found)


def marginal_bytes(candidate: str, around: str) -> int:
    """Compressed bytes that the candidate adds to nothing, with identifiers and the text around it as the dictionary."""
    primer = zstandard.ZstdCompressionDict(_PRIMER + around.encode("utf-8", "replace"),
                                           dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=6, dict_data=primer, write_content_size=False, write_dict_id=False)
    return len(packer.compress(candidate.encode())) - len(packer.compress(b""))


_ALPHABETS = [frozenset(x) for x in (
    chars.digits + "abcdef", chars.digits + "ABCDEF", "234567" + chars.ascii_lowercase, "234567" + chars.ascii_uppercase,
    chars.digits + chars.ascii_lowercase, chars.digits + chars.ascii_uppercase, chars.digits + chars.ascii_letters,
    chars.digits + chars.ascii_letters + "+/", chars.digits + chars.ascii_letters + "-_", chars.digits + chars.ascii_letters + "-_.",
    chars.digits + chars.ascii_letters + "+/_.=~-")]


def evenly_used(string: str, rule: Novelty) -> bool:
    """Whether the string uses the smallest of the usual alphabets that holds it (but for = at its ends) like a random string."""
    string = string.strip("=")
    counts, n = Counter(string), max(1, len(string))
    size = next(len(a) for a in _ALPHABETS if a.issuperset(counts))
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return entropy >= math.log2(size) - (size - 1) / (2 * n * math.log(2)) - rule.uneven


def is_novel(string: str, around: str, rule: Novelty) -> bool:
    """A random string of k symbols shrinks to about log2(k) / 8 bytes a character, so that a fixed limit would lose long ones."""
    size = marginal_bytes(string, around)
    if size >= rule.ratio * len(string):
        return True
    if not evenly_used(string, rule):
        return False
    return size >= rule.shuffled * marginal_bytes("".join(random.Random(0).sample(string, len(string))), "")


def _without(text: str, a: int, b: int, spans: Sequence[tuple[int, int]]) -> str:
    """text[a:b] without the spans, which are in order."""
    out = []
    for start, end in spans:
        if start < b and end > a:
            out.append(text[a:max(a, start)])
            a = end
    return "".join(out) + text[a:b]


def novel_spans(text: str, base: Sequence[tuple[int, int, int]], rule: Novelty) -> list[tuple[int, int, int]]:
    """Strings of 16 or more characters close after a sensitive word, outside base spans, that the primed compressor cannot shorten."""
    strings: list[tuple[int, int]] = []
    seen_to = -1
    for near in _NEAR.finditer(text):
        for m in _CANDIDATE.finditer(text, max(near.end(), seen_to), min(len(text), near.end() + rule.reach + 4096)):
            if m.start() > near.end() + rule.reach:
                break
            a, b = m.span()
            if b == near.end() + rule.reach + 4096:
                b = _CANDIDATE.match(text, a).end()
            seen_to = b
            strings.append((a, b))
    found = []
    for i, (a, b) in enumerate(strings):
        string = text[a:b]
        digits = sum(c.isdigit() for c in string)
        letters = sum(c.isalpha() for c in string)
        if digits < rule.digits or letters < rule.letters or any(a < e and s < b for s, _, e in base):
            continue
        # A credential that is given twice must not hide itself.
        low, high = max(0, a - rule.surround), b + rule.surround
        first, last = i, i + 1
        while first and strings[first - 1][1] > low:
            first -= 1
        while last < len(strings) and strings[last][0] < high:
            last += 1
        bare = string.strip("=")
        copies = [(x, y) for x, y in strings[first:last] if bare in text[x:y]]
        around = _without(text, low, a, copies) + "\n" + _without(text, b, high, copies)
        if is_novel(string, around, rule):
            found.append((a, 3, b))
    return found


def spell(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, rule: Novelty = Novelty(), carry: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with the spans that look like credentials; one row in, one row out, whole texts.

    ``spans`` is ``kind:start:end`` in code points, end exclusive, by start, then in the order of ``KINDS``, comma-joined; ``base_spans``
    the same without kind ``novel``. ``n_assign``, ``n_access``, ``n_hex``, ``n_novel`` count them and ``base_sha256`` hashes ``base_spans``.
    A novel span is a string near a sensitive word whose marginal size under a dictionary-primed zstandard compressor stays at
    ``rule.ratio`` bytes a character or more, or at that of its own characters in random order if it uses its alphabet evenly; it never
    overlaps a base span. Copies of a string that are near a sensitive word, too, take no part in the dictionary; other copies do. Null reads as the empty text, which has no spans.
    Input columns named like results are replaced; ``carry`` names the input columns returned (all).
    """
    added = ["n_assign", "n_access", "n_hex", "n_novel", "base_spans", "base_sha256", "spans"]
    docs = without(docs, *added)
    carry = docs.columns if carry is None else list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = sha256(b"").hexdigest()
        for batch in pieces(batches):
            column = batch.column("text")
            worth = pc.fill_null(pc.match_substring_regex(column, _WORTH), False)
            out = [(0, 0, 0, 0, "", nothing, "")] * batch.num_rows
            for i in pc.indices_nonzero(worth).to_pylist():
                text = column[i].as_py()
                base = base_spans(text)
                every = sorted(base + novel_spans(text, base, rule))
                counts = [sum(k == kind for _, k, _ in every) for kind in range(4)]
                out[i] = (*counts, spell(base), sha256(spell(base).encode()).hexdigest(), spell(every))
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], *arrays], [*carry, *added])

    schema = StructType([docs.schema[c] for c in carry])
    for c in added:
        schema = schema.add(c, "long" if c.startswith("n_") else "string")
    return docs.mapInArrow(run, schema)
