"""The audit against a brute-force one; levels, filter and joins of other sizes give the same."""
import random
import re
from collections import Counter, defaultdict

import pytest

from tremorline.llm import source_audit
from tremorline.llm.source_audit import audit_sources, kept_terms

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute(rows, top=200):
    docs = [(lang or "", source or "", terms_of(text)) for text, lang, source in rows]
    held, found = defaultdict(Counter), []
    for lang, _, terms in docs:
        held[lang].update(set(terms))
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= 3]
        counts = defaultdict(Counter)
        for at, source, terms in docs:
            if at == lang:
                counts[source].update(t for t in terms if held[lang][t] >= 3)
        total = sum(counts.values(), Counter())

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        share, q = {s: shares(c) for s, c in counts.items()}, shares(total)
        for s, p in share.items():
            pairs = [(sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other) for other, o in share.items() if other != s]
            telling = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[t] > q[t]]
            for part, ranked in (("pair", pairs), ("term", telling)):
                ranked = sorted(ranked, key=lambda r: (-r[0], r[1].encode()))
                found += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(found)


def found(df, **kwargs):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in audit_sources(df, **kwargs).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = ["the", "The", "ünder", "Ünder", "日本", "日本語の長い文章" * 9, "x" * 47, "x" * 48, "x" * 49, "a", "ab", "abc", "abcdef", "abcdefg", "it's", "foo_bar9baz",
             *[f"rare{'q' * i}" for i in range(12)]]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "s4", None]))
            for _ in range(150)]
    rows += [("hot " * 30, "en", "s1")] * 60  # one source, and copies
    rows += [(None, "en", "empty"), ("", "xx", "a"), ("once only", "xx", "b"), (None, "yy", "alone"), ("z" * 40_000 + " a b c", "en", "long")]
    return rows + [("z" * 40_000, "en", "long"), ("Z" * 40_000 + "!", "en", "long2")]


@pytest.mark.parametrize("small", [100_000, 0])
def test_brute(spark, monkeypatch, rows, small):
    monkeypatch.setattr(source_audit, "SMALL", small)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4).selectExpr("*", "'x' as term", "1 as n", "2 as `group`")
    assert found(df) == brute(rows)
    assert found(df, top=3) == brute(rows, 3)
    assert found(df.filter("false")) == []


def test_levels(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    def flat(terms):
        return sorted((r.lang, r.term, r.docs, r.n, sorted((e.source, e.n) for e in r.entries)) for r in terms.collect())
    usual = flat(kept_terms(df))
    assert ("en", "z" * 40_000) in {r[:2] for r in usual}
    for first, bits in ((1, 25), (100_000, 25), (5, 6)):  # a filter of 64 bits lets nearly all prefixes pass
        assert flat(kept_terms(df, first_level=first, filter_bits=bits)) == usual
    held = Counter((lang or "", t) for text, lang, _ in rows for t in set(terms_of(text)))
    for threshold in (1, 2, 20):
        assert {r[:3] for r in flat(kept_terms(df, threshold=threshold))} == {(*k, n) for k, n in held.items() if n >= threshold}
