"""The transducer against the tokenizers library; the lookahead against random merge lists."""
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from tremorline.llm import bpe
from tremorline.llm.bpe import Decoder, Encoder, Tokenizer, decode_documents, encode_documents, sufficient_lookahead

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "\u00a0", "a", "the", "'re", "'ll", "'", "r", "l", "é", "日", "1", "23", "!", "...", "<|endoftext|>", "<|end", "😀", "ing"]


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.read(PATH)


def streamed(tables, text, size):
    encoder = Encoder(tables)
    return [t for i in range(0, len(text), size) for t in encoder.feed(text[i:i + size])] + list(encoder.finish())


def test_any_cut(library, tokenizer):
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50)))
        ids = library.encode(text, add_special_tokens=False).ids
        for size in (1, 2, 7, 1 << 16):
            assert streamed(tokenizer.tables, text, size) == ids
        for size in (1, 3):
            decoder = Decoder(tokenizer.tables)
            parts = [decoder.feed(ids[i:i + size]) for i in range(0, len(ids), size)]
            assert "".join([*parts, decoder.finish()]) == library.decode(ids, skip_special_tokens=False) == text


def test_long_pretokens(library, tokenizer, monkeypatch):
    rng = random.Random(4)
    texts = ["a" * 30_000, " " * 30_000 + "x", "the" * 9_000, "".join(rng.choice("abcdefgh") for _ in range(30_000)), "x" + " " * 20_000 + "\n" * 20_000 + "y",
             "!?" * 9_000 + "'re", "日本語" * 9_000, "1" * 20_001, " " * 20_000, " " + "z" * 20_000 + "<|endoftext|>" + "z" * 20_000]
    for chunk in (1 << 16, 400):
        monkeypatch.setattr(bpe, "CHUNK", chunk)  # long pretokens stay open over many pieces
        encoder = Encoder(tokenizer.tables)
        for text in texts:
            tokens, most = [], 0
            for i in range(0, len(text), chunk):
                tokens += encoder.feed(text[i:i + chunk])
                most = max(most, len(encoder.window.held) + len(encoder.rest))
            assert tokens + list(encoder.finish()) == library.encode(text, add_special_tokens=False).ids
            if chunk == 400:
                assert most < encoder.window.full + 4 * chunk


def test_lookahead_is_sufficient():
    """Tokens further than the lookahead from the end of what is known do not change, whatever follows."""
    rng = random.Random(5)
    for _ in range(60):
        text_of, rules, known = {i: chr(97 + i) for i in range(3)}, [], set("abc")
        while len(rules) < 12:
            left, right = rng.choice(list(text_of)), rng.choice(list(text_of))
            if (made := text_of[left] + text_of[right]) not in known:
                known.add(made)
                text_of[len(text_of)] = made
                rules.append((left, right, len(text_of) - 1))
        bound = sufficient_lookahead(rules, [len(text_of[i]) for i in range(len(text_of))])

        def merged(ids):
            for left, right, made in rules:
                out, i = [], 0
                while i < len(ids):
                    pair = ids[i:i + 2] == [left, right]
                    out.append(made if pair else ids[i])
                    i += 1 + pair
                ids = out
            return [text_of[i] for i in ids]

        for _ in range(20):
            ids = [rng.randrange(3) for _ in range(60)]
            whole = merged(ids)
            for n in range(60):
                kept, end = [], 0
                for token in merged(ids[:n]):
                    end += len(token)
                    if end > n - bound:
                        break
                    kept.append(token)
                assert whole[:len(kept)] == kept


def test_documents(docs_of, edge_rows, library, tokenizer, sample):
    df = docs_of([*edge_rows, (30, "a <|endoftext|> b"), (31, "x" * 300_000)], ids="old", Decoded="old")
    rows = decode_documents(encode_documents(df, tokenizer), tokenizer).collect()
    assert len(rows) == len(edge_rows) + 2
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, library.decode(ids, skip_special_tokens=False))
    assert encode_documents(df.filter("false"), tokenizer).count() == 0
    for r in encode_documents(sample, tokenizer, carry=["text"]).collect():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids
    nothing = df.limit(1).selectExpr("cast(null as array<int>) as ids", "1 as k")
    assert decode_documents(nothing, tokenizer).first().decoded is None
