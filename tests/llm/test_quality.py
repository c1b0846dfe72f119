from collections import Counter

from tests.llm.brute import words
from tremorline.llm.quality import LineRules, clean_lines


def brute(text):
    w = words(text)
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
    inside = set()
    for j in range(len(w) - 7):
        if windows[tuple(w[j:j + 8])] > 1:
            inside.update(range(j, j + 8))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, again, len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w)


def check(rows):
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        assert r.n_words == r.n_lost_words + len(words(r.clean_text))
        assert r.kept == (not r.base_failed and r.n_lost_words <= 0.5 * r.n_words)


PROSE = "This line is plain prose of more than twelve words, and it ends with a full stop as prose does.\n"


def test_lines(docs_of):
    bad = ["Home | About | Contact | Help", "BUY NOW AND SAVE A LOT!", "go go go go go now.", "Menu item", "All rights reserved by Example, Inc.",
           "We use cookies to make this site work for you and others."]
    rows = [(i, PROSE * 2 + line + "\n" + PROSE.replace("plain", str(i))) for i, line in enumerate(bad)]
    rows += [(50, "\n".join(f"{line} {i}" for i in range(9) for line in bad[:4])), (51, "".join(f"Line {i} says a{i} b{i} c{i} d{i} e{i} f{i} g{i}, and stops.\n" for i in range(3)))]
    found = {r.doc_id: r for r in clean_lines(docs_of(rows)).collect()}
    check(found.values())
    for i, line in enumerate(bad):
        assert line not in found[i].clean_text and found[i].n_lost_words == len(words(line))
    assert not found[50].kept and found[51].kept and found[51].clean_text == found[51].text
    loose = LineRules(lost_share=1.0)
    assert clean_lines(docs_of([rows[-2]]), loose).first().n_lost_words == found[50].n_lost_words


def test_scripts_and_long_lines(docs_of):
    hindi = "\n".join(f"यह वाक्य संख्या {i} यहाँ समाप्त होता है।" for i in range(30))
    chinese = "\n".join(f"这 是 第 {i} 个 句子。" for i in range(30))
    unmarked = "\n".join(f"यह पंक्ति संख्या {i}" for i in range(30))
    one_line = " ".join(f"w{i}" for i in range(250)) + " read more " + " ".join(f"v{i}" for i in range(250)) + "."
    notice = PROSE * 2 + "Read more about this and that on our pages.\n"
    rows = [(1, hindi), (2, chinese), (3, unmarked), (4, one_line), (5, notice.replace("plain", "other", 1))]
    found = {r.doc_id: r for r in clean_lines(docs_of(rows)).collect()}
    check(found.values())
    assert [found[i].n_lost_words for i in (1, 2, 4)] == [0, 0, 0] and all(found[i].kept for i in (1, 2, 4))
    assert found[3].n_lost_words == found[3].n_words and not found[3].kept
    assert found[5].n_lost_words == 9


def test_edges(docs_of, edge_rows):
    df = docs_of([*edge_rows, (21, "a\na\n\n b\na"), (22, "\n\n"), (23, "x\x0by\x0cz #")], kept="old", Clean_Text="old")
    rows = clean_lines(df).collect()
    assert len(rows) == len(edge_rows) + 3
    check(rows)
    assert clean_lines(df.filter("false")).count() == 0
    assert clean_lines(df, texts=False, carry=["doc_id"]).columns[0] == "doc_id"


def test_table(sample):
    check(clean_lines(sample).collect())
