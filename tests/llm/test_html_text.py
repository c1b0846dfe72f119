import html
import re

import pytest

from tremorline.llm.html_text import PageRule, Potentials, TreeModel, extract_pages, fit_pages, labels, main_text, marginals, parse

PAGE = """<html><head><title>T</title></head><body class="post"><header class="masthead"><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<div id="cookie-notice">We use cookies</div><div class="layout">{open}<h1>Head &amp; line</h1><p>First para with <a href=x>a link</a> in it that goes
on for quite some length, over a hundred characters in all.</p><div class="share-bar">Share</div><p>Second   para<br>here &lt;b&gt; with <b>bold</b>face
and more words to be a paragraph.</p><ul><li>item one<li>item two</ul><div class="comments"><p>{comment}</p></div>{close}<aside><p>{comment}</p></aside></div>
<section id="comments"><p>{comment}</p><p>{comment}</p></section><form><label>Mail</label></form><script>var x = "</p>";</script><footer>&copy;</footer>"""
TEXT = ("Head & line First para with a link in it that goes on for quite some length, over a hundred characters in all. Second para here <b> with boldface "
        "and more words to be a paragraph. item one item two")
COMMENT = "Nice article, I liked it very much and would read it again any time, thanks a lot for writing it."


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return fit_pages(pages)


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="entry-content">', "</div>")])
def test_articles(model, around):
    page = PAGE.format(open=around[0], close=around[1], comment=COMMENT)
    for m in (model, TreeModel.prior_with({})):
        assert main_text(page, Potentials(m), 0.5)[0] == TEXT


def test_marginals_are_exact(model):
    page = parse("<body><div><p>one</p><ul><li>two</li></ul></div><div class=content><p>" + "three " * 9 + "</p></div>")
    p, n = Potentials(model), len(page.blocks)
    total, content = 0.0, [0.0] * n
    for code in range(3**n):
        label = [code // 3**i % 3 for i in range(n)]
        weight = 1.0
        for i, b in enumerate(page.blocks):
            weight *= p.block(b)[label[i]] * (p.step(b)[label[b.parent]][label[i]] if b.parent >= 0 else 1)
        total += weight
        for i in range(n):
            content[i] += weight * (label[i] == 1)
    assert marginals(page, p) == pytest.approx([c / total for c in content])


def test_pages_that_label_themselves(pages, model):
    def truth(source):
        inside = re.search(r"<article>(.*?)</article>", source, re.DOTALL)[1]
        inside = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inside))
        return " ".join(html.unescape(inside).split())

    for r in extract_pages(pages, model).collect():
        assert r.text == truth(r.html) and r.n_chars == len(r.text)
    assert sum(labels(parse(r.html)) is not None for r in pages.collect()) == pages.count()
    assert fit_pages(pages.repartition(6)).counts == model.counts
    assert fit_pages(pages, PageRule(labelled=3)).counts != model.counts


def test_edges(spark, model, pages):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "plain text"), (3, "u", "<p a=\"b>x<<>&#x;"), (3, "u", "<article>" + "<div>" * 3000 + "deep"),
            (4, "u", "<!-- never closed"), (5, "u", "<script>never closed"), (6, "u", "</p></div>&lt;" + "<b>" * 2000), (7, "u", "<article><p>" + "w " * 50_000)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, Text string").repartition(3)
    found = extract_pages(df, model).collect()
    assert len(found) == len(rows)
    text = {(r.page_id, (r.html or "")[:12]): r.text for r in found}
    assert text[1, ""] == text[None, ""] == "" and text[7, "<article><p>"] == ("w " * 50_000).strip() and text[3, "<article><di"] == "deep"
    assert extract_pages(df.filter("false"), model).count() == 0
    assert fit_pages(df.filter("false")).counts == TreeModel.prior()


LONG = "A paragraph of the article itself that goes on for quite some length, with over a hundred characters and no link in it at all, as they do."
OWN = ['<section id="discussion">', '<div id="related-work">', '<section class="legal">', '<div class="widget">', '<section class="tabs">',
       '<section class="search-results">', '<section id="notice-period">', '<div class="alert banner">']


@pytest.mark.parametrize("opening", OWN)
def test_names_of_an_articles_own_sections(model, opening):
    close = "</" + opening[1:].split()[0] + ">"
    body = f"<body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{LONG}</p>{opening}<h2>Sub</h2><p>{LONG}</p>{close}<p>End.</p></article>"
    outside = f"{opening}<p>{COMMENT}</p><a href=x>more of this</a>{close}<div class=comments><p>{COMMENT}</p></div></body>"
    for m in (model, TreeModel.prior_with({})):
        assert main_text(body + outside, Potentials(m), 0.5)[0] == f"Head {LONG} Sub {LONG} End."


def test_heading_and_page_wide_form(model):
    page = f"""<body><form id=aspnet><div class=search><label>Search</label></div><article><h1>Head</h1><p>{LONG}</p><h2 id="follow-up">Later</h2><p>{LONG}</p>
    <form class=x><label>Mail</label><p>Your address</p></form><div class=sponsored-links><p>{COMMENT}</p></div></article><form><p>Ask us</p></form></form></body>"""
    for m in (model, TreeModel.prior_with({})):
        assert main_text(page, Potentials(m), 0.5)[0] == f"Head {LONG} Later {LONG}"


def test_labelled_pages_teach_a_name(spark):
    links = "".join(f"<p><a href=x>{w} and some more words to read</a></p>" for w in ("One", "Two", "Three"))
    probe = f"<body><article><p>{LONG}</p><div class=widget>{links}</div></article></body>"

    def taught(inside, outside):
        body = f"<body><article><p>{LONG}</p>{inside}</article>{outside}</body>"
        pages = spark.createDataFrame([(i, body) for i in range(400)], "page_id long, html string")
        return main_text(probe, Potentials(fit_pages(pages)), 0.5)[0]

    own, other = f"<div class=widget>{links}</div>", f"<aside class=widget>{links}</aside><div class=widget>{links}</div>"
    assert "Three" in taught(own, "") and "Three" in taught(own, other)
    assert "Three" not in taught("", other)
