"""Main text of web pages by sum-product inference on the tree of their elements."""
from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tremorline.llm.text import whole, without
from tremorline.llm.words import pieces

_TAG = re.compile(
    r"""<!--.*?(?:-->|$)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|$)""", re.DOTALL)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+|[0-9]+")

# Elements whose inside is no running text.
_SILENT = {"script", "style", "noscript", "template", "title", "textarea", "select", "iframe", "svg", "object", "canvas", "math", "head"}
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# An opening tag closes open elements of these kinds, up to the nearest of the bounds.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_CLOSES_P = _BLOCK - {"body", "html", "button", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "legend", "figcaption", "li", "dd", "dt"} | {"hr"}

# What words in class, id and role say about an element.
_WORDS = {
    "ad": ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner"),
    "menu": ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "toolbar"),
    "aside": ("sidebar", "aside", "widget", "related", "recommended", "rail", "trending", "complementary"),
    "comment": ("comment", "comments", "disqus", "replies", "reply", "respond", "discussion"),
    "notice": ("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "subscription", "gdpr", "paywall"),
    "share": ("share", "social", "sharing", "follow", "login", "signup", "search", "form", "rating"),
    "footer": ("footer", "foot", "copyright", "colophon", "legal", "contentinfo"),
    "header": ("header", "masthead", "topbar", "logo", "branding"),
    "content": ("article", "content", "post", "entry", "main", "story", "body", "text", "maintext"),
}
_MEANING = {word: kind for kind, words in _WORDS.items() for word in words}
# Of these, the words that an article's own sections bear as well; their kinds end in "?".
_UNSURE = {
    "promo", "promotion", "banner", "toc", "tabs", "toolbar", "aside", "widget", "related", "recommended", "rail", "trending", "complementary",
    "replies", "reply", "respond", "discussion", "notice", "alert", "consent", "subscription", "follow", "login", "signup", "search", "form", "rating",
    "foot", "legal",
}
_OUTSIDE = {"nav", "footer", "aside", "button", "menu", "dialog"}
_FORMS = {"form", "fieldset"}
_AGAINST = {"ad", "menu", "aside", "comment", "notice", "share", "footer"}
_MAYBE = {f"{kind}?" for kind in _AGAINST}


@dataclass(frozen=True)
class PageRule:
    #: Pages with an article or main element label themselves; those of the lowest hash of page_id are used, at most so many.
    labelled: int = 2000
    #: A block is content if its marginal reaches this probability.
    threshold: float = 0.5
    seed: int = 5


@dataclass
class Block:
    tag: str
    kind: str
    parent: int
    chars: int = 0
    linked: int = 0


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: (block, text) in page order.
    parts: list[tuple[int, str]] = field(default_factory=list)


def _kind(attributes: str, tag: str) -> str:
    """The kind that class, id and role name; of several, one that is no article text, sure ones first, except for the page's large frames."""
    found = maybe = ""
    for m in _NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            tokens = _TOKEN.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
            if tokens and tokens[0] in ("has", "with", "no", "is", "without"):
                continue
            kinds = [_MEANING[t] for t in tokens if t in _MEANING]
            against = [k for k in kinds if k in _AGAINST]
            if against and tag not in ("html", "body", "main", "article"):
                sure = [_MEANING[t] for t in tokens if _MEANING.get(t) in _AGAINST and t not in _UNSURE]
                if sure:
                    return sure[0]
                maybe = maybe or f"{against[0]}?"
            found = found or next((k for k in kinds if k not in _AGAINST), "")
    return maybe or found


def parse(source: str) -> Page:
    """Blocks of a page with the texts directly inside them; never fails, whatever is left open or unclosed."""
    page = Page([Block("root", "", -1)])
    stack: list[tuple[str, int]] = [("root", 0)]  # open elements and the block their text belongs to
    text: list[str] = []
    links = silent = 0
    at = 0

    def flush() -> None:
        if text:
            joined = "".join(text)
            text.clear()
            if joined and not joined.isspace():
                page.parts.append((stack[-1][1], joined))

    def close(down_to: int) -> None:
        nonlocal links, silent
        while len(stack) > down_to:
            tag, _ = stack[-1]
            if tag in _BLOCK or tag in _SILENT:
                flush()
            if tag == "a":
                links -= 1
            if tag in _SILENT:
                silent -= 1
            stack.pop()

    def add(piece: str) -> None:
        if piece and not silent:
            piece = html.unescape(piece)
            text.append(piece)
            block = page.blocks[stack[-1][1]]
            size = len(piece.strip())
            block.chars += size
            block.linked += size if links else 0

    while m := _TAG.search(source, at):
        add(source[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            continue
        if tag in _CLOSES_P or tag in _CLOSES:
            targets, bounds = _CLOSES.get(tag, (set(), set()))
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i][0]
                if open_tag in targets or (open_tag == "p" and tag in _CLOSES_P):
                    close(i)
                    break
                if open_tag in bounds or (open_tag in _BLOCK and not targets):
                    break
        if tag == "body" and silent:
            close(next((i for i in range(1, len(stack)) if stack[i][0] == "head"), len(stack)))
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?![a-zA-Z0-9:-])[^>]*>?", re.IGNORECASE).search(source, at)
            at = end.end() if end else len(source)
            continue
        if m[3].endswith("/") and tag not in _BLOCK:
            continue
        block = stack[-1][1]
        if tag in _BLOCK:
            flush()
            page.blocks.append(Block(tag, _kind(m[3], tag), block))
            block = len(page.blocks) - 1
        elif tag in _SILENT:
            flush()
            silent += 1
        elif tag == "a":
            links += 1
        stack.append((tag, block))
    add(source[at:])
    close(1)
    flush()
    return page


def _traits(block: Block) -> tuple[tuple[str, str], tuple[str, str], tuple[str, str]]:
    """What the block potential looks at: tag, kind, and length with link share."""
    length = 0 if block.chars == 0 else 1 if block.chars < 30 else 2 if block.chars < 120 else 3
    linked = 0 if not block.chars or block.linked * 3 < block.chars else 1
    # What an unsure name means depends on what is around the block, so it is left to the steps.
    return ("tag", block.tag), ("kind", "" if block.kind in _MAYBE else block.kind), ("shape", f"{length}{linked}")


#: Labels of blocks: no article text, nor anything inside; article text; or a frame that may hold either.
ASIDE, CONTENT, FRAME = 0, 1, 2
_LABELS = (ASIDE, CONTENT, FRAME)
_SEEN = 20.0


def labels(page: Page) -> list[int] | None:
    """Labels of a page that has an article element (or, without any, main); None for other pages.

    Place decides: blocks around it are frames, other blocks outside aside, blocks inside content, whatever unsure names they bear. Inside, only
    elements that hold no article text, blocks with a sure name and what is in them are aside.
    """
    homes = {b.tag for b in page.blocks} & {"article", "main"}
    if not homes:
        return None
    home = "article" if "article" in homes else "main"
    frames: set[int] = set()
    for block in page.blocks:
        if block.tag == home:
            above = block.parent
            while above >= 0 and above not in frames:
                frames.add(above)
                above = page.blocks[above].parent
    out: list[int] = []
    for i, block in enumerate(page.blocks):
        above = out[block.parent] if block.parent >= 0 else FRAME
        if i in frames:
            out.append(FRAME)
        elif above == ASIDE or block.tag in _OUTSIDE or block.tag in _FORMS or block.kind in _AGAINST:
            out.append(ASIDE)
        elif above == CONTENT or block.tag == home:
            out.append(CONTENT)
        else:
            out.append(ASIDE)
    return out


@dataclass
class TreeModel:
    """Counts behind the potentials: of traits by label, and of a child's label by the parent's label and the child's tag and kind."""

    counts: dict[tuple, float]

    @staticmethod
    def prior() -> dict[tuple, float]:
        """Counts to start from, so that rare or unseen elements behave as their names say."""
        out: dict[tuple, float] = {}
        for tag in sorted(_OUTSIDE):
            out["trait", ASIDE, "tag", tag] = 1e12
        for kind in sorted(_AGAINST):
            out["trait", ASIDE, "kind", kind] = 1e12
        for tag in ("root", "html", "body"):
            out["trait", FRAME, "tag", tag] = 1e6
        for tag in ("article", "main"):
            out["trait", CONTENT, "tag", tag] = 1e4
        for tag in ("h1", "h2", "h3", "h4", "p", "blockquote", "li", "pre", "td", "th", "figcaption", "dd", "dt"):
            out["trait", CONTENT, "tag", tag] = 40.0
            out["trait", ASIDE, "tag", tag] = 10.0
        for tag in ("div", "section", "ul", "ol", "dl", "table", "tbody", "thead", "tr", "figure", "header"):
            for label in _LABELS:
                out["trait", label, "tag", tag] = 40.0
        for label in _LABELS:
            out["trait", label, "kind", ""] = 40.0
        out["trait", CONTENT, "kind", "content"] = 20.0
        out["trait", FRAME, "kind", "content"] = 5.0
        out["trait", ASIDE, "kind", "header"] = out["trait", FRAME, "kind", "header"] = 10.0
        for shape, aside, content in (("00", 5, 5), ("10", 10, 10), ("20", 10, 20), ("30", 5, 30), ("11", 20, 1), ("21", 20, 1), ("31", 20, 1)):
            out["trait", ASIDE, "shape", shape], out["trait", CONTENT, "shape", shape] = float(aside), float(content)
        out["trait", FRAME, "shape", "00"], out["trait", FRAME, "shape", "10"] = 40.0, 1.0
        # An unsure name outside the article, or a form, is aside unless much text speaks against it; inside, the block's own text decides.
        for kind in sorted(_MAYBE):
            out["step", FRAME, ASIDE, "", kind] = 1e6
            out["step", CONTENT, ASIDE, "", kind] = 1.0
        for tag in sorted(_FORMS):
            out["step", FRAME, ASIDE, tag, "*"] = 1e3
            out["step", CONTENT, ASIDE, tag, "*"] = 1e6
        steps = {ASIDE: (1e9, 0.001, 0.001), CONTENT: (0.2, 50.0, 0.001), FRAME: (2.0, 1.0, 2.0)}
        for above, amounts in steps.items():
            for label in _LABELS:
                out["step", above, label, "", ""] = amounts[label]
        out["step", FRAME, ASIDE, "header", ""] = out["step", FRAME, ASIDE, "header", "header"] = 40.0
        return out

    @staticmethod
    def prior_with(learned: dict[tuple, float]) -> TreeModel:
        """The prior plus learned counts. Steps of blocks with an unsure name, or of forms, count in full, so that labelled pages teach what
        such names mean inside an article and outside. A trait's value, and a step of other blocks, has a weight of at most ``_SEEN`` blocks
        against the prior: the pages that label themselves are no fair sample, so what they never show must not become impossible."""
        totals: Counter = Counter()
        for key, n in learned.items():
            totals[key[0], key[1] if key[0] == "step" else None, key[-2:]] += n
        counts = TreeModel.prior()
        for key, n in learned.items():
            total = totals[key[0], key[1] if key[0] == "step" else None, key[-2:]]
            full = key[0] == "step" and (key[-1] in _MAYBE or key[-2] in _FORMS)
            counts[key] = counts.get(key, 0) + (n if full else n * _SEEN / (total + _SEEN))
        return TreeModel(counts)

    def add(self, page: Page, truth: Sequence[int]) -> None:
        for i, block in enumerate(page.blocks):
            named = block.tag in _OUTSIDE or block.kind in _AGAINST  # decided by name, whatever else they look like
            for name, value in () if named else _traits(block):
                self.counts["trait", truth[i], name, value] = self.counts.get(("trait", truth[i], name, value), 0) + 1
            if block.parent >= 0:
                key = ("step", truth[block.parent], truth[i], block.tag, block.kind)
                self.counts[key] = self.counts.get(key, 0) + 1


def _scaled(values: tuple[float, float, float]) -> tuple[float, float, float]:
    total = values[0] + values[1] + values[2]
    return values[0] / total, values[1] / total, values[2] / total


class Potentials:
    """Block and parent-child potentials of a model, worked out once for each sort of block."""

    def __init__(self, model: TreeModel):
        self.counts = model.counts
        self._blocks: dict[tuple, tuple[float, float, float]] = {}
        self._steps: dict[tuple, tuple] = {}

    def block(self, block: Block) -> tuple[float, float, float]:
        traits = _traits(block)
        if traits not in self._blocks:
            score = [1.0, 1.0, 1.0]
            for name, value in traits:
                seen = _scaled(tuple(self.counts.get(("trait", label, name, value), 0) + 1 for label in _LABELS))
                score = [x * y for x, y in zip(score, seen)]
            self._blocks[traits] = _scaled(tuple(score))
        return self._blocks[traits]

    def step(self, block: Block) -> tuple:
        """For each label of the parent, the probabilities of the child's labels."""
        key = (block.tag, block.kind)
        if key not in self._steps:
            names = [key] + [("", block.kind)] * (block.kind in _MAYBE) + [(block.tag, "*")] * (block.tag in _FORMS)
            self._steps[key] = tuple(
                _scaled(tuple(sum(self.counts.get(("step", above, label, *name), 0) for name in names) +
                              self.counts.get(("step", above, label, "", ""), 0.5) for label in _LABELS)) for above in _LABELS)
        return self._steps[key]


def marginals(page: Page, potentials: Potentials) -> list[float]:
    """P(content) of each block: messages from the leaves to the root, then back."""
    blocks = page.blocks
    inward = [potentials.block(b) for b in blocks]
    up: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * len(blocks)
    for i in range(len(blocks) - 1, 0, -1):  # parents precede their children
        x, y, z = inward[i]
        up[i] = _scaled(tuple(a * x + b * y + c * z for a, b, c in potentials.step(blocks[i])))
        above = inward[blocks[i].parent]
        inward[blocks[i].parent] = _scaled((above[0] * up[i][0], above[1] * up[i][1], above[2] * up[i][2]))
    belief = inward[:1] + [(0.0, 0.0, 0.0)] * (len(blocks) - 1)
    for i in range(1, len(blocks)):
        above = belief[blocks[i].parent]
        p, q, r = (above[k] / max(up[i][k], 1e-300) for k in _LABELS)
        rows = potentials.step(blocks[i])
        belief[i] = _scaled(tuple(inward[i][k] * (p * rows[0][k] + q * rows[1][k] + r * rows[2][k]) for k in _LABELS))
    return [b[CONTENT] for b in belief]


def main_text(source: str, potentials: Potentials, threshold: float) -> tuple[str, int, int]:
    """The page's content, its number of blocks, and how many of them have content."""
    page = parse(source)
    chance = marginals(page, potentials)
    found = [" ".join(text.split()) for block, text in page.parts if chance[block] >= threshold]
    return " ".join(f for f in found if f), len(page.blocks), len({block for block, _ in page.parts if chance[block] >= threshold})


def fit_pages(pages: DataFrame, rule: PageRule = PageRule()) -> TreeModel:
    """Count potentials over at most ``rule.labelled`` pages that have an article or main element. Without any, the prior counts remain.

    Tasks count their own pages; the counts are summed per key before they reach the driver. Keys are made of element names and
    the kinds above; element names outside the block list do not occur, so their number is fixed.
    """
    own = pages.select(F.xxhash64(F.lit(rule.seed), "page_id").alias("_key"), whole("html").alias("html")).filter(
        F.lower("html").rlike("<(article|main)[\\s>]"))
    # Only keys are ranked; at most rule.labelled of them, so they may be broadcast.
    keys = own.select("_key").distinct().orderBy("_key").limit(rule.labelled)
    chosen = own.join(F.broadcast(keys), "_key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = TreeModel({})
        for batch in batches:
            for source in batch.column("html"):
                page = parse(source.as_py())
                truth = labels(page)
                if truth is not None:
                    model.add(page, truth)
        keys = [[str(x) for x in key] for key in model.counts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.list_(pa.string())), pa.array(list(model.counts.values()), pa.float64())], ["key", "n"])

    counted = chosen.select("html").mapInArrow(run, "key array<string>, n double").groupBy("key").agg(F.sum("n").alias("n"))
    learned: dict[tuple, float] = {}
    for row in counted.collect():
        what, *rest = row["key"]
        key = (what, int(rest[0]), *rest[1:]) if what == "trait" else (what, int(rest[0]), int(rest[1]), *rest[2:])
        learned[key] = row["n"]
    return TreeModel.prior_with(learned)


def extract_pages(pages: DataFrame, model: TreeModel, rule: PageRule = PageRule(), carry: Sequence[str] | None = None) -> DataFrame:
    """``pages`` with text, n_chars, n_blocks, n_content_blocks; one row in, one row out, whole pages.

    Every block element is a node; a node's label says whether the text directly in it is content. Block potentials weigh element
    name, class words, length and link share; parent-child potentials tie a block to the one around it. The marginals
    of both, exact on a tree, decide. Elements such as nav and aside, and names such as comments or sidebar, are never content;
    other names (widget, related, notice, ...) and forms weigh by what is around and inside them. Scripts, styles and the like have no text. Character references are decoded, white space inside a
    block becomes one space, blocks are joined by one space in page order. A null or empty page gives the empty text. Input
    columns named like results are replaced; ``carry`` names the input columns returned (all).
    """
    added = ["text", "n_chars", "n_blocks", "n_content_blocks"]
    pages = without(pages, *added)
    carry = pages.columns if carry is None else list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        potentials = Potentials(model)
        for batch in pieces(batches, "html"):
            found = [main_text(x.as_py() or "", potentials, rule.threshold) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in carry], pa.array([t for t, _, _ in found], pa.string()),
                pa.array([len(t) for t, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()),
                pa.array([n for _, _, n in found], pa.int64()),
            ], [*carry, *added])

    schema = StructType([pages.schema[c] for c in carry])
    for c in added:
        schema = schema.add(c, "string" if c == "text" else "long")
    return pages.mapInArrow(run, schema)
