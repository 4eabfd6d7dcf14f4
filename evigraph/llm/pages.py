"""Main text of web pages: flat text blocks, their word counts and link densities and those of their neighbours, and a decision
tree trained on a small labelled table."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)(?:>|\Z)""", re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in "script style textarea title xmp iframe noembed noframes noscript".split()}
UNSEEN = set("template svg math select object canvas audio video datalist button".split())
BLOCKS = UNSEEN - {"math", "svg", "canvas", "audio", "video", "object"} | set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {f"h{k}" for k in range(1, 7)}
NEVER_OPEN = {"html", "head", "body", "hr"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
ASIDE_TAGS = set("nav footer aside form menu dialog fieldset".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets related recommended share sharing "
    "social comment comments commentlist disqus respond reply replies breadcrumb breadcrumbs menu menus nav navbar navigation footer masthead "
    "topbar pagination pager toolbar skip copyright legal disclaimer teaser teasers search".split()
)
ASIDE_ARTICLES = set("comment comments reply teaser related ad advert promo sponsored".split())
MODIFIERS = set("has with no without is not hide show open close above below after before".split())
TEXT_NAMES = set("article content entry post story main body text page".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "heading", "article", "named", "aside")


@dataclass(frozen=True)
class Place:
    """An open element: what it and its ancestors say about the text inside."""

    tag: str
    aside: bool = False
    article: bool = False
    named: bool = False
    unseen: bool = False


@dataclass
class Block:
    text: str
    words: int
    links: float
    heading: bool
    place: Place


def _names(value: str) -> Iterator[str]:
    """The parts of class and id words that are not negated or qualified by the part before (`no-sidebar`)."""
    for word in value.split():
        parts = re.findall(r"[a-z]+|[0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower())
        yield from (part for k, part in enumerate(parts) if k == 0 or parts[k - 1] not in MODIFIERS)


def _enter(tag: str, attributes: str, around: Place) -> Place:
    aside = tag in ASIDE_TAGS or (tag == "header" and not around.article)
    article, named, unseen = tag in ("article", "main"), False, tag in UNSEEN
    if attributes.strip(" /\n"):
        own = {k.lower(): html.unescape(a or b or c) for k, a, b, c in reversed(ATTRIBUTE.findall(attributes))}
        role, names = own.get("role", "").lower(), f"{own.get('class', '')} {own.get('id', '')}"
        article |= role in ("main", "article") or own.get("itemprop") == "articleBody"
        unseen |= "hidden" in own or own.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(own.get("style", "")))
        aside |= role in ASIDE_ROLES or own.get("itemprop") == "comment"
        if article:
            aside |= bool(ASIDE_ARTICLES & set(names.lower().split()))
        elif tag not in HEADINGS:
            parts = set(_names(names))
            aside |= bool(ASIDE_NAMES & parts) or ("header" in parts and not around.article and not around.named)
            named = bool(TEXT_NAMES & parts) and not aside
    if tag == "main":
        return Place(tag, aside, True, named, unseen or around.unseen)
    return Place(tag, aside or around.aside, article or around.article, named or around.named, unseen or around.unseen)


def blocks(page: str) -> list[Block]:
    """The text between block tags, in page order, white space as one blank and references decoded; blank ones are left out.

    Scripts, styles, comments and unseen elements have no text. Tags may be unclosed or closed in any order; a `<` that starts no
    tag is text. The work is linear in the page.
    """
    found: list[Block] = []
    stack, opened = [Place("")], Counter()
    pieces: list[str] = []
    linked: list[str] = []
    link, heading, at = False, False, 0

    def text(start: int, end: int) -> None:
        if start < end and not stack[-1].unseen:
            piece = page[start:end]
            pieces.append(html.unescape(piece) if "&" in piece else piece)
            if link:
                linked.append(pieces[-1])

    def cut() -> None:
        if pieces:
            body = " ".join("".join(pieces).split())
            if body:
                words = max(body.count(" ") + 1, len(body) // 10)
                inside = " ".join("".join(linked).split())
                share = min(1.0, len(inside) / len(body))
                found.append(Block(body, words, share, heading, stack[-1]))
            pieces.clear()
            linked.clear()

    def leave() -> None:
        opened[stack.pop().tag] -= 1

    while (lt := page.find("<", at)) >= 0:
        text(at, lt)
        tag = MARKUP.match(page, lt)
        if tag is None:
            text(lt, lt + 1)
            at = lt + 1
            continue
        at, name = tag.end(), (tag[2] or "").lower()
        if not name:
            continue
        if name in RAW and not tag[1]:
            end = RAW[name].search(page, at)
            at = end.end() if end else len(page)
        elif name == "a":
            link = not tag[1]
        elif name == "br":
            pieces.append(" ")
            if link:
                linked.append(" ")
        elif name in BLOCKS or name in UNSEEN:
            if name in BLOCKS:
                cut()
                heading = name in HEADINGS and not tag[1]
            if name in NEVER_OPEN:
                continue
            if tag[1]:
                if opened[name]:
                    while stack[-1].tag != name:
                        leave()
                    leave()
                    if name in ASIDE_TAGS or name in ("article", "main"):
                        link = False
                continue
            if stack[-1].tag == "p" and name in BLOCKS:
                leave()
            while stack[-1].tag in CLOSES.get(name, ()):
                leave()
            if not tag[3].endswith("/") or name in BLOCKS:
                stack.append(_enter(name, tag[3], stack[-1]))
                opened[name] += 1
    text(at, len(page))
    cut()
    return found


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """A row of FEATURES for each block; article is 1 inside one, -1 outside on a page that has one, 0 on other pages."""
    edge = (0.0, 0.0)
    sizes = [edge, *((float(b.words), b.links) for b in found), edge]
    outside = -float(any(b.place.article and not b.place.aside for b in found))
    return [
        (*sizes[k + 1], *sizes[k], *sizes[k + 2], float(b.heading), 1.0 if b.place.article else outside, float(b.place.named), float(b.place.aside))
        for k, b in enumerate(found)
    ]


# The labelled table, a page a row: +n stands for n words of main text, -n for n words that are not. Written for this module.
LABELLED = (
    "<header><h2>-3</h2><nav><ul><li><a>-1</a><li><a>-2</a></ul></nav></header><article><h1>+6</h1><p>+60<p>+3<p>+25<p>+1</article><footer>-14</footer>",
    "<nav><a>-1</a> <a>-1</a></nav><div class=ad>-9</div><article><h1>+9</h1><p>+1<p><b>+80</b></article><div class=ad>-30</div><footer>-25</footer>",
    "<div>-40</div><main><h1>+5</h1><p>+45</p><ul><li>+7<li>+4</ul><p><a>+3</a></p><aside>-25</aside><p>+70</main><div>-20</div><p>-60</p>",
    "<article><header><h1>+8</h1><p>+4</p></header><p>+33<section id=comments><h3>-2</h3><p>-45<p>-12</section></article><div>-16</div>",
    "<article><p>+2</article><section class=comments><article class=comment><p>-60</article></section><form>-8</form><p>-1</p>",
    "<div class=notice>-35</div><div id=content><h1>+5</h1><p>+50<p>+8<p>+30<div class=share><a>-2</a></div><p>+12</div><div class=sidebar><p>-40</div>",
    "<div class=top><a>-2</a> <a>-1</a></div><div class=post><h2>+4</h2><p>+70<p>+5<p>+40</div><div class=x><a>-3</a> <a>-4</a></div><div>-6</div>",
    "<article><p><a>+4</a><p>+3<p><a>+9</a><p>+2<ul><li><a>+1</a><li><a>+3</a></ul><p>+12<p><a>+2</a></article><p>-12<p><a>-3</a><p>-70",
    "<div><a>-3</a></div><p>-8<article><p>+2<p><a>+5</a><p>+30<p><a>+7</a></article><a>-4</a><p>-9",
    "<article><p>+20<p><a>+4</a><p>+3</article>", "<article><p><a>+3</a></article>", "<article><p><a>+1</a><p>+50<p><a>+1</a></article><nav>-2</nav>",
    "<article><p><a>+1</a><p>+9</article>", "<nav><a>-2</a></nav><article><p>+2</article><nav><a>-3</a></nav>", "<article><h2><a>+6</a></h2><p>+1</article>",
    "<table><tr><td><a>-1</a><td><a>-2</a></table><p>+55<p>+90<p>+18<p>+35<table><tr><td><a>-2</a><td><a>-3</a></table><p>-6",
    "<a>-2</a><hr><h1>+3</h1><p>+40<p>+22<p>+3<p>+60<hr><a>-1</a>",
    "<p>+30<p>+12<p>+26", "+45", "<h1>+4</h1><p>+20", "<div><div>+120</div></div>",
    "<div><a>-2</a></div><div><a>-3</a></div><div>-3</div><div><a>-5</a></div>",
    "<div class=login><form>-5</form></div><div><a>-1</a></div><div>-2</div><div><a>-2</a></div><div class=footer>-30</div>",
    "<div>-2</div><div><a>-9</a></div><h2>+5</h2><div>+65</div><div>+14</div><div>+48</div><div><a>-6</a></div><div>-4</div>",
)


@dataclass(frozen=True)
class Node:
    """A test `row[feature] <= threshold` with a node for either answer, or a leaf with its label."""

    label: bool
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def says(self, row: tuple[float, ...]) -> bool:
        node = self
        while node.low is not None:
            node = node.low if row[node.feature] <= node.threshold else node.high
        return node.label


def grow(rows: list[tuple[float, ...]], labels: list[bool], depth: int = 8) -> Node:
    """A binary tree by least Gini impurity; equal splits: the first feature and the smallest threshold."""
    yes = sum(labels)
    if depth == 0 or yes in (0, len(labels)):
        return Node(2 * yes > len(labels))
    best = (len(labels) * 1.0, -1, 0.0)
    for feature in range(len(rows[0])):
        order = sorted(range(len(rows)), key=lambda k: rows[k][feature])
        low_yes = 0
        for n, k in enumerate(order[:-1], 1):
            low_yes += labels[k]
            here, there = rows[k][feature], rows[order[n]][feature]
            if here < there:
                m, high_yes = len(rows) - n, yes - low_yes
                impurity = low_yes * (n - low_yes) / n + high_yes * (m - high_yes) / m
                if impurity < best[0] - 1e-12:
                    best = (impurity, feature, (here + there) / 2)
    if best[1] < 0:
        return Node(2 * yes > len(labels))
    low = [k for k, row in enumerate(rows) if row[best[1]] <= best[2]]
    high = [k for k, row in enumerate(rows) if row[best[1]] > best[2]]
    return Node(
        2 * yes > len(labels), best[1], best[2],
        grow([rows[k] for k in low], [labels[k] for k in low], depth - 1), grow([rows[k] for k in high], [labels[k] for k in high], depth - 1),
    )


def labelled_rows(pages: tuple[str, ...] = LABELLED, scales: tuple[float, ...] = (1, 0.6, 1.7, 1.3, 0.8)) -> tuple[list[tuple[float, ...]], list[bool]]:
    """The feature rows of labelled pages, each page at several text sizes, and whether each row is main text."""
    rows, labels = [], []
    for scale in scales:
        for page in pages:
            filled = re.sub(r"([+-])(\d+)", lambda m: " ".join(["wordy" if m[1] == "+" else "other"] * max(1, round(int(m[2]) * scale))), page)  # noqa: B023
            found = blocks(filled)
            rows += features(found)
            labels += [b.text.startswith("wordy") for b in found]
    return rows, labels


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(*labelled_rows())


def main_text(page: str | None) -> str:
    """The blocks that the tree takes for main text, joined by an empty line; empty if there is none."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, row in zip(found, features(found), strict=True) if tree().says(row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row, repeated rows included; a null or empty page gives an empty text.

    Ids and urls may be null; other columns are left behind. A page is read in one pass whatever its length.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64()),
            ], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")
