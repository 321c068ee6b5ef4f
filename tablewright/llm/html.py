"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is read once, from front to end and in linear time, into a flat list of text blocks (runs of
text between block-level tags). Each block is described by its words and link density, by those of
the blocks before and after it, and by which kind of container is nearest. A CART tree, grown
on the labelled blocks of ``labelled_pages`` below, says which blocks are main text. Half of these
pages have no telling names at all (only div, p, ul and headings), so the tree learns to go by
words and links where containers say nothing.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import map_rows

#: A tag; quotes count only after "=". Every part is possessive, so a try never goes back.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)>""")
#: The same for what is left of a page whose quotes never end.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>")
OPENS = re.compile(r"</?[a-zA-Z]")
COMMENT_END = re.compile(r"--!?>")
#: Elements by how HTML treats them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style title textarea noscript template iframe noframes xmp svg math object select".split())
CONTAINERS = frozenset("article aside blockquote body center dd details dialog div dl fieldset figure footer form header html label li main menu nav ol section span table td th tr tbody ul".split())
PARAGRAPHS = frozenset("p pre blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What containers beside the main text are called.
BESIDE_TAGS = frozenset("nav aside footer form menu dialog button search label fieldset".split())
BESIDE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation navs menu menus breadcrumb breadcrumbs sidebar sidebars footer footers masthead topbar cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments disqus pagination pager toolbar widget widgets paywall".split())
#: Names that say so only where nothing but a part's name follows ("more-links", but not "more-info").
VAGUE_NAMES = frozenset("side rail foot head header notice notices alert alerts reply replies respond discussion feedback related recommended recommendations more share sharing social tags skip search copyright legal disclaimer".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_NAMES = frozenset("article main post entry story".split())
#: Names of parts: main text by themselves, else part of what the words before them say.
PART_NAMES = frozenset("content contents text body copy".split())
FRAME_NAMES = frozenset("list item items inner outer wrapper wrap container box block area section region panel group row column col bar links link button buttons posts articles stories meta info".split()) - {"info"}
#: Words that make a name tell how a container looks or works, not what it holds.
LOOK_NAMES = frozenset("has no not non with without is enable enabled disable disabled show hide open closed active js layout grid width wide left right page theme template mode type format style single".split())
ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

FEATURES = ("nearest", "main_around", "heading", "paragraph", "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    nearest: int = 0  # what the nearest telling container says, see kind_of
    main_around: int = 0
    heading: int = 0
    paragraph: int = 0
    keep: bool = False
    begun: bool = False

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


@dataclass(frozen=True)
class Around:
    """An open container and what it passes on to those inside it."""

    tag: str = ""
    kind: int = 0  # its own, or that of the nearest telling one around
    main: bool = False
    paragraph: bool = False
    keep: bool = False


def named(token: str) -> int:
    """1, -1 or 0: what one class or id says. Its last word weighs most: an "article-footer" is a footer, a "legal-article"
    an article and "side-effects" neither."""
    words = [x.lower() for x in NAME.findall(token)]
    if not words or LOOK_NAMES.intersection(words):
        return 0
    part = False
    for k, word in enumerate(reversed(words)):
        if word in BESIDE_NAMES or word in VAGUE_NAMES:
            return -1
        if word in MAIN_NAMES:
            return 1
        if word in PART_NAMES:
            part = True
        elif word not in FRAME_NAMES:
            # something else, as in "breadcrumb-trail": only plain words before it still count
            rest = words[: len(words) - k - 1]
            return -1 if BESIDE_NAMES.intersection(rest) else 1 if part and k == len(words) - 1 else 0
    return int(part)


def kind_of(tag: str, attributes: str, inside_main: bool) -> int:
    """What a container says about the text in it: 2 and -2 by its tag or role (main text or beside it), 1 and -1 by
    its names, 0 nothing; names that contradict each other say nothing."""
    if tag in BESIDE_TAGS or (tag == "header" and not inside_main):
        return -2
    said: set[int] = set()
    if attributes:
        for name, value in ATTR.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                said.update(named(x) for x in value.split())
            elif (name == "role" and value.lower() in BESIDE_ROLES) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return -2
            elif (name == "role" and value.lower() == "main") or (name == "itemprop" and value.lower() == "articlebody"):
                return 2
    if tag in MAIN_TAGS:
        return 2
    if -1 in said and 1 not in said and tag not in ("body", "html"):
        return -1
    if 1 in said and -1 not in said and tag in ("div", "section", "td"):
        return 1
    return 0


def raw_end(tag: str, page: str, at: int) -> tuple[int, int]:
    """Where the end tag of an element without markup begins and where the page goes on; -1 without one."""
    m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
    if not m:
        return -1, len(page)
    return m.start(), page.find(">", m.end()) + 1 or len(page)


SMALL = frozenset(("span", "p", "label"))


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; scripts, styles, comments and unfinished tags give no text."""
    out: list[Block] = []
    stack: list[Around] = [Around()]
    open_tags: Counter = Counter()
    now, link, heading = Block(), 0, 0

    def close() -> None:
        nonlocal now
        if now.begun:
            out.append(now)
        now = Block()

    def say(raw: str) -> None:
        text = entities.unescape(raw)
        if not now.begun:
            top = stack[-1]
            now.nearest, now.main_around, now.paragraph, now.keep = top.kind, int(top.main), int(top.paragraph), top.keep
            now.heading = int(heading > 0)
            now.begun = bool(text) and not text.isspace()
        now.parts.append(text)
        if link:
            now.linked.append(text)

    def leave(tag: str) -> None:
        if not open_tags[tag]:
            return
        i = len(stack) - 1
        while stack[i].tag != tag:
            if tag in SMALL and stack[i].tag not in SMALL:
                return  # a stray end of something small doesn't close what is around it
            i -= 1
        open_tags.subtract(x.tag for x in stack[i:])
        del stack[i:]

    def drop_top() -> None:
        open_tags[stack.pop().tag] -= 1

    at = start = 0  # what is looked at next; where text that isn't said yet begins
    quotes = True
    while (at := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), at) or (page.startswith("</", at) and not OPENS.match(page, at)):
            if page.startswith("<!--", at):
                m = COMMENT_END.search(page, at + 2)
                end = m.end() if m else len(page)
            else:
                end = page.find(">", at) + 1 or len(page)
            if at > start:
                say(page[start:at])
            at = start = end
            continue
        if not OPENS.match(page, at):
            at += 1
            continue
        m = TAG.match(page, at) if quotes else None
        if not m:
            quotes = False
            m = PLAIN_TAG.match(page, at)
        if not m:
            end = page.find("<", at + 1)
            if end >= 0:
                at = end
                continue
            if at > start:  # cut off inside its last tag
                say(page[start:at])
            start = len(page)
            break
        if at > start:
            say(page[start:at])
        at = start = m.end()
        ends, tag, attributes = bool(m[1]), m[2].lower(), m[3]
        if tag in RAW and not ends:
            found, end = raw_end(tag, page, at)
            if not attributes.rstrip().endswith("/") or (found >= 0 and tag not in ("svg", "math")):
                at = start = end
            continue
        if tag == "a":
            link = 0 if ends else 1
        elif tag == "br":
            now.parts.append(" ")
        if tag in BLOCKS:
            close()
            link = 0 if tag != "li" and ends else link
        if tag in HEADINGS:
            heading = 0 if ends else 1
        if tag in ("td", "th") and not ends:
            now.parts.append(" ")
        if tag in CONTAINERS or tag == "p" or tag in HEADINGS or tag == "button":
            if ends:
                leave(tag)
                continue
            if tag in BLOCKS:
                while stack[-1].tag == "p" or stack[-1].tag in HEADINGS:
                    drop_top()
            if tag == "li" and stack[-1].tag == "li":
                drop_top()
            top = stack[-1]
            kind = kind_of(tag, attributes, top.main)
            paragraph = tag in PARAGRAPHS if tag in BLOCKS else top.paragraph
            stack.append(Around(tag, kind or top.kind, top.main or kind > 0, paragraph, top.keep or "data-keep" in attributes))
            open_tags[tag] += 1
    if start < len(page):
        say(page[start:])
    close()
    return out


def describe(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; before the first and after the last stand zeros."""
    n = len(blocks)
    words = np.array([len(b.text.split()) for b in blocks], float)
    linked = np.array([len(" ".join(b.linked).split()) for b in blocks], float)
    density = np.minimum(1, linked / np.maximum(1, words))
    x = np.zeros((n, len(FEATURES)))
    x[:, 0] = [b.nearest for b in blocks]
    x[:, 1] = [b.main_around for b in blocks]
    x[:, 2] = [b.heading for b in blocks]
    x[:, 3] = [b.paragraph for b in blocks]
    x[:, 4], x[:, 5] = words, density
    x[1:, 6], x[1:, 7] = words[:-1], density[:-1]
    x[:-1, 8], x[:-1, 9] = words[1:], density[1:]
    return x


#: Only the numbers of words and links of labelled pages matter, not the words.
_W = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def _words(n: int, at: int = 0) -> str:
    return " ".join(_W[(at + i) % len(_W)] for i in range(n))


def _article(r: random.Random, named: bool) -> str:
    """Blocks of main text of many sizes, marked: a heading, then paragraphs, quotes, lists, tables, bare lines;
    where containers have names also text that is nothing but links."""
    n = lambda *sizes: _words(r.choice(sizes), r.randrange(24))
    out = [f"<h1 data-keep>{n(1, 3, 5, 9, 14)}</h1>"] * (r.random() < 0.9)
    for _ in range(r.choice((1, 1, 2, 4, 7, 12))):
        kind = r.random() * (1.2 if named else 1)
        text = n(1, 2, 3, 5, 8, 12, 20, 35, 60, 90, 150)
        if kind < 0.6:
            out.append(f"<p data-keep>{text}.</p>")
        elif kind < 0.68:
            out.append(f"<p data-keep>{n(9, 14, 30)} <a href=/y>{n(1, 2, 3)}</a> {n(4, 9, 20)}</p>")
        elif kind < 0.72:
            out.append(f"<blockquote data-keep>{text}</blockquote>")
        elif kind < 0.8:
            out.append(f"<h2 data-keep>{n(1, 3, 6)}</h2><p data-keep>{text}</p>")
        elif kind < 0.9:
            out.append("<ul>" + "".join(f"<li data-keep>{n(1, 2, 6, 13)}</li>" for _ in range(r.randrange(1, 5))) + "</ul>")
        elif kind < 0.95:
            out.append(f"<table><tr><td data-keep>{n(1, 2)}</td><td data-keep>{n(1, 4)}</td></tr></table>")
        elif kind < 1:
            out.append(f"<div data-keep>{text}</div>")
        elif kind < 1.1:
            out.append(f"<p data-keep><a href=/y>{text}</a> {n(1, 3)}</p>")
        else:
            out.append("<ul>" + "".join(f"<li data-keep><a href=/y>{n(1, 4, 9)}</a></li>" for _ in range(r.randrange(1, 5))) + "</ul>")
    return "".join(out)


#: Names as they occur on pages, written down for the labelled table and not made from the lists above.
TELLING = ("post-body share-enabled", "content has-sidebar", "entry more-info", "legal-article", "td-post-content", "story_main no-comments", "articleText hentry", "contentBody")
NO_TELLING = ("side-effects", "content related", "newsletter article-wrap", "tags-and-topics", "header-less", "feedback-loop", "search-history", "box story subscribe", "node node-page", "l-col-8 prose", "wp-block-group", "richtext")


def labelled_pages(pages: int = 240, seed: int = 11) -> list[str]:
    """The labelled table: pages by a rule, in which data-keep marks the elements that hold main text.
    Every second page is unnamed, and has only such text beside the main text as words and links can tell."""
    r, out = random.Random(seed), []
    n = lambda *sizes: _words(r.choice(sizes), r.randrange(24))
    for k in range(pages):
        items = [f"<li><a href=/x>{n(1, 1, 2, 4)}</a></li>" for _ in range(r.randrange(3, 9))]
        nav = r.choice(("<nav><ul>{}</ul></nav>", "<div class=menu><ul>{}</ul></div>", "<nav>{}</nav>")).format("".join(items))
        foot = r.choice(("<footer>{}</footer>", "<div id=footer>{}</div>")).format(f"&copy; {n(1, 4, 8, 13)}")
        links = "<ul>" + "".join(f"<li><a href=/x>{n(3, 5, 8)}</a></li>" for _ in range(5)) + "</ul>"
        article = _article(r, k % 2 == 0)
        if k % 2:
            short = f"<div>{n(5, 8, 12)}.</div>" if r.random() < 0.6 else ""
            page = unnamed(nav + short + f"<article>{article}</article>" + links * (r.random() < 0.3) + foot * (r.random() < 0.8))
            if r.random() < 0.5:  # a name that says nothing about what the container holds, or two that contradict each other
                page = page.replace(unnamed(article), f'<div class="{r.choice(NO_TELLING)}">{unnamed(article)}</div>')
            out.append(page)
            continue
        ad = r.choice(("<div class=ad>{}.</div>", "<aside>{}</aside>", "<div class='sponsored box'><p>{}</p></div>")).format(n(4, 8, 20, 45))
        notice = f"<div class=cookie-notice><p>{n(12, 30)}</p><button>{n(1, 2)}</button></div>" * (r.random() < 0.3)
        header = f"<header><a href=/>{n(1, 2)}</a> {n(2, 5)}</header>" * (r.random() < 0.3)
        side = f"<aside><h2>{n(1, 2)}</h2>{links}<p>{n(10, 30)}</p></aside>" * (r.random() < 0.3)
        form = f"<form><label>{n(1, 2)}</label><p>{n(5, 12)}</p><button>{n(1)}</button></form>" * (r.random() < 0.3)
        remarks = f"<section class=comments><h3>{n(1, 2)}</h3><p>{n(5, 30, 60)}</p><p>{n(1, 4, 12)}</p></section>" * (r.random() < 0.4)
        main = r.choice(("<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<main><article>{}</article></main>", '<div class="{}">{{}}</div>'.format(r.choice(TELLING))))
        inside = article + (ad if r.random() < 0.2 else "") + (remarks if r.random() < 0.5 else "")
        out.append(notice + header + nav + ad * (r.random() < 0.7) + main.format(inside) + side + remarks + form + foot * (r.random() < 0.7))
    return out


def unnamed(page: str) -> str:
    """The page with div in place of telling elements, without classes, ids and roles."""
    page = re.sub(r"<(/?)(?:nav|article|aside|main|header|footer|section|form|label)\b", r"<\1div", page)
    return re.sub(r"""\s(?:class|id|role|itemprop)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", page)


@dataclass
class Tree:
    """CART on the Gini impurity."""

    nodes: list[tuple] = field(default_factory=list)  # feature or -1, limit, left, right, keep

    def fit(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 6) -> Tree:
        self.nodes = []
        self._grow(x, y, depth, least)
        return self

    def _grow(self, x, y, depth, least) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, bool(2 * y.sum() >= len(y))))
        best = None
        if depth and 0 < y.sum() < len(y):
            for k in range(x.shape[1]):
                values = np.unique(x[:, k])
                for limit in (values[:-1] + values[1:]) / 2:
                    left = x[:, k] <= limit
                    n = int(left.sum())
                    if least <= n <= len(y) - least:
                        a, b = y[left].mean(), y[~left].mean()
                        impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                        if best is None or impurity < best[0] - 1e-9:
                            best = (impurity, k, float(limit), left)
        if best is not None:
            _, k, limit, left = best
            a = self._grow(x[left], y[left], depth - 1, least)
            b = self._grow(x[~left], y[~left], depth - 1, least)
            self.nodes[me] = (k, limit, a, b, self.nodes[me][4])
        return me

    def keeps(self, x: np.ndarray) -> list[bool]:
        out = []
        for row in x:
            k, limit, a, b, keep = self.nodes[0]
            while k >= 0:
                k, limit, a, b, keep = self.nodes[a if row[k] <= limit else b]
            out.append(keep)
        return out


def trained() -> Tree:
    tables = [(describe(b), [x.keep for x in b]) for b in map(blocks_of, labelled_pages())]
    return Tree().fit(np.concatenate([x for x, _ in tables]), np.array([k for _, y in tables for k in y]))


def main_text(page: str | None, tree: Tree) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    return "\n".join(b.text for b, keep in zip(blocks, tree.keeps(describe(blocks)), strict=True) if keep)


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", tree: Tree | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row. A null or empty html has no text (""); a
    null id or url stays null. Other columns are dropped, whatever their names."""
    kinds = dict(df.dtypes)
    tree = tree or trained()

    def make():
        def work(columns):
            texts = [main_text(h, tree) for h in columns[2]]
            return [columns[0], columns[1], texts, list(map(len, texts))]

        return work

    return map_rows(df.select(F.col(page_id), F.col(url), F.col(html)), f"`{page_id}` {kinds[page_id]}, `{url}` {kinds[url]}, text string, n_chars bigint", make)
