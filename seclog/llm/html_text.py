"""Main text of web pages by composite text density.

Every element gets its characters per tag, adjusted by how much of it is link text. The element
whose children have the largest sum of densities is the core; the least density on its path to
the body is the threshold. From the body down, elements at or above the threshold hand over
to their own densest subtree, and article elements among them are taken whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from seclog.llm.common import add_results

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without article text.
DROPPED = frozenset(
    "script style noscript template svg math iframe object embed canvas audio video map head title "
    "nav aside footer form button select textarea input menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu "
                  "menubar toolbar".split())
#: Words of a class or id that mark something beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs masthead header footer comment comments reply replies respond "
    "disqus discussion share sharing social related recommended newsletter subscribe subscription "
    "signup login widget toolbar pagination pager paywall".split())
#: Beginnings of such words in compounds, and the words that also count against an article element.
BESIDE_STARTS = ("comment", "advert", "sidebar", "cookie", "newsletter", "breadcrumb", "sponsor", "disqus")
NOT_THE_ARTICLE = frozenset("comment comments reply replies related promo ad ads sponsored teaser".split())
#: Words that a name inside the article may have besides those: "ad-box", but not "share-of-market".
LAYOUT = frozenset(
    "box block area wrap wrapper container content inner outer section list item items unit bar panel left "
    "right top bottom site page post entry link links button buttons icon icons form thread".split())
#: Elements whose names tell nothing, and those whose id is an anchor.
NAMELESS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ANCHORS = frozenset(("section", "article", "p")) | INLINE
#: Inside the article a name counts against containers with less text, or with that share of it in links; reader
#: comments are beside it at any length.
SHORT_CHARS, LINK_SHARE = 200, 0.5
COMMENT_WORDS, COMMENT_STARTS = frozenset(("replies", "respond")), ("comment", "disqus")
#: Elements that hold the article; what their class or id says mostly tells nothing.
ARTICLES = frozenset(("article", "main"))
#: What a start tag ends: the tag itself or its siblings, up to the container named second.
_CELLS = frozenset(("table",))
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), _CELLS), "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
PARAGRAPH_STOPS = frozenset("td th li div section article main aside table body html button dd".split())
#: A list or box with that share of its characters in that many links is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.8
MENU_TAGS = frozenset("ul ol div section table dl".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _is_beside(attrs: str, words: frozenset[str], starts: tuple[str, ...], ids: bool) -> tuple[bool, bool, list[str]]:
    """(hidden or a role beside the article, a class or id that says so, classes that say nothing else).

    Without ``ids`` an id is an anchor."""
    never = named = False
    whole = []
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            never |= value.strip().lower() in ROLES
        elif name == "hidden":
            never = True
        elif name == "aria-hidden":
            never |= value.lower() == "true"
        elif name == "style":
            never |= "display:none" in value.lower().replace(" ", "")
        elif name == "class" or ids:
            for own in value.split():
                found = _WORD.findall(_CAMEL.sub(" ", own).lower())
                beside = [w in words or w.startswith(starts) for w in found]
                if any(beside):
                    named = True
                    if name == "class" and all(b or w in LAYOUT for b, w in zip(beside, found)):
                        whole += found
    return never, named, whole


class Page:
    """Elements in page order, with parents before children, and runs of text between tags."""

    def __init__(self, source: str):
        self.tag, self.parent = ["body"], [-1]
        self.dropped, self.named, self.whole = [False], [False], [[]]
        self.runs: list[tuple[int, str | None]] = []  # (element, text), or None at a block's edge
        self.stack = [0]  # elements that are open
        self.places: dict[str, list[int]] = {}  # of open elements in the stack, by tag, so no tag walks over it
        self.blocks: list[int] = []  # of those that are not inline
        self._read(source)

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        never, named, whole = False, False, []
        if attrs and tag != "main":
            own = (NOT_THE_ARTICLE, BESIDE_STARTS[:1]) if tag == "article" else (BESIDE, BESIDE_STARTS)
            never, named, whole = _is_beside(attrs, *own, tag not in ANCHORS)
            if tag in NAMELESS:
                named, whole = False, []
        self.tag.append(tag)
        self.parent.append(parent)
        self.dropped.append(never or tag in DROPPED)
        self.named.append(named)
        self.whole.append(whole)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, at, end = self.stack, 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            text = source[at:m.start()] if m else source[at:]
            if text:
                self.runs.append((stack[-1], entities.unescape(text) if "&" in text else text))
            if not m:
                return
            at = m.end()
            if m["end"]:
                self._close(m["end"].lower())
            elif m["tag"]:
                tag, attrs = m["tag"].lower(), m["attrs"]
                if tag in ("html", "body"):
                    continue
                self._end_implied(tag)
                if tag not in INLINE:
                    self.runs.append((stack[-1], None))
                elif tag == "br":
                    self.runs.append((stack[-1], " "))
                own = self._open(tag, attrs, stack[-1])
                if tag in RAW:
                    closed = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
                    at = closed.start() if closed else end
                if tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "math", "path")):
                    self.places.setdefault(tag, []).append(len(stack))
                    if tag not in INLINE:
                        self.blocks.append(len(stack))
                    stack.append(own)

    def _end_implied(self, tag: str) -> None:
        if tag not in INLINE:
            self._cut(("p",), PARAGRAPH_STOPS)
        if tag in ENDS:
            self._cut(*ENDS[tag])

    def _end_from(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.tag[self.stack.pop()]].pop()
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()

    def _last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else 0

    def _cut(self, ended, stops) -> None:
        """Close the outermost of ``ended`` that is open above the nearest of ``stops``."""
        if not any(self.places.get(t) for t in ended):
            return
        stop = max((self._last(t) for t in stops if t not in ended), default=0)
        above = [p[bisect_right(p, stop)] for t in ended if (p := self.places.get(t)) and p[-1] > stop]
        if above:
            cut = min(above)
            self.runs.append((self.stack[cut], None))
            self._end_from(cut)

    def _close(self, tag: str) -> None:
        place, block = self._last(tag), self.blocks[-1] if self.blocks else 0
        if not place or (tag in INLINE and block > place):
            return  # nothing to close, or a stray end of a formatting element
        if block >= place:
            self.runs.append((self.stack[place], None))
        self._end_from(place)


def _totals(page: Page, dropped: list[bool]):
    """Characters, tags, link characters and link tags of every element, without dropped ones."""
    n = len(page.tag)
    chars, tags, link_chars, links = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for e in range(1, n):
        in_link[e] = page.tag[e] == "a" or in_link[page.parent[e]]
    for e, text in page.runs:
        if text and not dropped[e]:
            size = len("".join(text.split()))
            chars[e] += size
            if in_link[e]:
                link_chars[e] += size
    for e in range(n - 1, 0, -1):
        if not dropped[e]:
            p = page.parent[e]
            chars[p] += chars[e]
            tags[p] += tags[e] + 1
            link_chars[p] += link_chars[e]
            links[p] += links[e] + (page.tag[e] == "a")
    return chars, tags, link_chars, links


def _counts_inside(page: Page, e: int, totals) -> bool:
    """Whether the names of an element inside the article count against it."""
    if page.tag[e] in INLINE or page.tag[e] == "p":
        return False
    if any(w in COMMENT_WORDS or w.startswith(COMMENT_STARTS) for w in page.whole[e]):
        return True
    chars, _, link_chars, _ = totals
    return chars[e] < SHORT_CHARS or link_chars[e] >= LINK_SHARE * chars[e]


def _drop(page: Page) -> list[bool]:
    """Elements beside the article: by tag, role, class or id, or as a list of links. A class does
    not count against what holds an article or the main heading. Inside an article only a class that says
    nothing else counts, against containers that are short or full of links, and against comments."""
    n = len(page.tag)
    holds = [False] * n
    for e in range(n - 1, 0, -1):
        main = page.tag[e] == "h1" or (page.tag[e] in ARTICLES and not page.named[e])
        if not page.dropped[e] and (holds[e] or main):
            holds[page.parent[e]] = True
    dropped, inside = page.dropped[:], [False] * n
    totals = None
    for e in range(1, n):
        p = page.parent[e]
        dropped[e] = dropped[p] or dropped[e]
    if any(page.whole):
        totals = _totals(page, dropped)
    for e in range(1, n):
        p = page.parent[e]
        inside[e] = inside[p] or (page.tag[e] in ARTICLES and not page.named[e])
        if inside[p] and page.tag[e] != "article":
            beside = bool(page.whole[e]) and _counts_inside(page, e, totals)
        else:
            beside = page.named[e] or page.tag[e] == "header"
        dropped[e] = dropped[p] or dropped[e] or (beside and not holds[e])
    chars, _, link_chars, links = _totals(page, dropped)
    for e in range(1, n):
        menu = (page.tag[e] in MENU_TAGS and links[e] >= MENU_LINKS and not holds[e]
                and link_chars[e] >= MENU_SHARE * chars[e] > 0)
        dropped[e] = dropped[e] or dropped[page.parent[e]] or menu
    return dropped


def densities(page: Page, dropped: list[bool]) -> list[float]:
    """Characters per tag, times a logarithm that falls as more of the text is in links."""
    chars, tags, link_chars, links = _totals(page, dropped)
    of_body = link_chars[0] / chars[0] if chars[0] else 0.0
    found = []
    for c, t, lc, lt in zip(chars, tags, link_chars, links):
        if not c:
            found.append(0.0)
            continue
        base = math.log(c / max(c - lc, 1) * lc + of_body * c + math.e)
        spread = (c / max(lc, 1)) * (max(t, 1) / max(lt, 1))
        weight = math.log(max(spread, 1.0)) / math.log(base) if base > 1.0 + 1e-9 else math.log(max(spread, 1.0) + 1)
        found.append(c / max(t, 1) * weight)
    return found


def chosen_elements(page: Page, dropped: list[bool]) -> list[bool]:
    """Whether an element's text belongs to the article."""
    n = len(page.tag)
    density = densities(page, dropped)
    total = [0.0] * n
    for e in range(1, n):
        if not dropped[e]:
            total[page.parent[e]] += density[e]
    core = max(range(n), key=lambda e: (total[e], -e))
    threshold, e = density[core], core
    while e > 0:
        e = page.parent[e]
        threshold = min(threshold, density[e])
    # the densest subtree within each element
    best = list(range(n))
    for e in range(n - 1, 0, -1):
        p = page.parent[e]
        if not dropped[e] and (total[best[e]], -best[e]) > (total[best[p]], -best[p]):
            best[p] = best[e]
    taken, passed = [False] * n, [True] + [False] * (n - 1)
    for e in range(n):
        p = page.parent[e]
        if e and not (passed[p] and not dropped[e] and density[e] >= threshold):
            continue
        passed[e] = True
        taken[best[e]] = True
        if page.tag[e] == "article":
            taken[e] = True
    for e in range(1, n):
        taken[e] = not dropped[e] and (taken[e] or taken[page.parent[e]])
    return taken


def main_text(source: str | None) -> str:
    """Blocks of the article in page order, joined by newlines; white space is one space.

    NULL, empty pages and pages without text give an empty text. Tags left open, stray ends and
    unfinished comments are read as browsers do, as far as blocks are concerned.
    """
    if not source:
        return ""
    page = Page(source)
    taken = chosen_elements(page, _drop(page))
    blocks, block = [], []
    for e, text in [*page.runs, (0, None)]:
        if text is None:
            joined = _SPACE.sub(" ", "".join(block)).strip()
            if joined:
                blocks.append(joined)
            block = []
        elif taken[e]:
            block.append(text)
    return "\n".join(blocks)


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns) and ``text, n_chars`` of every page; no shuffle.

    Repeated rows and NULL ids are pages like others; other columns are not looked at.
    """
    def make():
        def work(columns):
            for source in columns[0]:
                text = main_text(source)
                yield text, len(text)

        return work

    return add_results(pages, ["html"], make, "text string, n_chars long", keep)
