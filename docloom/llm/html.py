"""Main text of web pages by tree scoring.

A tolerant scan turns a page into block elements, closing what authors left open. Every block of
text gives points for its length and commas, the whole of them to the element that holds its
paragraph and half to the next, and link density discounts each element's sum. The best element
is kept with those siblings that score well or are built alike. Parts that by tag, role, class or
id are menus, page headers, footers, sidebars, notices, adverts, forms or reader comments count
for nothing and are left out; names that only may mean that count against an element unless it holds
most of the page's text. Pages are independent: one pass, no shuffle, time in proportion to the page.

Defined cases: null and empty pages, and pages without text blocks, give the empty string; broken
markup never fails; a "<" that no ">" follows is text; elements nested more than 512 deep count as one;
other columns are ignored; repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from docloom.llm.common import map_batches

OPENING = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
PLAIN = re.compile(r"""[^>"']*""")
RAW = frozenset("script style noscript template svg math iframe object textarea select canvas video audio".split())
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: Elements deeper than this add nothing to the tree, as in browsers.
DEEPEST = 512
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q ruby rp rt s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("head nav footer aside form button menu dialog fieldset title".split())
#: An opening tag of the first kind closes an open element of the second kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("table ul ol dl div article main section body blockquote".split())
KEEPS_P_OPEN = frozenset({"br", "head", "title"})
ATTR = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: Words in a class or id that make an element noise wherever they stand.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|nav|navbar|topnav|navigation|menu|breadcrumbs?|sidebar|footer|masthead|site-?header|page-?header|topbar|toolbar|cookies?|consent|gdpr|popup|modal|newsletter|comments?|commentlist|commenters?|disqus|pagination|pager)(?:$|[\s_-])",
    re.I,
)
#: Words that mostly do, unless the name goes on to end in a good word or the element holds most of the page's text.
DOUBTFUL = re.compile(
    r"(?:^|[\s_-])(?:promo(?:tion|s)?|banner|side|rail|widget|foot|notice|alert|overlay|subscribe|signup|login|share|sharing|social|related|recommend(?:ed|ations?)?|discussion|respond|replies|skip|search|form|copyright|legal|disclaimer|hidden)(?:$|[\s_-])",
    re.I,
)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|hentry)(?:$|[\s_-])", re.I)
GOOD_END = re.compile(r"(?:article|body|content|entry|main|post|story|text|hentry)$", re.I)
PAGE_HEADER = re.compile(r"(?:^|\s)(?:(?:site|page|top|main|global|blog)[-_]?)?(?:header|head)(?:$|\s)", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "branch", "chars", "depth", "doubtful", "dropped", "good", "inside", "link", "listed", "mark", "parent", "score", "tag")

    def __init__(self, tag, parent, attrs=""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.score, self.chars, self.link, self.mark, self.good = 0.0, 0, 0, False, 0
        self.depth = parent.depth + 1 if parent is not None else 0
        self.inside = parent is not None and parent.inside  # an article or the main part
        self.dropped = parent is not None and parent.dropped
        self.doubtful = False
        if not self.dropped:
            self._judge()
        self.inside |= tag in ("article", "main")

    def _judge(self):
        inside = self.inside
        if self.tag in DROPPED_TAGS or (self.tag == "header" and not inside):
            self.dropped = True
            return
        if self.tag in ("article", "main"):
            self.good = 25
        for name, *value in ATTR.findall(self.attrs) if self.attrs else ():
            name, value = name.lower(), "".join(value)
            if name in ("class", "id") and self.tag not in ("body", "html"):
                value = CAMEL.sub("-", value)
                if not inside and PAGE_HEADER.search(value):
                    self.dropped = True
                if GOOD.search(value):
                    self.good += 10
                if self.tag not in ("article", "main"):
                    if NOISE.search(value):
                        self.dropped = True
                    if any(DOUBTFUL.search(w) and not GOOD_END.search(w) for w in value.split()):
                        self.doubtful = True
            elif name == "role":
                self.dropped |= value.lower() in NOISE_ROLES
                self.good += 25 * (value.lower() in ("main", "article"))
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                self.dropped = True


class Scan:
    """Where tags end. No part of a page is searched again after a search has failed there."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.bad: set[int] = set()  # quotes from which on no tag ends

    def tag_end(self, start: int) -> tuple[int, bool]:
        """Behind the ">" that ends the tag whose attributes start here, and whether its quotes are sound."""
        page, at, seen = self.page, start, []
        while True:
            at = PLAIN.match(page, at).end()
            c = page[at : at + 1]
            if c == ">":
                return at + 1, True
            if not c or at in self.bad or at >= self.last[c]:
                break
            seen.append(at)
            at = page.find(c, at + 1) + 1
        self.bad.update(seen)
        self.bad.add(at)
        return page.find(">", start) + 1, False


def blocks(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements, parents first, and blocks of text in page order: element, text, characters inside links."""
    at = Node("html", None)
    nodes = [at]
    out: list[tuple[Node, str, int]] = []
    held: list[str] = []
    linked, in_link = 0, False
    open_: dict[str, int] = {"html": 1}  # open elements by tag
    deeper: dict[str, int] = {}
    scan, i, n_page = Scan(page), 0, len(page)

    def flush():
        nonlocal linked
        if held:
            text = BLANK.sub(" ", unescape("".join(held))).strip()
            if text:
                out.append((at, text, min(linked, len(text))))
            held.clear()
        linked = 0

    def up(to):
        nonlocal at
        while at is not to:
            open_[at.tag] -= 1
            at = at.parent

    while i < n_page:
        j = page.find("<", i)
        j = n_page if j < 0 else j
        if j > i:
            held.append(page[i:j])
            if in_link:
                linked += len(page[i:j].strip())
            i = j
            continue
        m = OPENING.match(page, j)
        if m is None and page.startswith("<!--", j):
            end = page.find("-->", j + 4)
            i = n_page if end < 0 else end + 3
            continue
        if (m is None and page[j + 1 : j + 2] not in ("!", "?")) or scan.last[">"] < j:
            held.append("<")
            linked += in_link
            i = j + 1
            continue
        if m is None:
            i = page.find(">", j) + 1
            continue
        closing, tag = bool(m[1]), m[2].lower()
        i, sound = scan.tag_end(m.end())
        attrs = page[m.end() : i - 1] if sound else ""
        if tag in RAW and sound and not closing:
            end = RAW_END[tag].search(page, i)
            i = end.end() if end else n_page
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            continue
        if tag == "br":
            held.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        in_link = False
        if closing:
            if deeper.get(tag):
                deeper[tag] -= 1
            elif open_.get(tag):
                n = at
                while n.tag != tag:
                    n = n.parent
                if n.parent is not None:
                    up(n.parent)
            continue
        if at.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and tag not in KEEPS_P_OPEN:
            up(at.parent)
        shut = CLOSES.get(tag)
        if shut and any(open_.get(t) for t in shut):
            n = at
            while n is not None and n.tag not in shut and n.tag not in SCOPES:
                n = n.parent
            if n is not None and n.tag in shut and n.parent is not None:
                up(n.parent)
                if tag == "tr" and n.tag != "tr" and at.tag == "tr":
                    up(at.parent)
        if at.depth >= DEEPEST:
            deeper[tag] = deeper.get(tag, 0) + 1
            continue
        at = Node(tag, at, attrs)
        nodes.append(at)
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    return nodes, out


PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption".split())


def settle(nodes: list[Node], found: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """Blocks that are not noise, with the sums of text and link characters of every element.

    A doubtful element is noise unless it holds at least half of what is left of the page, few of it links.
    """

    def add_up(kept):
        for n in nodes:
            n.chars = n.link = 0
        for n, text, link in kept:
            n.chars += len(text)
            n.link += link
        for n in reversed(nodes):
            if n.parent is not None:
                n.parent.chars += n.chars
                n.parent.link += n.link

    kept = [b for b in found if not b[0].dropped]
    add_up(kept)
    if any(n.doubtful for n in nodes):
        all_ = nodes[0].chars
        for n in nodes:
            n.dropped |= (n.doubtful and not (2 * n.chars >= all_ and 4 * n.link <= n.chars)) or (n.parent is not None and n.parent.dropped)
        kept = [b for b in found if not b[0].dropped]
        add_up(kept)
    return kept


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, found = blocks(page)
    found = settle(nodes, found)
    if not found:
        return ""
    least = 25 if any(len(t) >= 25 for _, t, _ in found) else 1
    holders: dict[int, Node] = {}
    for node, text, link in found:
        if len(text) < least:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - link / len(text))
        n, share = (node.parent if node.tag in PARAGRAPHS and node.parent is not None else node), 1.0
        for _ in range(2):
            if n is None:
                break
            n.score += share * points
            holders[id(n)] = n
            n, share = n.parent, share / 2
    if not holders:
        return ""
    rank = lambda n: (n.score + (n.good if n.score else 0)) * (1 - n.link / max(n.chars, 1))
    best = max(holders.values(), key=rank)
    n = best
    while n is not None:  # parts of one article belong together
        if n.tag in ("article", "main"):
            best = n
        n = n.parent
    best.mark = True
    bar = max(10.0, 0.2 * rank(best))
    for n in nodes:  # the sibling of the best element, or that itself, above each element
        n.branch = None if n.parent is None else n if n.parent is best.parent else n.parent.branch
    for n in {id(b[0].branch): b[0].branch for b in found}.values():
        if n is not None and not n.mark:
            alike = n.tag == best.tag and n.attrs == best.attrs and n.link <= n.chars / 2
            prose = n.tag == "p" and n.link <= n.chars / 4 and n.chars > 80 and best.tag not in ("article", "main")
            n.mark = alike or prose or (best.tag not in ("article", "main") and id(n) in holders and rank(n) >= bar)
    for n in nodes:  # from here on: below a marked element; in a list of links below it
        above = n.parent
        n.listed = not n.mark and ((above is not None and above.listed) or (n.tag in ("ul", "ol") and n.link > 0.8 * n.chars))
        n.mark |= above is not None and above.mark
    return "\n".join(text for node, text, _ in found if node.mark and not node.listed)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points), one row for each page."""

    def run(batch):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)}

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
