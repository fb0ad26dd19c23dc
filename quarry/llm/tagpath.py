"""HTML extraction by tag-path ratios.

A page is cut into blocks of text at block-level tags.  Every block has the
path of block-level elements from the root to it.  Over all blocks of one
path the text length and the punctuation are added up; their ratios to the
number of blocks say how much that path looks like prose (menus and forms:
many short texts without punctuation).  The two ratios are smoothed along
the page with a Gaussian kernel, fused by multiplication, and paths whose
mean reaches ``CUT`` standard deviations are content.

Where the content lies is the article: the article and main elements, of
several the one with most content and those of half as much (lists of
teasers have less), or if content lies outside them the smallest element that
holds all content, with the page's heading before it.  In the article what
the paths say stays; short paragraphs, headings, list items and links have a
low path and stay too, but for what several votes speak against:

* no content path in it, and mostly links: a list of links outside article
  elements, or inside one if its name says menu, related posts or the like;
* outside article elements a container with such a name, unless the article's
  main path runs through it;
* a container whose whole class or id is an advert's, a sidebar's, a cookie
  notice's or the reader comments'.

Names of headings and paragraphs never count.  Elements of another role weigh
nothing anywhere: navigation, page headers, footers, asides, forms, scripts,
styles, hidden elements.

The scanner only moves forward, each element is looked at once downwards and
once upwards, and a path is a number: time and memory grow in proportion to
the page, also for unclosed or deeply nested markup.  One page is handled at
a time, whole; pages don't meet, so nothing is shuffled.  Null and empty html,
and pages without text, give an empty text.  Repeated rows give one row each.
Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import exact

SIGMA = 1.0
CUT = 0.5
#: smoothing lifts a path to at most so many times its own ratios
LIFT = 4.0
#: share of a text inside links from which it counts as links
LINKS = 0.6
#: links that make a list of links
LIST = 3
#: share of the main article's content from which another article element belongs to the page's text
BESIDE = 0.5

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark nobr q rp rt ruby s samp
  small span strike strong sub sup time tt u var wbr""".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
  header hgroup hr main menu nav ol p pre search section table ul""".split())
CONTAINERS = frozenset("div section ul ol dl table center details header span td".split())
#: an opening tag of the key closes an open one of the values, up to the scope
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
OTHER_ROLE = frozenset("""head title script style noscript template nav footer aside form button select textarea input label fieldset iframe object
  embed svg canvas audio video dialog menu map noframes search""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar menuitem status tooltip toolbar tablist".split())
#: first and last parts of class and id names that give a vote
NAMES = frozenset("""menu nav navbar navigation topnav breadcrumb breadcrumbs crumbs header masthead footer sidebar sidenav aside rail widget widgets
  ad ads advert adverts advertisement advertising adsbygoogle adsense adbox sponsor sponsored sponsors promo promos promotion banner
  cookie cookies consent gdpr notice notices notification notifications alert alerts announcement disclaimer popup modal overlay lightbox
  newsletter subscribe subscription signup login signin register search searchbox share sharing social related recommended recommendations
  comment comments commentlist respond replies reply disqus discussion feedback pagination pager paging toolbar copyright legal skip
  skiplink hidden offscreen""".split())
#: whole class and id names of what no article's own part is called
WHOLE = frozenset("""comment comments commentlist comment-list comments-area comments-section disqus_thread respond ad ads ad-slot advert adverts
  advertisement adsbygoogle sponsored sidebar cookie-notice cookie-banner cookie-consent gdpr newsletter newsletter-signup breadcrumb breadcrumbs
  pagination related-posts share-buttons social-share""".split())

_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？¿¡]")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_ARTICLE = re.compile(r"<(?:article|main|h1)\b", re.I)
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_FORM_END = re.compile(r"</form", re.I)


class _Element:
    """``vote``: 2 for a whole name, 1 for part of one, of the element alone; ``other`` and ``article`` also hold inside it."""
    __slots__ = ("tag", "parent", "other", "vote", "path", "article", "link", "block", "number")

    def __init__(self, tag: str, parent: "_Element | None", other: bool, vote: int, path: int, number: int):
        self.tag, self.parent, self.other, self.vote, self.path, self.number = tag, parent, other, vote, path, number
        inline = tag in INLINE
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.link = tag == "a" or (inline and parent is not None and parent.link)
        self.block = parent.block if inline and parent is not None else self


class _Block:
    __slots__ = ("element", "text", "links", "anchors")

    def __init__(self, element: _Element, text: str, links: int, anchors: int):
        self.element, self.text, self.links, self.anchors = element, text, links, anchors


def _vote(value: str) -> int:
    best = 0
    for word in value.lower().split():
        if word in WHOLE:
            return 2
        parts = re.split(r"[-_:]+", word)
        if parts[0] not in ("has", "with", "no", "without", "is") and (parts[0] in NAMES or parts[-1] in NAMES):
            best = 1
    return best


def _roles(tag: str, attributes: str, parent: _Element) -> tuple[bool, int]:
    """(other role by element, vote of its names)"""
    other = tag in OTHER_ROLE or (tag == "header" and not parent.article)
    vote = 0
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                other = True
            elif key == "style":
                other |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
            elif key == "role":
                other |= value.lower() in ROLES
            elif key in ("class", "id"):
                v = _vote(value)
                if tag in CONTAINERS or (tag == "article" and v == 2):
                    vote = max(vote, v)
    return other, vote


def _tags(page: str) -> Iterator[tuple[str, str, bool, str, int]]:
    """(text before it, name, closes, attributes, place behind it) of every tag, forward only; the last has no name.

    What stands in script, style and the like is passed over.
    """
    n, last = len(page), page.rfind(">")
    at = begin = 0                                   # place of the search; start of the text
    lone = {'"': n, "'": n}                          # from here on the quote has no partner before the last ">"
    text: list[str] = []
    while True:
        i = page.find("<", at)
        if i < 0 or i > last:
            text.append(page[begin:])
            yield "".join(text), "", False, "", n
            return
        head = page[i + 1:i + 2]
        if head in ("!", "?"):
            text.append(page[begin:i])
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                end = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", i):
                end = page.find("]]>", i)
                text.append(html.escape(page[i + 9:n if end < 0 else end], quote=False))
                end = n if end < 0 else end + 3
            else:
                end = page.find(">", i) + 1
            at = begin = end
            continue
        closes = head == "/"
        m = _NAME.match(page, i + 1 + closes)
        if m is None:
            at = i + 1
            continue
        j = m.end()
        while True:
            q = _STOP.search(page, j)                # there is a ">" ahead
            sign, j = q[0], q.end()
            if sign == ">":
                break
            back = q.start() - 1
            while page[back].isspace():
                back -= 1
            if page[back] != "=" or q.start() >= lone[sign]:
                continue                             # a quote counts as the start of a value only
            k = page.find(sign, j)
            if k < 0 or k > last:
                lone[sign] = q.start()
            else:
                j = k + 1
        text.append(page[begin:i])
        tag, attributes, at = m[0].lower(), page[m.end():j - 1], j
        if tag in RAW and not closes and not attributes.endswith("/"):
            end = _RAW_ENDS[tag].search(page, j)
            at = n if end is None else (page.find(">", end.end()) + 1 or n)
        yield "".join(text), tag, closes, attributes, at
        text, begin = [], at


def _scan(page: str) -> tuple[list[_Element], list[_Block]]:
    """Elements, parents first, and the blocks of text in order, with white space collapsed."""
    root = _Element("", None, False, 0, 0, 0)
    elements, here = [root], root
    paths: dict[tuple[int, str], int] = {}
    opened: dict[str, int] = {}
    out: list[_Block] = []
    text: list[str] = []
    linked = anchors = 0
    home = root
    marks: list[int] | None = None
    form_ends: list[int] = []

    def flush() -> None:
        nonlocal text, linked, anchors
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(_Block(home, joined, linked, anchors))
            text, linked, anchors = [], 0, 0

    def add(raw: str) -> None:
        nonlocal linked, anchors, home
        if not raw:
            return
        raw = html.unescape(raw)
        if not text:
            if raw.isspace():
                return
            home = here
        text.append(raw)
        if here.link:
            linked += len(raw.strip())
            anchors += 1

    def leave(to: _Element) -> None:
        nonlocal here
        while here is not to:
            opened[here.tag] -= 1
            here = here.parent

    def close(tag: str, stop: tuple = ()) -> None:
        """Leaves the nearest open element of that name."""
        if not opened.get(tag):
            return
        e = here
        while e.tag != tag:
            if e.tag in stop:
                return
            e = e.parent
        leave(e.parent)

    for before, tag, closes, attributes, at in _tags(page):
        add(before)
        if not tag:
            break
        block = tag not in INLINE
        if tag == "br":
            add(" ")
            continue
        if closes:
            if block:
                flush()
                close(tag)
            else:
                close(tag, tuple(CLOSES_P))
            continue
        if block:
            flush()
            if tag in CLOSES_P:
                close("p", ("table", "td", "th", "button", "body"))
            for sibling in SIBLINGS.get(tag, ()):
                close(sibling, SCOPE.get(tag, ("table",)))
        other, vote = _roles(tag, attributes, here)
        if tag == "form" and other:
            if marks is None:
                marks, form_ends = [m.start() for m in _ARTICLE.finditer(page)], [m.start() for m in _FORM_END.finditer(page)]
            a, b = bisect_left(marks, at), bisect_left(form_ends, at)
            other = not (a < len(marks) and (b == len(form_ends) or marks[a] < form_ends[b]))
        if tag in VOID or attributes.endswith("/") and block and tag not in CLOSES_P:
            continue
        if tag in RAW:
            continue
        path = here.path if not block else paths.setdefault((here.path, tag), len(paths) + 1)
        here = _Element(tag, here, here.other or other, vote, path, len(elements))
        elements.append(here)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return elements, out


def blocks_of(page: str) -> list[_Block]:
    return _scan(page)[1]


def ratios(blocks: list[_Block]) -> dict[int, float]:
    """The fused score of each path: smoothed text ratio times smoothed punctuation ratio."""
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for b in blocks:
        p = b.element.path
        length[p] = length.get(p, 0) + max(0, len(b.text) - b.links)
        marks[p] = marks.get(p, 0) + len(_PUNCTUATION.findall(b.text))
        count[p] = count.get(p, 0) + 1
    paths = [b.element.path for b in blocks]
    text = np.array([length[p] / count[p] for p in paths])
    mark = np.array([1 + marks[p] / count[p] for p in paths])
    r = np.arange(-3, 4)
    kernel = np.exp(-r * r / (2 * SIGMA * SIGMA))
    even = np.convolve(np.ones(len(paths)), kernel, "full")[3:-3]
    smooth = lambda v: np.convolve(v, kernel, "full")[3:-3] / even
    fused = smooth(text) * smooth(mark)
    sums: dict[int, float] = {}
    for p, f in zip(paths, fused.tolist()):
        sums[p] = sums.get(p, 0.0) + f
    own = {p: length[p] / count[p] * (1 + marks[p] / count[p]) for p in sums}
    return {p: min(s / count[p], LIFT * own[p]) for p, s in sums.items()}


class _Sums:
    """Of each element with all inside it: characters, those in links, those on content paths, those of the content
    that votes, blocks on the main path, and links."""

    def __init__(self, elements: list[_Element], live: list[_Block], score: dict[int, float], limit: float, content: list[_Block], main: int):
        n = len(elements)
        self.text, self.links, self.prose, self.content, self.main, self.anchors = ([0] * n for _ in range(6))
        for b in live:
            k = b.element.number
            self.text[k] += len(b.text)
            self.links[k] += b.links
            self.anchors[k] += b.anchors
            self.main[k] += b.element.path == main
            if score.get(b.element.path, -1.0) >= limit and b.links < LINKS * len(b.text):
                self.prose[k] += len(b.text)
        for b in content:
            self.content[b.element.number] += len(b.text)
        for e in reversed(elements[1:]):
            for v in (self.text, self.links, self.prose, self.content, self.main, self.anchors):
                v[e.parent.number] += v[e.number]


def _homes(elements: list[_Element], content: list[_Block], s: _Sums) -> tuple[set[int], set[int]]:
    """(the article's elements, article elements that are no part of it)"""
    own = {e.number: s.content[e.number] for e in elements if e.tag in ("article", "main") and not e.other}
    above: dict[int, int] = {}                     # the nearest article element round each element
    for e in elements:
        up = e.parent
        above[e.number] = -1 if up is None else up.number if up.number in own else above[up.number]
    for k in own:
        if above[k] >= 0:
            own[above[k]] -= s.content[k]
    foreign: set[int] = set()
    if own:
        first = max(own, key=lambda k: (own[k], -k))
        round_it, k = set(), first
        while k >= 0:
            round_it.add(k)
            k = above[k]
        foreign = {k for k in own if k not in round_it and elements[k].tag == "article" and own[k] < BESIDE * own[first]}
    state = [0] * len(elements)                    # 1: in an article element, 2: in a foreign one
    for e in elements[1:]:
        state[e.number] = 2 if e.number in foreign else state[e.parent.number] or (1 if e.number in own else 0)
    mine = [b for b in content if state[b.element.number] != 2]
    if mine and all(state[b.element.number] == 1 for b in mine):
        return {k for k in own if above[k] < 0 and k not in foreign and s.content[k]}, foreign
    # the innermost element that holds all of it
    inside = [0] * len(elements)
    for b in mine:
        inside[b.element.number] += 1
    for e in reversed(elements[1:]):
        inside[e.parent.number] += inside[e.number]
    top = elements[max(k for k, v in enumerate(inside) if v == len(mine))] if mine else elements[0]
    top = top.block
    if top.tag in CLOSES_P - {"div", "section", "article", "main", "center", "details"}:
        top = top.parent or top                    # a single paragraph: its neighbours belong to it
    return {top.number}, foreign


def _chosen(elements: list[_Element], live: list[_Block]) -> list[_Block]:
    votes = [0] * len(elements)
    for e in elements[1:]:
        votes[e.number] = max(votes[e.parent.number], e.vote)
    voters = [b for b in live if not votes[b.element.number]] or live
    score = ratios(voters)
    limit = CUT * float(np.std([score[b.element.path] for b in voters]))
    content = [b for b in voters if score[b.element.path] >= limit and b.links < LINKS * len(b.text)] or voters
    mass: dict[int, int] = {}
    for b in content:
        mass[b.element.path] = mass.get(b.element.path, 0) + len(b.text)
    main = max(mass, key=lambda p: (mass[p], -p))
    s = _Sums(elements, live, score, limit, content, main)
    homes, foreign = _homes(elements, content, s)

    inside, gone = [False] * len(elements), [False] * len(elements)
    inside[0] = 0 in homes
    for e in elements[1:]:
        k, up = e.number, e.parent.number
        inside[k] = inside[up] or k in homes
        out = k in foreign
        if inside[up] and not out:
            links = not s.prose[k] and s.links[k] >= LINKS * max(1, s.text[k])
            if e.vote == 2:
                out = True
            elif e.vote == 1:
                out = links if e.article else not s.main[k]
            elif e.tag in CONTAINERS and not e.article:
                out = links and s.anchors[k] >= LIST
        gone[k] = gone[up] or out
    kept = [b for b in live if inside[b.element.number] and not gone[b.element.number]]
    if kept and not any(b.element.block.tag == "h1" for b in kept):
        # the page's heading stands before the article's element
        at = live.index(kept[0])
        title = next((b for b in reversed(live[:at]) if b.element.block.tag == "h1" and not votes[b.element.number]
                      and b.links < LINKS * len(b.text) and not gone[b.element.number]), None)
        if title is not None and not any(elements[k].article for k in homes):
            kept = [title, *kept]
    return kept


def main_text(page: str) -> str:
    """The article's blocks, joined by line breaks."""
    elements, found = _scan(page)
    live = [b for b in found if not b.element.other]
    if not live:
        return ""
    return "\n".join(b.text for b in _chosen(elements, live) or live)


def extract(html_column: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(lambda p: main_text(p) if p else "")
    return run(html_column)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    pages = exact(pages, id_col, url_col, html_col)
    texts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extract(F.col(html_col).cast("string")).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
