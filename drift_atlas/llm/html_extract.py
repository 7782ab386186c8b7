"""Main text of web pages by line-block distribution.

A page is cut into blocks: the text between two tags that break the line.
Structure that can never be article text is dropped while cutting (scripts,
styles, menus, headers, footers, asides) by element name. Forms, and elements whose
class, id or role has a word of adverts, notices, comments and the like, are only
suspects: their own text and links decide. Over the blocks that are left, text lengths outside links are summed in a sliding window; the text starts at
the first surge of that sum and ends at its last dive. Where the page names an
article or main element, text outside it weighs less and must surge by itself, and
an element with a surge is text to its own ends.

One pass over the page, no tree: an open element's fate is a depth counter, so
missing and crossed end tags cost nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by their role in the layout.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
CHROME = {"nav", "header", "footer", "aside", "menu", "dialog", "select", "button", "template", "noscript", "svg", "canvas", "object", "video", "audio", "head", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CONTAINERS = {"article", "main"}
#: Words of a class, id or role that make an element a suspect.
CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disqus",
    "footer", "form", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup",
    "promo", "promotion", "related", "recommended", "replies", "reply", "respond", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe",
    "subscription", "signup", "login", "toolbar", "topbar", "widget", "widgets", "complementary", "contentinfo", "search", "alert", "disclaimer", "copyright", "tags",
    "aside", "discussion", "responses", "announcement", "announcements", "overlay", "lightbox", "tooltip", "topnav", "subnav", "sidenav", "mainnav", "sitenav", "mainmenu",
    "navmenu", "rail", "siderail", "leftbar", "rightbar", "teaser", "teasers", "trending", "adbox", "adslot", "adunit", "adwrap", "adcontainer", "commentlist", "commentform",
    "sitefooter", "siteheader", "pagefooter", "pageheader", "legal", "privacy",
}

#: Of these, the ones that also an article element may carry.
COMMENT_WORDS = {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "advertisement", "sponsored", "promo"}

#: Of these, the ones that name sections of articles as well, and those that hardly ever do.
SECTION_WORDS = {"sidebar", "header", "search", "discussion", "privacy", "legal", "form", "tags", "aside", "responses", "notice", "notices", "disclaimer", "copyright", "announcement", "announcements"}
STRONG_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "adbox", "adslot", "adunit", "adwrap", "adcontainer", "sponsor", "sponsored", "promo", "comment", "comments",
    "commentlist", "commentform", "disqus", "replies", "reply", "respond", "cookie", "cookies", "consent", "gdpr", "newsletter", "subscribe", "subscription", "signup", "login",
    "modal", "overlay", "lightbox", "popup", "tooltip",
}
#: What a word speaks of instead of naming the element: no-sidebar, content-with-sidebar.
MODIFIERS = {"no", "non", "not", "has", "have", "with", "without"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A suspect of a strong word stays where it has more than so many times the text of the rest of the page.
SUSPECT_SHARE = 3

#: Blocks on each side that a window sums, and the length of a window that counts as a surge.
REACH = 2
SURGE_CHARS = 40
#: What a character in an article or main element, or on a page without them, weighs against one outside.
INSIDE = 4

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_MARKS = re.compile(r"""(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _is_chrome(name: str, attributes: str) -> bool:
    return name in CHROME or bool(attributes and name not in ("body", "html") and _HIDDEN.search(attributes))


def _suspicion(name: str, attributes: str) -> int:
    """How an element's words look: 0 no suspicion, 1 a word that articles use as well, 3 a strong one, 2 any other."""
    if name == "form":
        return 3
    if not attributes or name in ("body", "html") or name in HEADINGS:
        return 0
    words = COMMENT_WORDS if name in CONTAINERS else CHROME_WORDS
    found: set[str] = set()
    for _, *values in _MARKS.findall(attributes):
        for part in re.sub(r"([a-z])([A-Z])", r"\1-\2", "".join(values)).lower().split():
            own = _WORD.findall(part)
            found.update(own[: next((k for k, w in enumerate(own) if w in MODIFIERS), len(own))])
    found &= words
    return 3 if found & STRONG_WORDS else 2 if found - SECTION_WORDS else int(bool(found))


class Suspect:
    """An open or closed element that may not be article text, and the text in it."""

    __slots__ = ("outer", "open", "suspicion", "inside", "depth", "encloses", "chars", "linked", "dense")

    def __init__(self, outer: Suspect | None, name: str, suspicion: int, depth: int):
        self.outer, self.open, self.suspicion, self.inside, self.depth = outer, [name], suspicion, depth > 0, depth
        self.encloses = False
        self.chars = self.linked = self.dense = 0

    def add(self, size: int, linked: int) -> None:
        self.chars += size
        self.linked += linked
        self.dense += _dense(size, linked)

    def is_text(self, rest: int) -> bool:
        """Whether its text stays, given the dense text of the page that is not suspect."""
        if self.encloses:
            return True
        if 2 * self.linked > self.chars:
            return False
        if self.suspicion == 1 and self.inside:
            return True
        return 2 * self.dense >= self.chars and (self.suspicion < 3 or self.dense > SUSPECT_SHARE * rest)

    def chain(self) -> Iterator[Suspect]:
        at: Suspect | None = self
        while at is not None:
            yield at
            at = at.outer


def _dense(size: int, linked: int) -> int:
    """Characters of a block outside links, if it is long enough to be text."""
    return size - linked if size - linked >= SURGE_CHARS and 2 * linked <= size else 0


def _ends_early(skip: list[str], name: str, closing: bool) -> bool:
    """Whether a tag ends a dropped element whose own end tag is missing."""
    if skip[0] == "p":
        return name not in INLINE and name not in VOID and not (closing and name == "p")
    if len(skip) > 1:
        return False
    if closing:
        return name in ("body", "html", *CONTAINERS) and name != skip[0]
    return name in CONTAINERS and skip[0] in ("head", "header", "nav", "menu") or name == skip[0] == "li" or name == "body" and skip[0] == "head"


class Block:
    """Text between line breaks: its parts, the characters inside links and inside suspect inline elements, and where it stands."""

    __slots__ = ("parts", "linked", "marked", "solid", "container", "suspect")

    def __init__(self, container: int, suspect: Suspect | None):
        self.parts: list[str] = []
        self.linked = self.marked = self.solid = 0
        self.container = container
        self.suspect = suspect

    def text(self) -> str:
        return _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, characters inside links, outermost container) of every block that is not page chrome; container 0 is none."""
    out: list[tuple[str, int, int, Suspect | None]] = []
    now = Block(0, None)
    suspect: Suspect | None = None  # the innermost open one
    marks: list[tuple[str, int]] = []  # open suspect inline elements
    skip: list[str] = []  # open elements inside dropped structure, the dropped one first
    within: Counter[str] = Counter()  # elements opened inside it that could end an open suspect
    links = containers = container = 0
    open_containers: list[tuple[str, int]] = []
    now_marks: list[tuple[str, int]] = []  # all suspect inline elements of the block
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal now
        if now.parts:
            text = now.text()
            if text:
                if now.marked and now.marked == now.solid:
                    # An inline element is part of its block's text unless it is all of it.
                    now.suspect = Suspect(now.suspect, "", max(x for _, x in now_marks), len(open_containers))
                for one in now.suspect.chain() if now.suspect else ():
                    one.add(len(text), min(now.linked, len(text)))
                out.append((text, now.linked, now.container, now.suspect))
        marks.clear()
        now_marks.clear()
        now = Block(container, suspect)

    def text(part: str) -> None:
        if part and not skip:
            now.parts.append(part)
            now.solid += len(part.strip())
            if marks:
                now.marked += len(part.strip())
            if links:
                now.linked += len(part)

    def close(one: Suspect | None) -> None:
        """What lies in a closed suspect is closed with it."""
        nonlocal suspect
        flush()
        suspect = one.outer if one else None
        now.suspect = suspect

    def end_suspects(name: str, closing: bool) -> None:
        for one in tuple(suspect.chain()) if suspect else ():
            if one.open[0] == "p" and name not in INLINE and name not in VOID and not (closing and name == "p") or len(one.open) == 1 and name == "li" == one.open[0] and not closing:
                close(one)
            elif closing and name in ("body", "html"):
                close(one)
        for one in suspect.chain() if suspect else ():
            if name in one.open and name not in VOID:
                if closing:
                    one.open.pop()
                    if not one.open:
                        close(one)
                else:
                    one.open.append(name)
                break

    while at < size:
        match = _TAG.search(page, at)
        if match is None:
            text(page[at:])
            break
        text(page[at : match.start()])
        at = match.end()
        closing, name, attributes = match[1], match[2], match[3]
        if name is None:
            continue
        name = name.lower()
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            if name not in INLINE:
                flush()
            continue
        single = name in VOID or attributes.rstrip().endswith("/")
        if skip and name != skip[0] and not single and any(name in one.open for one in (suspect.chain() if suspect else ())):
            within[name] += -1 if closing else 1
        if skip and (_ends_early(skip, name, bool(closing)) or within[name] < 0):
            skip.clear()
        elif skip:
            # Only the kind of element that is being dropped can end it, nested ones of its kind first.
            if name == skip[0] and name not in VOID:
                if closing:
                    skip.pop()
                elif not attributes.rstrip().endswith("/"):
                    skip.append(name)
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name in INLINE:
            if closing or single:
                if closing and marks and marks[-1][0] == name:
                    marks.pop()
                continue
            if not _is_chrome(name, attributes):
                look = _suspicion(name, attributes)
                if look or marks and marks[-1][0] == name:
                    marks.append((name, look or marks[-1][1]))
                    now_marks.append(marks[-1])
                continue
        flush()
        if not closing and not single and _is_chrome(name, attributes):
            skip.append(name)
            within.clear()
            continue
        if closing or not single:
            end_suspects(name, bool(closing))
        look = 0 if closing or single else _suspicion(name, attributes)
        if name in CONTAINERS:
            if not closing:
                for one in suspect.chain() if suspect and not look else ():
                    one.encloses = True
                containers += 1
                open_containers.append((name, containers))
            else:
                while open_containers and open_containers.pop()[0] != name:
                    pass
                for one in tuple(suspect.chain()) if suspect else ():
                    if one.depth > len(open_containers):
                        close(one)
            container = open_containers[0][1] if open_containers else 0
        if look:
            suspect = Suspect(suspect, name, look, len(open_containers))
        now = Block(container, suspect)
    flush()
    rest = sum(_dense(len(text), linked) for text, linked, _, one in out if one is None or all(x.encloses for x in one.chain()))
    return [(text, linked, held) for text, linked, held, one in out if one is None or all(x.is_text(rest) for x in one.chain())]


def _sums(lengths: list[int], reach: int) -> list[int]:
    n = len(lengths)
    total = [0]
    for x in lengths:
        total.append(total[-1] + x)
    return [total[min(n, k + reach + 1)] - total[max(0, k - reach)] for k in range(n)]


def surge_and_dive(lengths: list[int], reach: int = REACH, surge: int = SURGE_CHARS, inside: list[int] | None = None) -> tuple[int, int]:
    """First and last + 1 block of the text: where the windowed sums rise to the surge and fall from it for good.

    ``inside`` has the outermost container of every block. If there is one, blocks
    outside it count a quarter and bound the text only where they surge without its
    help; a container that surges by itself is text to its ends.
    """
    n = len(lengths)
    if not n:
        return 0, 0
    named = inside if inside and any(inside) else [1] * n
    weighed = [x * (INSIDE if c else 1) for x, c in zip(lengths, named)]
    sums = _sums(weighed, reach)
    sides = [_sums([x if bool(c) == side else 0 for x, c in zip(weighed, named)], reach) for side in (False, True)]
    own = [sides[bool(c)][k] for k, c in enumerate(named)]
    level = min(surge * INSIDE, max(own))
    risen = [k for k, c in enumerate(named) if (sums[k] if c else own[k]) >= level]
    first, last = risen[0], risen[-1]
    while first < last and not lengths[first]:
        first += 1
    while last > first and not lengths[last]:
        last -= 1
    if named is inside:
        surging = {c for c, x in zip(named, own) if c and x >= level}
        ends = [k for k, c in enumerate(named) if c in surging]
        if ends:
            first, last = min(first, ends[0]), max(last, ends[-1])
    return first, last + 1


def main_text(page: str | None) -> str:
    """The article's text, its blocks joined by one space; empty if there is none."""
    found = blocks(page or "")
    first, last = surge_and_dive([max(0, len(text) - linked) for text, linked, _ in found], inside=[c for _, _, c in found])
    return " ".join(text for text, _, _ in found[first:last])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points).

    Null and empty HTML give an empty text. Each row stands alone; repeats are kept
    and further columns are dropped. Character references are decoded, white space
    inside a block becomes one space, and blocks are joined by one space.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(_run, f"page_id {rows.schema[0].dataType.simpleString()}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
