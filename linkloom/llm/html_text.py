"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block element.  What is boilerplate by its
element, role or class (menus, page headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) leaves lines of length zero,
unless it stands within the text of one container.  A class or id, a form, a
dialog or a hidden wrapper doesn't make
an element boilerplate that holds the page's article or most of its text.
Text lengths -- link text not counted -- are summed over windows of ``WINDOW``
lines; a surge point is where the sum rises above the threshold, a dive point
where it falls back to zero, and the text between the two is kept, with the
other lines of the containers that it stands in (but for the page itself).
The same windows decide where the page marks its article (``<article>``,
``<main>``); the mark only weighs lines: a line within it weighs a surge more
than all its characters, links too, and one outside it a 64th of its own, so a
text beside the article must be very long to surge.

A page is read in one pass with a stack of open elements; an element's text is
summed on the way and what it holds is known at its end, so time is linear in
the page, however deep it nests.

Cases: a null or empty page, or one without any text, gives an empty text; a
page whose longest window stays under the threshold gives its longest regions;
unclosed elements end where HTML
implies it, with their parent or with the page; pages of any length are read whole;
repeated rows are read one by one; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Characters in a window that make a surge.
SURGE = 86
#: On a page that marks its article, the part of their length that lines outside it weigh.
OUTSIDE_PART = 64
#: In place of an element's number: a boilerplate element within a line, and others of its name in it.
MUTE, NESTED = -1, -2

_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>?)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
# Element names and naming customs of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
DROP = {"nav", "footer", "aside", "head", "template", "svg", "button", "select", "menu", "object", "canvas", "audio", "video"}
#: Boilerplate by element that may also stand around a whole page.
WRAPPERS = {"form", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MAIN = {"article", "main"}
NEVER_DROPPED = {"html", "body", "main"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
DROP_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "comment", "comments", "disqus", "sidebar",
              "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "banner",
              "popup", "modal", "newsletter", "subscribe", "share", "sharing", "social", "related", "recommended", "widget", "pagination", "pager",
              "login", "signup", "skyscraper", "masthead", "topbar", "toolbar", "copyright", "disclaimer"}

#: A class or id like has-sidebar says something of the page, not what its element is.
STATE_WORDS = {"has", "no", "with", "without", "not"}
COMMENT_NAMES = {"comment", "comments", "disqus"}
# End tags that HTML lets a page leave out: element -> (opening tags that end it, elements that they don't reach through).
_P_ENDS = {"address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
           "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
_CELLS, _PARTS = {"td", "th"}, {"tbody", "thead", "tfoot"}
IMPLIED = {"p": (_P_ENDS, {"table", "td", "th", "caption", "object", "template", "button"}), "li": ({"li"}, {"ul", "ol", "menu", "table"}), "dd": ({"dd", "dt"}, {"dl", "table"}), "dt": ({"dd", "dt"}, {"dl", "table"}),
           "td": (_CELLS | _PARTS | {"tr"}, {"table"}), "th": (_CELLS | _PARTS | {"tr"}, {"table"}), "tr": (_PARTS | {"tr"}, {"table"}),
           **dict.fromkeys(_PARTS, (_PARTS, {"table"})), "option": ({"option", "optgroup"}, {"select"})}
_ENDING = frozenset().union(*(ends for ends, _ in IMPLIED.values()))
#: What end tags don't reach through, other than those of tables.
_SCOPE, _TABLE = {"table", "td", "th", "caption", "object", "template"}, {"table", "tr", "td", "th", "caption", *_PARTS}
#: Elements that are part of the text around them: their lines belong to the container that they stand in.
FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "address", "center"}


_ENDED_BY = {tag: tuple(e for e, (ends, _) in IMPLIED.items() if tag in ends) for tag in _ENDING}


class _Open:
    """The open elements, with the places of each name, so no tag looks through the whole stack."""

    def __init__(self):
        self.names: list[str] = []
        self.numbers: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []

    def push(self, tag: str, number: int) -> None:
        self.places.setdefault(tag, []).append(len(self.names))
        if tag in _SCOPE:
            self.walls.append(len(self.names))
        self.names.append(tag)
        self.numbers.append(number)

    def cut(self, keep: int) -> list[int]:
        """Close all but the first ``keep`` elements; the numbers of those closed, innermost first."""
        out = []
        while len(self.names) > keep:
            tag = self.names.pop()
            self.places[tag].pop()
            if tag in _SCOPE:
                self.walls.pop()
            out.append(self.numbers.pop())
        return out

    def _last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def kept_by_opening(self, tag: str) -> int:
        """How many of the open elements stay open when ``tag`` opens."""
        keep = len(self.names)
        for name in _ENDED_BY.get(tag, ()):
            places = self.places.get(name)
            if places:
                wall = max(self._last("table"), *(self._last(w) for w in IMPLIED[name][1]))
                at = bisect_right(places, wall)
                if at < len(places):
                    keep = min(keep, places[at])
        return keep

    def kept_by_closing(self, tag: str) -> int:
        """How many of the open elements stay open behind the end tag of ``tag``."""
        at = self._last(tag)
        blocked = tag not in _TABLE and self.walls and self.walls[-1] > at
        return len(self.names) if at < 0 or blocked else at


def _names(value: str) -> set[str]:
    """Words of a class or id, but for names of a state."""
    words = (set(_WORD.findall(name)) for name in value.split())
    return set().union(*(w for w in words if not w & STATE_WORDS))


def _named(attrs: str, names: set[str]) -> bool:
    return any(name.lower() in ("class", "id") and _names("".join(values).lower()) & names for name, *values in _ATTR.findall(attrs))


class Element:
    """One element that isn't part of a line: why it may be boilerplate, and how much text it holds."""

    __slots__ = ("parent", "reason", "comments", "main", "container", "size")

    def __init__(self, parent: int, reason: str, comments: bool, main: str, container: int, size: int):
        self.parent, self.reason, self.comments, self.main, self.container, self.size = parent, reason, comments, main, container, size


def _reason(tag: str, attrs: str, in_main: bool) -> str:
    """"element", "wrapper" (what may also stand around a whole page), "name" (only a class or an id says so), or nothing."""
    if tag in WRAPPERS:
        return "wrapper"
    if tag in DROP or tag == "header" and not in_main:
        return "element"
    if not attrs or tag in NEVER_DROPPED or tag in VOID:
        return ""
    named = False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return "wrapper"
        if name == "role" and value in DROP_ROLES:
            return "wrapper"
        if name in ("class", "id"):
            words = _names(value)
            named = named or bool(words & DROP_NAMES) or "header" in words and not in_main and tag not in MAIN
    return "name" if named else ""


def _end(page: str, m: re.Match) -> int:
    """The place behind a tag; one that a quote or the page's end cuts short goes on to the next ">"."""
    if page[m.end() - 1] == ">":
        return m.end()
    gt = page.find(">", m.end())
    return gt + 1 if gt >= 0 else len(page)


def parse(page: str) -> tuple[list[tuple[str, int, int, int]], list[Element], list[tuple[int, int, bool]]]:
    """(lines, elements, gaps) in one pass: a line is (text, characters outside links, container, element), a gap
    (lines before it, element, whether it only marks the start or end of an article)."""
    lines: list[tuple[str, int, int, int]] = []
    root = Element(-1, "", False, "", 0, 0)
    elements, gaps = [root], []
    stack, blocks = _Open(), []
    text: list[str] = []
    own: list[str] = []  # the part of the text outside links
    at, links, inside, muted, seen = 0, 0, 0, 0, 0

    def here() -> int:
        """The innermost open element that isn't part of a line."""
        return blocks[-1] if blocks else 0

    def end_line():
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            lines.append((line, len(" ".join(html.unescape("".join(own)).split())), elements[here()].container, here()))
        text.clear()
        own.clear()

    def close(keep: int) -> None:
        nonlocal muted, inside
        for n in stack.cut(keep):
            if n < 0:
                muted -= n == MUTE
                continue
            blocks.pop()
            elements[n].size = seen - elements[n].size
            if elements[n].main:
                gaps.append((len(lines), n, True))
                inside -= 1

    while at < len(page):
        lt = page.find("<", at)
        m = _TAG.match(page, lt) if lt >= 0 else None
        stop = lt if m else len(page) if lt < 0 else lt + 1  # a "<" that opens no tag is text
        if stop > at and not muted:
            text.append(page[at:stop])
            seen += sum(map(len, page[at:stop].split()))
            if not links:
                own.append(page[at:stop])
        if not m:
            at = stop
            continue
        at, tag, closing = _end(page, m), (m[2] or "").lower(), m[1] == "/"
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
                own.append(" ")
            elif tag == "a":
                links = max(0, links + (-1 if closing else 1))
            if closing and stack.places.get(tag):
                keep = stack.kept_by_closing(tag)
                if keep < len(stack.names) - 1:
                    end_line()
                close(keep)
            elif not closing and tag not in VOID:
                drop = _reason(tag, m[3], inside > 0) != ""
                if drop or stack.places.get(tag):  # inside a muted element its own name nests
                    stack.push(tag, MUTE if drop else NESTED)
                    muted += drop
            continue
        end_line()
        if not closing and tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if muted and tag in MAIN and not closing:  # a line's element that was never closed doesn't hold an article
            close(stack.numbers.index(MUTE))
        close(stack.kept_by_closing(tag) if closing else stack.kept_by_opening(tag))
        links = 0  # a link that isn't closed ends with its block
        if closing or tag in VOID:
            continue
        up = here()
        reason, main = _reason(tag, m[3], inside > 0), tag if tag in MAIN else ""
        container = elements[up].container if tag in FLOW or tag in ("html", "body") else len(elements)
        elements.append(Element(up, reason, reason == "name" and _named(m[3], COMMENT_NAMES), main, container, seen))
        stack.push(tag, len(elements) - 1)
        blocks.append(len(elements) - 1)
        if reason or main:
            gaps.append((len(lines), len(elements) - 1, False))
        inside += bool(main)
    end_line()
    close(0)
    root.size = seen
    return lines, elements, gaps


def dropped(elements: list[Element]) -> list[bool]:
    """Which elements are boilerplate or stand in it.  Those that a name or a wrapper's look makes so stay if they hold the page's
    article, or most of its text (of the page's, where none is marked)."""
    barred = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        barred[i] = barred[e.parent] or e.reason == "element" or e.comments
    size = lambda i: elements[i].size
    marks = {kind: max((i for i, e in enumerate(elements) if e.main == kind and not barred[i] and e.reason != "name"), key=size, default=0) for kind in ("article", "main")}
    article = marks["article"] if 2 * size(marks["article"]) >= size(marks["main"]) and marks["article"] else marks["main"] or marks["article"]
    around, i = set(), article
    while article and i >= 0:
        around.add(i)
        i = elements[i].parent
    within, out = [False] * len(elements), [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        within[i] = within[e.parent] or article == i
        holds = i in around or 2 * e.size > (elements[article].size if within[i] else elements[0].size if not article else float("inf"))
        if e.comments:
            holds = 2 * e.size > elements[0].size and (i in around or not article)
        out[i] = out[e.parent] or e.reason == "element" or e.reason != "" and not holds
    return out


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters outside links, within the article, container) of each line; boilerplate leaves WINDOW empty
    lines, unless the lines before and behind it are of the container that it stands in."""
    lines, elements, gaps = parse(page)
    gone = dropped(elements)
    inside = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        inside[i] = not gone[i] and (inside[e.parent] or e.main != "")
    out: list[tuple[str, int, bool, int]] = []
    at = 0
    for upto, i, _ in [*gaps, (len(lines), 0, True)]:
        out += [(text, own, inside[e], container) for text, own, container, e in lines[at:upto] if not gone[e]]
        at = upto
        if elements[i].main and not gone[i]:
            out += [("", 0, False, -1)] * WINDOW
        elif gone[i] and not gone[elements[i].parent]:
            out += [("", 0, False, elements[elements[i].parent].container)] * WINDOW
    return _without_inner_gaps(out)


def _without_inner_gaps(lines: list[tuple[str, int, bool, int]]) -> list[tuple[str, int, bool, int]]:
    """The lines without the gaps that stand within one container's text."""
    out: list[tuple[str, int, bool, int]] = []
    gap: list[tuple[str, int, bool, int]] = []
    before = -1
    for line in lines:
        if not line[0]:
            gap.append(line)
            continue
        if any(x[3] != before or x[3] != line[3] for x in gap):
            out += gap
        gap, before = [], line[3]
        out.append(line)
    return out + gap


def regions(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Lines [start, end) from each surge to its dive, without lines of length zero at either end."""
    n = len(lengths)
    run = [0]
    for x in lengths:
        run.append(run[-1] + x)
    sums = [run[min(n, i + window)] - run[i] for i in range(n)]
    need = min(surge, max(sums, default=0))
    out, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        start = i
        while i < n and sums[i]:
            i += 1
        if need and max(sums[start:i]) >= need:
            end = i
            while not lengths[start]:
                start += 1
            while not lengths[end - 1]:
                end -= 1
            out.append((start, end))
    return out


def weights(lines: list[tuple[str, int, bool, int]], surge: int = SURGE) -> list[int]:
    """What each line adds to a window: its characters outside links.  On a page that marks its article a line
    within the mark weighs a surge more than all its characters, and one outside it a small part of its own."""
    marked = any(line[2] and line[0] for line in lines)
    return [0 if not text else surge + len(text) if inside else own // OUTSIDE_PART if marked else own for text, own, inside, _ in lines]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = lines_of(page or "")
    kept = regions(weights(lines, surge), window, surge)
    places = {i for a, b in kept for i in range(a, b)}
    # short lines and lines of links belong to the text that surges in their container
    texts = {lines[i][3] for i in places if lines[i][0]} - {0}
    return "\n".join(line[0] for i, line in enumerate(lines) if line[0] and (i in places or line[3] in texts))


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x, window, surge) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
