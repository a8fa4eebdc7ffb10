"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block element. Menus, forms, scripts and other furniture by their tags leave blank lines
where they stood; links count little, and lengths are summed over windows of lines that slide down the page. A region begins
where these sums surge and ends where they dive again; at its edges lines of links and rights go, and it begins with the
page's title if that is among its first lines. The text is the regions whose sums rise high enough.

Elements say how to read the sums. Inside article and main elements sums count twice, and they are kept whole with what
stands in one container with them, unless a region outside rises above all regions inside: then only the elements with a
high region. A class or id that names furniture takes an element's text out of the sums, unless it wraps an article or main
element or as much text as to be the story itself; only comments are no story at any length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ripplemark.llm.shared import map_batches

#: Lines of a window, the sum that a region has to reach, the one under which it ends, and how much more sums count inside
#: article and main.
WINDOW, SURGE, DIVE, BONUS = 3, 86, 30, 2
#: Characters from which a named element can be the story, if they are half of what isn't named at least.
STORY = 4 * SURGE
#: Most links a line may have, as a share of its characters, to count as text.
MOST_LINKS = 0.5

# Fixed values of HTML: elements by kind.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "xmp"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "input", "label",
             "fieldset", "head", "audio", "video"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", "tt", "u", "var", "wbr", "picture", "source", "input", "label", "button", "select", "map", "area"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A paragraph is open until one of these begins.
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2",
                  "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: An item is open until its like begins.
ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"table", "ul", "ol", "dl", "html", "body", "article", "section"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "td", "th", "table"}
#: Words of class and id that name furniture, and those of comments; a name that says whether something else is there
#: or how it is shown (has-sidebar, no-share, header-fixed) is none.
NAMED = re.compile(
    r"(?:^|[_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|banner|breadcrumbs?"
    r"|cookies?|consent|gdpr|notices?|alert|footer|footnav|header|masthead|menus?|nav|navbar|navigation|newsletter|subscribe"
    r"|pagination|pager|popup|modal|overlay|promo|related|recommended|search|share|sharing|sidebar|sidenav|skip|social"
    r"|toolbar|widget|contentinfo|complementary|login|signup)(?=$|[_-])", re.IGNORECASE)
COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|respond|replies|disqus)(?=$|[_-])", re.IGNORECASE)
TELLS = re.compile(
    r"^(?:has|no|not|with|without|is|show|hide)[_-]|[_-](?:none|open|opened|closed|fixed|sticky|on|off|hidden|visible|enabled"
    r"|disabled|active|inactive|left|right)$", re.IGNORECASE)
#: Roles of furniture.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "toolbar", "dialog", "alert", "form"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a line about rights has.
RIGHTS = re.compile(r"[©®]|\(c\) ?\d{4}|\bcopyright\b|\brights reserved\b|\balle rechte\b|\btous droits\b|\bderechos reservados\b", re.IGNORECASE)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)


def _reading(name: str, attributes: str) -> str:
    """``gone`` for an element without main text, ``comments`` or ``named`` for one by its names, else empty."""
    if name in FURNITURE:
        return "gone"
    if not attributes or name in ("html", "body", "article", "main"):
        return ""
    found = ""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in ROLES:
            return "gone"
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return "gone"
        for word in value.split() if key in ("class", "id") else ():
            if not TELLS.search(word):
                found = "comments" if found == "comments" or COMMENTS.search(word) else "named" if found or NAMED.search(word) else ""
    return found


class Line(NamedTuple):
    """Text of a block, its characters inside links, its outermost article or main (0: none), its container, the elements
    around it that are named as furniture, and whether it is a heading."""

    text: str = ""
    linked: int = 0
    article: int = 0
    container: int = 0
    named: tuple[int, ...] = ()
    heading: bool = False

    @property
    def weight(self) -> int:
        """Characters that count as text: none for a line of links or rights."""
        return len(self.text) if self.linked <= MOST_LINKS * len(self.text) and not RIGHTS.search(self.text) else 0


class _Page:
    """The lines of a page as its tags open and close."""

    def __init__(self):
        self.lines: list[Line] = []
        self.pieces: list[str] = []
        self.linked = 0
        self.title = ""
        self.open: list[tuple[str, str]] = []  # name, reading
        self.containers, self.made = [0], 0
        self.named: list[int] = []
        self.names: list[tuple[bool, bool]] = []  # comments, around an article
        self.skipped = self.articles = self.links = self.outermost = self.headings = 0

    def text(self, raw: str) -> None:
        if raw and not self.skipped:
            piece = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(piece)
            if self.links:
                self.linked += len("".join(piece.split()))

    def line(self) -> None:
        if self.pieces:
            if text := " ".join("".join(self.pieces).split()):
                self.lines.append(Line(text, self.linked, self.outermost if self.articles else 0, self.containers[-1],
                                       tuple(self.named), self.headings > 0))
            self.pieces, self.linked = [], 0

    def gap(self) -> None:
        self.line()
        self.lines += [Line()] * WINDOW

    def push(self, name: str, reading: str) -> None:
        if reading or name in ("article", "main") and not self.skipped:
            self.gap()
        self.open.append((name, reading))
        if name in CONTAINERS:
            self.made += 1
            self.containers.append(self.made)
        self.skipped += reading == "gone"
        if reading in ("named", "comments"):
            self.named.append(len(self.names))
            self.names.append((reading == "comments", False))
        self.links += name == "a"
        self.headings += name in HEADINGS
        if name in ("article", "main"):
            self.outermost += not self.articles
            self.articles += 1
            for k in self.named if not self.skipped else ():
                self.names[k] = (self.names[k][0], True)

    def pop(self) -> None:
        name, reading = self.open.pop()
        if name in CONTAINERS:
            self.line()
            self.containers.pop()
        if reading or name in ("article", "main"):
            self.gap()
        self.skipped -= reading == "gone"
        if reading in ("named", "comments"):
            self.named.pop()
        self.links -= name == "a"
        if name in HEADINGS:
            self.line()
            self.headings -= 1
        self.articles -= name in ("article", "main")

    def close(self, names: set[str], within: set[str]) -> None:
        """Closes the innermost of ``names`` that no element of ``within`` shields."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                while len(self.open) > k:
                    self.pop()
                return
            if self.open[k][0] in within:
                return


def read_page(page: str) -> _Page:
    """The page stripped to lines; blank ones where furniture stood and at the edges of articles and named elements."""
    state = _Page()
    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            state.text(page[at:])
            break
        token = _TOKEN.match(page, start)
        if token is None:
            if page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] == "/":
                end = page.find(">", start)  # a broken tag, to its end or the page's
                state.text(page[at:start])
                at = n if end < 0 else end + 1
            else:
                state.text(page[at : start + 1])
                at = start + 1
            continue
        state.text(page[at:start])
        at = token.end()
        name = token[2].lower() if token[2] else None
        if name is None:
            continue
        if token[1]:
            if name not in INLINE:
                state.line()
            elif name == "br":
                state.text(" ")
            state.close({name}, set() if name not in INLINE else ENDS_PARAGRAPH - {"p"})
            continue
        if name in RAW and not token[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            if name not in INLINE:
                state.line()
            if name == "title" and not state.title:
                state.title = " ".join(html.unescape(page[at : end.start() if end else n]).split())
            at = end.end() if end else n
            continue
        if name == "br":
            state.text(" ")
        elif name not in INLINE:
            state.line()
        if name == "body":
            state.close({"head"}, set())
        if name in ENDS_PARAGRAPH:
            state.close({"p"}, {"table", "td", "th", "button", "object", "caption"})
        if name in ENDS_LIKE:
            state.close(ENDS_LIKE[name], SCOPE - {name})
        if name not in VOID:
            state.push(name, _reading(name, token[3]))
    state.line()
    return state


def _named_furniture(lines: list[Line], names: list[tuple[bool, bool]]) -> set[int]:
    """Which named elements are furniture: all but those around an article, and those that hold a story."""
    left = {k for k, (_, around) in enumerate(names) if not around}
    held = dict.fromkeys(left, 0)
    for line in lines:
        for k in line.named:
            if k in held:
                held[k] += line.weight
    for k in sorted((k for k in left if not names[k][0]), key=lambda k: -held[k]):
        base = sum(line.weight for line in lines if left.isdisjoint(line.named)) if held[k] >= STORY else 0
        if held[k] >= STORY and 2 * held[k] >= base:
            left.discard(k)
    return left


def _is_title(line: Line, title: str) -> bool:
    """Whether a line is the page's title, or the part of it before or behind a separator."""
    return len(line.text) > 3 and (line.text == title or line.text in re.split(r" [|\-–—·:»] ", title))


def _trimmed(lines: list[Line], first: int, last: int, title: str) -> tuple[int, int]:
    """A region outside articles without the lines at its edges that are no text, from the title if it is near the top."""
    weight = [line.weight for line in lines[first:last]]
    there = [k for k, w in enumerate(weight) if w]
    full = [k for k in there if weight[k] >= SURGE]
    top, bottom = (full or there)[0], (full or there)[-1]
    begin = next((k for k in range(0, min(len(weight), max(top, bottom if not full else 0, 2 * WINDOW) + 1)) if _is_title(lines[first + k], title)), None)
    if begin is None:
        begin = top
        while begin > 0 and weight[begin - 1]:
            begin -= 1
    while bottom + 1 < len(weight) and weight[bottom + 1]:
        bottom += 1
    return first + begin, first + bottom + 1


def main_text(page: str | None) -> tuple[str, int]:
    """Text of the page's regions, blocks joined by an empty line, and how many regions there are.

    If no region reaches the mark, the one with most text is taken, of equal ones the first.
    """
    state = read_page(page or "")
    gone = _named_furniture(state.lines, state.names)
    lines = [line if gone.isdisjoint(line.named) else Line() for line in state.lines]
    if gone and not any(line.weight for line in lines):  # nothing but furniture: then that
        lines = state.lines
    weight = [line.weight for line in lines]
    sums = [sum(weight[k : k + WINDOW]) for k in range(len(lines))]
    regions: list[tuple[int, int]] = []
    k = 0
    while k < len(lines):
        if not weight[k]:
            k += 1
            continue
        # lines of text follow each other; inside an article nothing but a gap ends them, elsewhere sums that dive
        end, inside = k, lines[k].article
        while end < len(lines) and lines[end].text and lines[end].article == inside and (inside or max(
                sums[max(0, end - WINDOW + 1) : end + 1]) >= DIVE):
            end += 1
        end = max(end, k + 1)
        first = k
        if inside:
            while first > 0 and lines[first - 1].text and lines[first - 1].article == inside:
                first -= 1
        regions.append((first, end) if inside else _trimmed(lines, first, end, state.title))
        k = end
    # gaps at the edges of articles keep a region on one side of them
    inside = [any(lines[j].article for j in range(*r)) for r in regions]
    peaks = [max(sum(weight[j : min(j + WINDOW, r[1])]) for j in range(*r)) * (BONUS if i else 1) for r, i in zip(regions, inside, strict=True)]
    outdone = max((p for p, i in zip(peaks, inside, strict=True) if not i), default=0) > max(SURGE, *(
        p for p, i in zip(peaks, inside, strict=True) if i), 0)
    high = [r for r, i, p in zip(regions, inside, peaks, strict=True) if p >= SURGE or i and not outdone]
    if not high and regions:
        high = [max(regions, key=lambda r: sum(weight[r[0] : r[1]]))]
    # what furniture cuts off from such a region, in the same container or article, is short but belongs to it
    near = {lines[j].container for r in high for j in range(*r) if lines[j].text}
    whole = {lines[j].article for r in high for j in range(*r) if lines[j].article}
    tops = set(high)
    chosen = [r for r in regions if r in tops or any(
        lines[j].container in near or lines[j].article in whole for j in range(*r) if lines[j].text)]
    kept = [lines[j].text for r in chosen for j in range(*r) if lines[j].text]
    return "\n\n".join(kept), len(chosen)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            found = [main_text(page) for page in some.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [some.column("page_id").cast(pa.int64()), some.column("url").cast(pa.string()),
                 pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()),
                 pa.array([r for _, r in found], pa.int32())],
                names=["page_id", "url", "text", "n_chars", "n_regions"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_regions) for every row of ``pages(page_id, url, html)``.

    Character references are decoded, white space inside a block becomes one space. Null or empty html, and pages
    without text, give an empty text and no region. Every row stays, repeated ones too; other columns are not read. Of
    regions that tie for the place of the only one, the first is taken.
    """
    return map_batches(
        pages.select("page_id", "url", "html"), _extract, "page_id long, url string, text string, n_chars long, n_regions int")
