"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one for each block element; parts that are never article text (scripts, forms, navigation,
what a class, id or role names as an advert, menu, notice or the like) are stripped with it. A line weighs its characters
outside links; elements for prose and being inside an article add less than a window needs, for all its lines together. A
block that is named as no text but holds most of the page's prose, with its heading or all there is, is text. Weights are summed over
sliding windows of lines; where the sum surges the text starts, where it dives it ends, and the lines between are kept.
Of what is kept, lines outside an article go only if those inside hold most of the characters.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3  # lines whose weights are summed
SURGE = 90  # weight of a window in which text starts
PROSE = 17  # weight of an element for prose, besides its characters
INSIDE = 12  # weight of being inside an article; for all lines of a window tags alone weigh less than SURGE

# The elements and words of page structure.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp".split())
DROPPED = frozenset("head nav footer aside form button select option menu dialog object canvas audio video label fieldset datalist".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd".split())
TITLED = frozenset("section h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
NOT_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion sponsor sponsored sponsors sidebar sidenav menu menus nav"
    " navbar navigation breadcrumb breadcrumbs footer foot masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe"
    " subscription signup login share sharing social comment comments disqus reply replies respond related recommended recommendations widget widgets toolbar"
    " pagination pager search legal copyright disclaimer hidden topbar".split()
)
#: Of these, words that also name subjects: at the head of a longer name they count only before a word for a part of a page.
SUBJECTS = frozenset(
    "ad banner banners promotion foot notice notices popup modal overlay subscription share sharing social comment comments reply replies related recommended recommendations"
    " search legal copyright disclaimer hidden login signup consent menu menus navigation widget widgets".split()
)
PARTS = frozenset(
    "area articles bar block body box buttons button container content contents footer form header icons info inner items label link links list listing news note outer panel posts"
    " row section slot stories text title top unit wrap wrapper".split()
)
MODIFIERS = frozenset("has have no not with without is".split())
NOT_TEXT_OUTSIDE = frozenset("header head site-header".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

_TAG = re.compile(r"</?[a-zA-Z][^\s/>]*")
_QUOTED_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Element:
    name: str
    dropped: bool
    inside: bool
    link: bool
    named: int = -1  # the innermost block around it that is named as no text, by number


class Block:
    """An open block element and the inline elements that are open in it."""

    def __init__(self, element: Element, prose: bool):
        self.element, self.prose = element, prose
        self.inline: list[Element] = []
        self.names: Counter = Counter()

    def top(self) -> Element:
        return self.inline[-1] if self.inline else self.element

    def open(self, element: Element) -> None:
        self.inline.append(element)
        self.names[element.name] += 1

    def close(self, name: str) -> None:
        """Up to the nearest inline element of that name; nothing if there is none."""
        while self.names[name]:
            gone = self.inline.pop().name
            self.names[gone] -= 1
            if gone == name:
                return


@dataclass
class Line:
    text: str
    links: int
    prose: bool
    inside: bool
    named: int = -1

    def weight(self) -> int:
        own = len(self.text) - 2 * self.links
        if own <= 0 and not (self.inside and self.prose):
            return 0
        return max(own, 0) + PROSE * self.prose + INSIDE * self.inside


def _names_no_text(value: str, inside: bool) -> bool:
    """If a class or id names what is never text: as a whole, by its last part, or by its first one."""
    for token in value.split():
        words = [w.lower() for w in _NAME.findall(token)]
        if not words or words[0] in MODIFIERS and len(words) > 1:  # has-sidebar tells of another element
            continue
        if words[0] in NOT_TEXT and (len(words) == 1 or words[0] not in SUBJECTS or any(w in PARTS or w in NOT_TEXT or len(w) < 2 for w in words[1:])):
            return True
        if words[-1] in NOT_TEXT or not inside and NOT_TEXT_OUTSIDE.intersection(words):
            return True
    return False


def _never_text(name: str, inside: bool) -> bool:
    return name in DROPPED and name != "form" or name == "header" and not inside


def _names_none(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's name, role, style, class or id says that it is no article text."""
    if name == "form":
        return True
    for key, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value.lower() in NOT_TEXT_ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            if key == "id" and inside and name in TITLED:  # made from a title
                continue
            if _names_no_text(value, inside):
                return True
    return False


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", its text, ""), ("open", name, attributes) and ("close", name, ""), in time linear in the page's length.

    A quote in a tag that isn't closed before the last > is an ordinary character. A tag without an end is dropped, with all
    after it; so is an unclosed comment. What looks like a tag but isn't one is text.
    """
    at, n, last, cdata, low = 0, len(page), page.rfind(">"), True, None
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], ""
            return
        following = page[start + 1 : start + 2]
        found = _TAG.match(page, start) if following == "/" or following.isalpha() else None
        if not found and following not in ("!", "?") and not (following == "/" and start + 2 < n):
            yield "text", page[at : start + 1], ""
            at = start + 1
            continue
        if start > at:
            yield "text", page[at:start], ""
        if not found:  # a comment, a declaration or the like
            end = -1
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = n if end < 0 else end + 3
                continue
            if cdata and page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                cdata = end >= 0
            at = end + 3 if end >= 0 else (page.find(">", start) + 1 or n)
            continue
        end = found.end()
        while True:
            sign = _QUOTED_OR_END.search(page, end) if end <= last else None
            if sign is None:
                return
            end = sign.end()
            if sign[0] == ">":
                break
            close = page.find(sign[0], end)
            if 0 <= close < last:
                end = close + 1
        name = found[0].strip("</").lower()
        at = end
        if found[0].startswith("</"):
            yield "close", name, ""
            continue
        yield "open", name, page[found.end() : end - 1]
        if name in RAW:  # its content isn't markup
            low = page.lower() if low is None else low
            end = low.find(f"</{name}", at)
            if end < 0 or (at := page.find(">", end) + 1) == 0:
                return


def page_lines(page: str) -> list[Line]:
    """A line for each block with text, without what is never article text."""
    blocks, opened, lines = [Block(Element("", False, False, False), False)], Counter(), []
    parts: list[tuple[str, bool]] = []
    prose = False
    around: list[int] = []  # of each block that is named as no text, the one around it
    headed: list[bool] = []  # whether it has the page's heading or main part

    def end_line() -> None:
        nonlocal prose
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            links = len(" ".join("".join(t for t, a in parts if a).split()))
            lines.append(Line(text, links, prose, blocks[-1].element.inside, blocks[-1].element.named))
        parts.clear()
        prose = False

    def end_block() -> str:
        name = blocks.pop().element.name
        opened[name] -= 1
        return name

    for kind, name, attributes in _tokens(page):
        block = blocks[-1]
        above = block.top()
        if kind == "text":
            if not above.dropped:
                parts.append((entities.unescape(name), above.link))
                prose |= block.prose and bool(name.strip())
            continue
        if name in BLOCKS:
            end_line()
        elif name == "br":
            parts.append((" ", False))
        if kind == "close":
            if name not in BLOCKS:  # an inline end tag doesn't close blocks
                block.close(name)
            elif opened[name]:
                while end_block() != name:
                    pass
            continue
        if name in RAW or name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in BLOCKS:  # ends an open paragraph or heading, a list item the one before
            own = block.element.name
            if own in CLOSED_BY_BLOCK or name == own == "li" or name in ("dt", "dd") and own in ("dt", "dd"):
                end_block()
                block = blocks[-1]
                above = block.top()
        never = above.dropped or _never_text(name, above.inside)
        none = not never and _names_none(name, attributes, above.inside)
        element = Element(name, never or none and name not in BLOCKS, above.inside or name in ("article", "main"), above.link or name == "a", above.named)
        if none and name in BLOCKS:
            around.append(above.named)
            headed.append(False)
            element.named = len(around) - 1
        if name in ("h1", "main") and not element.dropped and element.named >= 0:
            headed[element.named] = True
        if name in BLOCKS:
            blocks.append(Block(element, block.prose or name in PROSE_BLOCKS))
            opened[name] += 1
        else:
            block.open(element)
    end_line()
    return _of_text(lines, around, headed)


def _of_text(lines: list[Line], around: list[int], headed: list[bool]) -> list[Line]:
    """Lines outside the blocks that are named as no text, but for blocks with over half of the page's prose: these are
    text if they have its heading, or nine tenths of the prose."""
    own = [0] * len(around)
    total = 0
    for x in lines:
        n = (x.prose or x.inside) * max(0, len(x.text) - x.links)
        total += n
        if x.named >= 0:
            own[x.named] += n
    for k in range(len(around) - 1, -1, -1):  # inner ones come after those around them
        if around[k] >= 0:
            own[around[k]] += own[k]
            headed[around[k]] |= headed[k]
    gone: list[bool] = []
    for k, up in enumerate(around):
        text = 2 * own[k] > total and (headed[k] or 10 * own[k] >= 9 * total)
        gone.append(not text or up >= 0 and gone[up])
    return [x for x in lines if x.named < 0 or not gone[x.named]]


def window_sums(weights: list[int]) -> list[int]:
    """Sums of the windows that end at each line, and of those that reach beyond the last one."""
    before = [0, *accumulate(weights)]
    return [before[min(k + 1, len(weights))] - before[max(0, k - WINDOW + 1)] for k in range(len(weights) + WINDOW - 1)]


def main_text(page: str) -> str:
    """The lines between surge and dive points, joined by line breaks; empty if there is no such text."""
    lines = page_lines(page)
    weights = [x.weight() for x in lines]
    sums = window_sums(weights)
    keep = [False] * len(lines)
    # Where nothing surges, the heaviest window is the text.
    surge = min(SURGE, max(sums, default=0)) or SURGE
    k = 0
    while k < len(sums):
        if sums[k] < surge:
            k += 1
            continue
        start = max(0, k - WINDOW + 1)
        while k < len(sums) and sums[k] >= surge:
            k += 1
        end = min(len(lines), k)
        span = [i for i in range(start, end) if weights[i]]
        firm = [i for i in span if lines[i].prose or lines[i].inside or weights[i] >= SURGE]
        between = range(firm[0], firm[-1] + 1) if firm else ()
        if firm:  # a short line that isn't prose, before or after all that is firm, is outside
            span = [i for i in span if firm[0] <= i <= firm[-1]]
        for i in range(span[0], span[-1] + 1):  # lines without weight at the borders are before the surge or after the dive
            keep[i] = bool(weights[i]) or lines[i].inside or lines[i].prose and i in between
    kept = [x for x, k in zip(lines, keep, strict=True) if k]
    inside = sum(len(x.text) for x in kept if x.inside)
    if 2 * inside >= sum(len(x.text) for x in kept):
        kept = [x for x in kept if x.inside] or kept
    return "\n".join(x.text for x in kept)


def extract_text(pages: DataFrame, html_col: str = "html", to: str = "main_text") -> DataFrame:
    """The rows of pages with their main text in a column `to` (replacing one of that name).

    A null or empty page, and one without text outside links, has the empty text. Broken markup is read as far as it goes:
    unclosed elements end with their parents, an unfinished tag at the end is dropped, a quote without its end is an ordinary
    character. Pages of any length are read whole, in time linear in their length; nothing is shuffled or gathered. Rows that
    repeat get equal texts; an empty table gives no rows. An element goes with all in it if its name, role or style, or a
    whole class or id (`share-buttons`, not `share-price`) names it as what is never article text; a block so named that
    holds most of the page's prose stays (a form around the page, `class="page search"`).
    """

    @F.pandas_udf("string")
    def text(page: pd.Series) -> pd.Series:
        return page.map(lambda p: main_text(p or ""))

    return pages.withColumn(to, text(F.col(html_col).cast("string")))
