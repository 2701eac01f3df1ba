"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element gives one line. Lines inside
containers that are never part of an article (navigation, page header and footer,
sidebars, notices, adverts, forms, comments, scripts, styles) count as empty. The
text lengths of the lines, summed over a sliding window, form blocks: a region
surges where a block leaves zero and dives where the blocks are zero again. The
text between surge and dive is kept whole for the region with the largest block
and for those whose largest block comes near it (an article cut by an insert), or
whose lines stand beside its lines (a headline cut off by adverts). Lines that are
only links have no length, so menus without a name end a region too.

Inside an article element such containers are taken out without cutting it, and
text outside of it counts only where no article text is found. Side containers can
be wrappers (a form around the page, a class such as ``menu-layout``): see
:func:`counted`. Comments, adverts and notices never are.

Defined results: NULL or empty html, and pages without article text, give the
empty string; broken or cut markup is read as far as it goes; of equally heavy
regions the first wins; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCK_LINES = 3  # lines summed to one block
PEAK_SHARE = 0.3  # of the largest block that another region's block must reach

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section select "
    "summary table tbody td template textarea tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("head nav menu dialog button select".split())
SIDE = frozenset("header footer aside form fieldset".split())  # may also wrap the page
FORMS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
MAIN = frozenset("article main".split())
# Words of class, id and role that name containers outside the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside widget related recommended footer masthead header topbar cookie cookies consent notice notices alert "
    "popup modal overlay newsletter subscribe signup login share sharing social comment comments comentarios kommentare disqus reply "
    "replies discussion copyright pagination pager toolbar search contentinfo complementary banner".split()
)

REMARKS = frozenset("comment comments comentarios kommentare reply replies discussion disqus".split())
HEADS = frozenset("header masthead banner".split())
# Containers of these never wrap an article.
FOREIGN = REMARKS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices alert "
    "popup modal overlay newsletter subscribe signup login related recommended copyright".split()
)
STATES = frozenset("has have with without no not is hide show js".split())  # first words of names that describe, not name
MOST_WRAPPERS = 8  # side containers inside each other that are told apart

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class Open(NamedTuple):
    """An open element and what it hands down."""

    name: str
    hidden: bool = False  # never article text
    sides: tuple[int, ...] = ()  # side containers around it
    main: bool = False
    link: bool = False
    block: int = 0  # the innermost block element and the one around it
    around: int = 0
    tag: str = ""  # name of that block element


class Line(NamedTuple):
    text: str
    hidden: bool
    sides: tuple[int, ...]
    main: bool
    links_only: bool
    around: int
    tag: str


def hints_of(attributes: str) -> dict[str, bool]:
    """Words of class, id and role, and whether one is a whole name; names that describe a state (``has-sidebar``) give none."""
    words: dict[str, bool] = {}
    for values in NAMED.findall(attributes):
        for name in "".join(values).split():
            parts = WORD.findall(CAMEL.sub("-", name).lower())
            if parts and parts[0] not in STATES:
                words |= {part: words.get(part, False) or len(parts) == 1 for part in parts}
    return words


def role_of(name: str, attributes: str, in_main: bool) -> str:
    """``hidden``, ``foreign``, ``side`` or ``layout`` for elements without article text, else nothing.

    A side container may wrap an article element, a layout container any text.
    Inside the article its own header holds the headline.
    """
    if name in BOILERPLATE:
        return "hidden"
    found: dict[str, bool] = {}
    if attributes and name not in ("body", "html"):
        if HIDDEN.search(attributes):
            return "hidden"
        hints = REMARKS if name in MAIN else HINTS - HEADS if in_main else HINTS
        found = {word: whole for word, whole in hints_of(attributes).items() if word in hints}
    if not FOREIGN.isdisjoint(found):
        return "foreign"
    if any(found.values()) or name in SIDE - FORMS and not (name == "header" and in_main):
        return "side"
    return "layout" if found or name in FORMS else ""


def lines_of(page: str) -> tuple[list[Line], dict[int, str]]:
    """One line per block element in page order, and the roles of the containers that may be wrappers, by number."""
    lines: list[Line] = []
    parts: list[str] = []
    stack = [Open("")]
    names: Counter[str] = Counter()
    wrappers: dict[int, str] = {}
    linked = number = at = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if stack[-1].link:
            linked += len("".join(text.split()))

    def close_line() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                top = stack[-1]
                lines.append(Line(text, top.hidden, top.sides, top.main, linked >= len("".join(raw.split())), top.around, top.tag))
            parts.clear()
        linked = 0

    while True:
        found = TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        if found[1] is not None:
            add(html.escape(found[1]))
        if not found[3]:
            continue
        name = found[3].lower()
        if name in BLOCKS:
            close_line()
        if found[2]:
            while names[name]:
                top, below = stack[-1], stack[-2]
                if (top.hidden, top.sides) != (below.hidden, below.sides):
                    close_line()
                stack.pop()
                names[top.name] -= 1
                if top.name == name:
                    break
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not found[4].endswith("/"):
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].name == name:
                stack.pop()
                names[name] -= 1
            up, number = stack[-1], number + 1
            role = role_of(name, found[4], up.main)
            sides = up.sides
            if role in ("foreign", "side", "layout") and len(sides) < MOST_WRAPPERS:
                sides = (*sides, number)
                if role != "foreign":
                    wrappers[number] = role
            hidden = up.hidden or role == "hidden"
            if (hidden, sides) != (up.hidden, up.sides):
                close_line()
            block, around, tag = (number, up.block, name) if name in BLOCKS else (up.block, up.around, up.tag)
            stack.append(Open(name, hidden, sides, up.main or name in MAIN, up.link or name == "a", block, around, tag))
            names[name] += 1
    close_line()
    return lines, wrappers


def counted(lines: list[Line], wrappers: dict[int, str]) -> list[bool]:
    """Whether a line is article text; wrappers are passed over.

    A container wraps the page if no article element outside of such containers has
    text and it holds most of the article elements' text, or, on pages without them,
    if it is a layout container with most of the text (nearly all where other text is left).
    """
    plain = [not line.hidden and not line.sides for line in lines]
    if any(c and line.main for c, line in zip(plain, lines)):
        return plain
    for main, roles, share in ((True, ("side", "layout"), 0.5), (False, ("layout",), 0.9 if any(plain) else 0.5)):
        may = {number for number, role in wrappers.items() if role in roles}
        possible = [line for line in lines if not line.hidden and may.issuperset(line.sides) and (line.main or not main)]
        held: Counter[int] = Counter()
        for line in possible:
            held.update(dict.fromkeys(line.sides, len(line.text)))
        most = {side for side, length in held.items() if length > share * sum(len(line.text) for line in possible)}
        if most:
            return [not line.hidden and most.issuperset(line.sides) for line in lines]
    return plain


def main_text(page: str | None, block_lines: int = BLOCK_LINES) -> str:
    """The text between surges and dives of the line blocks."""
    lines, wrappers = lines_of(page or "")
    counts = counted(lines, wrappers)
    main = any(c and line.main for c, line in zip(counts, lines))
    if main:  # what stands inside the article but is no text of it does not cut it
        taken = [(line, c) for line, c in zip(lines, counts) if c or not line.main]
        lines, counts = [t[0] for t in taken], [t[1] and t[0].main for t in taken]
    lengths = np.array([len(line.text) * (c and (main or not line.links_only)) for line, c in zip(lines, counts)], np.int64)
    if not lengths.any():
        return ""
    blocks = np.convolve(lengths, np.ones(block_lines, np.int64))[block_lines - 1 :]  # of a line and those after it
    blocks = np.concatenate([blocks, np.zeros(block_lines, np.int64)])[: len(lengths)]
    busy = np.concatenate([[False], blocks > 0, [False]])
    surges, dives = np.flatnonzero(busy[1:] & ~busy[:-1]), np.flatnonzero(~busy[1:] & busy[:-1])
    regions = []
    for surge, dive in zip(surges, dives):
        text = surge + np.flatnonzero(lengths[surge:dive])
        regions.append((int(blocks[surge:dive].max()), range(text[0], text[-1] + 1)))
    largest = max(peak for peak, _ in regions)
    heavy = [region for peak, region in regions if peak >= PEAK_SHARE * largest]
    beside = {(lines[i].around, tag) for region in heavy for i in region if lengths[i] for tag in (lines[i].tag, *HEADINGS)}
    kept = []
    for peak, region in regions:
        if peak >= PEAK_SHARE * largest or any((lines[i].around, lines[i].tag) in beside for i in region if lengths[i]):
            kept += [lines[i].text for i in region if counts[i]]
    return " ".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; other columns are not read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [main_text(page) for page in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
