"""Main text of web pages: two passes of block rules over what the page's structure leaves.

A page is read once, from left to right, into blocks: runs of text between block-level tags, with the letters inside
links and the kind of element around them. Menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are left out by their element or by the names in its class, id and role; where most of a page's text lies in
an article (or main) element, so is what lies outside. The first pass then decides blocks by their length, their
density of stop words and their share of letters in links. Short blocks and those in between stay open: in the second
pass they take over the decision of the nearest decided block. Both passes are array steps over all blocks of a batch.

No page is treated otherwise for its length: an open quote, comment or element costs one search, not one a tag.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import slices
from .kernels import releasing

#: Function words of four languages (fixed values); other languages by parameter, or without stop words.
STOP_WORDS = frozenset(
    """
the of and to in is that for it was on are as with be at by this from have or an not they but which you his had her were their has been its would
de la le les et des en un une du que est pour dans qui par sur pas au plus ne se ce avec il sont ou son sa aux mais nous vous elle
der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am
el los del las una por con para como al lo pero sus este ya entre cuando muy sin sobre ser tiene también me hasta hay donde quien desde
""".split()
)

#: Elements that end a block; those whose content is no text; those that are skipped with all that is in them.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("button canvas datalist object select svg video audio map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a sibling or any block closes when they have no end tag.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}

#: What is known of a place in the page. STICKY holds inside an article too, PLAIN ends where one begins.
DROP, STICKY, PLAIN, ASK, ARTICLE, MAIN, NAMED, HEADING = (1 << k for k in range(8))
STRUCTURE = {"nav": PLAIN, "header": PLAIN, "footer": PLAIN, "menu": PLAIN, "aside": STICKY, "dialog": STICKY, "form": ASK, "search": ASK, "article": ARTICLE, "main": MAIN, **dict.fromkeys(HEADINGS, HEADING), **dict.fromkeys(DROPPED, DROP)}
#: Words of class, id and role that name what is no main text, page headers, and main text (fixed values).
SIDE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification alert
nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar widget widgets related recommended recommendations trending newsletter subscribe signup login signin
share sharing social popup modal overlay toolbar comment comments commentlist disqus replies respond footer contentinfo complementary copyright dialog aside""".split()
)
TOP_NAMES = frozenset("header masthead banner topbar".split())
MAIN_NAMES = frozenset("article articlebody post entry story content main maincontent".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies respond".split())
#: Beginnings of class names that say what the page is about or has, not what the element is.
ABOUT = ("tag-", "category-", "has-", "no-", "with-", "without-", "is-", "post-type-")

OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
END = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?![\w-])", re.IGNORECASE)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
RIGHTS = re.compile(r"\W*(?:©|\(c\)|copyright\b)", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")
SLICE = 1 << 16


@functools.lru_cache(4096)
def place(tag: str, attributes: str) -> int:
    """What a block element's name and attributes say of the text in it."""
    flags = STRUCTURE.get(tag, 0)
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and HIDDEN.search(value)):
            flags |= DROP
        elif key == "itemprop":
            flags |= ARTICLE if value.lower() == "articlebody" else 0
        elif key in ("class", "id", "role"):
            for name in value.split():
                words = {w.lower() for w in NAME.findall(name)}
                if name.lower().startswith(ABOUT) or not words:
                    continue
                if tag in ("html", "body", "article", "main"):
                    flags |= STICKY if words & COMMENT_NAMES and tag != "body" and tag != "html" else 0
                elif words & SIDE_NAMES:
                    flags |= STICKY
                elif words & TOP_NAMES:
                    flags |= 0 if words & MAIN_NAMES else PLAIN
                elif words & {"search", "form"}:
                    flags |= ASK
                elif words <= MAIN_NAMES | {"body", "text", "page", "the", "blog", "news"} and words & MAIN_NAMES:
                    flags |= MAIN if key == "role" else NAMED
    return flags


@dataclass
class Blocks:
    """The blocks of some pages; ``begin``: where each page's begin."""

    texts: list[str] = field(default_factory=list)
    linked: list[float] = field(default_factory=list)
    flags: list[int] = field(default_factory=list)
    begin: list[int] = field(default_factory=lambda: [0])

    def add(self, pieces: list[str], links: list[str], flags: int) -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text and not flags & DROP:
            inside = len(" ".join(entities.unescape(" ".join(links)).split())) if links else 0
            self.texts.append(text)
            self.linked.append(min(1.0, inside / len(text)))
            self.flags.append(flags)

    def read(self, page: str) -> None:
        """Append the blocks of one page."""
        pieces: list[str] = []
        links: list[str] = []
        stack: list[tuple[str, int]] = [("", 0)]
        opened: dict[str, int] = {}
        link_depth, breaks, at, end = 0, 0, 0, len(page)
        lost: set[str] = set()

        def find(what: str, start: int) -> int:
            if what in lost:
                return -1
            k = page.find(what, start)
            if k < 0:
                lost.add(what)
            return k

        def flush() -> None:
            nonlocal breaks
            breaks = 0
            if pieces:
                self.add(pieces, links, stack[-1][1])
                pieces.clear()
                links.clear()

        def pop() -> None:
            nonlocal link_depth
            opened[stack.pop()[0]] -= 1
            if link_depth > len(stack):
                link_depth = 0

        def say(a: int, b: int) -> None:
            nonlocal breaks
            if a < b and not stack[-1][1] & DROP:
                piece = page[a:b]
                pieces.append(piece)
                if not piece.isspace():
                    breaks = 0
                    if link_depth:
                        links.append(piece)

        while at < end:
            m = OPEN.search(page, at)
            if m is None:
                say(at, end)
                break
            say(at, m.start())
            if m[1]:
                k = find("-->", m.end() - 2)
                at = k + 3 if k >= 0 else (page.find(">", m.end()) + 1 or end)
                continue
            at = m.end()
            while True:  # to the tag's end; a ">" inside a quoted value does not count
                e = END.search(page, at)
                if e is None:
                    at = stop = end
                    break
                at = e.end()
                if not e[1]:
                    stop = e.start()
                    break
                k = find(e[1], at)
                at = k + 1 if k >= 0 else at
            if m[2]:
                continue
            tag, closing = m[4].lower(), bool(m[3])
            if tag == "br":
                if breaks:
                    flush()
                else:
                    pieces.append(" ")
                    breaks = 1
            elif tag == "a":
                link_depth = 0 if closing else len(stack)
            elif tag in RAW:
                if not closing and page[stop - 1] != "/":
                    k = re.compile(f"</{tag}", re.IGNORECASE).search(page, at) if tag not in lost else None
                    if k is None:
                        lost.add(tag)
                    at = at if k is None and tag in ("noscript", "template") else end if k is None else k.start()
            elif tag in BLOCK or tag in DROPPED:
                if tag in BLOCK:
                    flush()
                if closing:
                    if opened.get(tag, 0):
                        while stack[-1][0] != tag:
                            pop()
                        pop()
                    continue
                if tag == "hr" or page[stop - 1] == "/" and tag in DROPPED:
                    continue
                while tag in BLOCK and stack[-1][0] in ("p", *HEADINGS, *CLOSES.get(tag, ())):
                    pop()
                outer, own = stack[-1][1] & ~HEADING, place(tag, page[m.end() : stop])
                if own & (ARTICLE | MAIN) and not own & STICKY:
                    outer &= ~(PLAIN | ASK)
                elif outer & (ARTICLE | MAIN) and tag == "header":
                    own &= ~PLAIN
                stack.append((tag, outer | own))
                opened[tag] = opened.get(tag, 0) + 1
        flush()
        self.begin.append(len(self.texts))


def word_counts(text: str, stop: frozenset[str]) -> tuple[int, int]:
    """Words of a text, and those that are stop words; a long text is cut at spaces."""
    words = stops = at = 0
    while at < len(text):
        k = text.find(" ", at + SLICE)
        part = WORD.findall(text[at : k if k >= 0 else len(text)].lower())
        words += len(part)
        stops += sum(w in stop for w in part)
        at = k if k >= 0 else len(text)
    return words, stops


@dataclass(frozen=True)
class Rules:
    """Thresholds of both passes."""

    short: int = 70  # characters below which a block stays open
    stop: float = 0.12  # share of stop words of main text
    no_stop: float = 0.03  # share of a page below which its language has no stop words here
    linked: float = 0.5  # share of linked letters above which a block is a link
    run: int = 3  # links in a row that make a menu, inside an article too
    inside: float = 0.2  # share of the text that an article, main or named element must hold to be the page's text
    stop_words: frozenset[str] = STOP_WORDS


def kept(b: Blocks, rules: Rules = Rules()) -> np.ndarray:
    """Which blocks are main text."""
    n, begin = len(b.texts), np.array(b.begin)
    page = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    size, linked, flags = np.array([len(t) for t in b.texts], np.int64), np.array(b.linked), np.array(b.flags, np.int64)
    side = (flags & (STICKY | PLAIN) > 0) | (flags & ASK > 0) & (flags & (ARTICLE | MAIN) > 0)
    open_text = np.where(side | (linked > rules.linked), 0, size)
    total = np.bincount(page, open_text, len(begin) - 1)
    wrapper = np.bincount(page, np.where(flags & ASK, open_text, 0), len(begin) - 1) > total / 2  # a form around the whole page is none
    flags = np.where(wrapper[page], flags & ~ASK, flags)
    region = np.zeros(n, np.int64)  # the kind of element that holds the page's text
    for kind in (NAMED, MAIN, ARTICLE):
        share = np.bincount(page, np.where(flags & kind, open_text, 0), len(begin) - 1) >= np.maximum(rules.inside * total, 1)
        region[share[page]] = kind
    out = side | (region > 0) & (flags & region == 0)
    # From here on only what the structure leaves.
    left = np.flatnonzero(~out)
    page, size, linked, flags, region = page[left], size[left], linked[left], flags[left], region[left] & (ARTICLE | MAIN)
    counts = np.array([word_counts(b.texts[k], rules.stop_words) for k in left], np.int64).reshape(-1, 2)
    words, stops = counts[:, 0], counts[:, 1]
    per_page = lambda x: np.bincount(page, x, len(begin) - 1)
    has_stops = (per_page(stops) >= rules.no_stop * np.maximum(per_page(words), 1))[page]
    prose = (stops >= rules.stop * np.maximum(words, 1)) | ~has_stops
    is_link = linked > rules.linked
    edge = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (is_link[1:] != is_link[:-1])])) if len(left) else np.zeros(0, np.int64)
    run = np.repeat(np.diff(np.append(edge, len(left))), np.diff(np.append(edge, len(left))))
    rights = np.array([RIGHTS.match(b.texts[k]) is not None for k in left], bool)
    bad = is_link & ((region == 0) | (run >= rules.run)) | ~region.astype(bool) & ((size < rules.short) & (rights | (flags & ASK > 0)) | (size >= rules.short) & ~prose)
    good = ~bad & ~is_link & (size >= rules.short) & prose
    # Second pass: the nearest decided block on either side, on the same page.
    where, decided = np.arange(len(left)), good | bad
    before = np.maximum.accumulate(np.where(decided, where, -1)) if len(left) else where
    after = np.minimum.accumulate(np.where(decided, where, len(left))[::-1])[::-1] if len(left) else where
    has_before, has_after = before >= 0, after < len(left)
    has_before[has_before] = page[before[has_before]] == page[has_before]
    has_after[has_after] = page[after[has_after]] == page[has_after]
    d_before, d_after = np.where(has_before, where - before, 1 << 40), np.where(has_after, after - where, 1 << 40)
    d_before = np.where(flags & HEADING > 0, 2 * d_before, d_before)  # a heading goes with what follows
    from_before, from_after = good[np.maximum(before, 0)] if len(left) else good, good[np.minimum(after, max(len(left) - 1, 0))] if len(left) else good
    taken = np.where(d_before < d_after, from_before, np.where(d_after < d_before, from_after, from_before | from_after))
    taken = np.where(has_before | has_after, taken, True)
    result = np.zeros(n, bool)
    result[left] = np.where(decided, good, taken)
    return result


def main_texts(pages: list[str], rules: Rules = Rules()) -> list[str]:
    """The main text of each page: its blocks in page order, two line breaks between them."""
    b = Blocks()
    for p in pages:
        b.read(p)
    keep = kept(b, rules)
    return ["\n\n".join(b.texts[k] for k in range(i, j) if keep[k]) for i, j in zip(b.begin, b.begin[1:])]


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages (page_id, url, html)``.

    Null and empty html, and pages without main text, give an empty text. Rows that repeat give rows that repeat, null
    ids and urls stay, columns of any other name are not read. Markup may be broken in any way: elements that are not
    closed end where an outer one does. A page of any length is read whole; it and its text must fit in a task.
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 100):
                texts = main_texts([p or "" for p in part.column(2).to_pylist()], rules)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
