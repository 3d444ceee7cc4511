"""Operator 1: main-text extraction from HTML by two-pass block rules.

Pass 1 cuts a page into blocks (text between block-level tags) and classifies each by its place, link density, length and
stop-word density: blocks under flagged elements are bad, so are blocks full of links; long blocks with enough stop
words are good, long ones without are bad; the rest is ambiguous. Pass 2 gives each ambiguous block the label of the
nearest decided block before or after it (a tie: good only if both are). Where a page marks its article (``article`` or
``main``), blocks outside are bad and the ends of the article count as good neighbours, so that its short paragraphs and
headings stay; flagged elements set into it (asides, comments, forms) are no neighbours of its text.

An element is flagged by its tag (menus, headers, footers, asides, forms), role, or a word of its class or id (advert,
notice, sidebar and the like). Such words also stand on what wraps a whole page (``with-sidebar``), and some servers put
whole pages into a form, so a flag is void if the element holds the article: an article element with more text than any
article without flags around it, or, on a page that marks none, more than half of the page's prose. Flags of reader
comments are only void for want of any other article.

Stop words tell nothing about languages that have no list: blocks of other than Latin letters go by length and link
density, and so do all long blocks of an article (or of a page without one) in which no block has enough stop words.

Scripts, styles, comments and the head are no text. Character references are decoded, white space inside a block becomes
one space, blocks are trimmed, empty ones dropped, and joined in page order by one newline. Null or empty html gives the
empty string, an empty table no rows; null ids and urls and repeated rows pass through row by row; columns beyond
page_id, url and html are ignored, whatever their names. Nothing is capped: whole pages, any nesting, unclosed tags, and
the time is linear in a page's length. A tag that never ends is text.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bare, read

# Names of HTML elements by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("nav header footer aside form menu dialog".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe noembed noframes xmp svg title canvas object audio video button select datalist".split())
#: Of these, the ones whose content HTML parses as raw text: without an end tag they reach to the page's end.
TEXT_TAGS = frozenset("script style textarea iframe noembed noframes xmp title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class or id names that mark boilerplate; names are cut at anything but letters and at changes of case.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dropdown footer "
    "header login masthead menu menus modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted recommended related "
    "replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Of these, words for what readers wrote.
READER_NAMES = frozenset("comment comments disqus replies reply respond".split())
#: What an element that is itself called article may be.
COMMENT_NAMES = frozenset("comment comments reply replies related promo sponsored".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
STOP_WORDS = {
    "en": frozenset("the of and to a in is it that for was on are with as be by this at from or an have not but which were when there all".split()),
    "de": frozenset("der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split()),
    "fr": frozenset("de la le et les des en un du une que est pour qui dans par au sur ne se pas plus avec ce il sont aux cette ou son".split()),
    "es": frozenset("de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí".split()),
    "it": frozenset("di che la il un e per una in con non del i le da si al come della è sono dei nel ma gli alla lo più anche ha".split()),
    "pt": frozenset("de que o a e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua".split()),
    "nl": frozenset("de het een van en in is dat op te zijn met voor niet aan er om ook als dan maar bij door uit naar over wordt".split()),
}
ALL_STOP_WORDS = frozenset().union(*STOP_WORDS.values())

MAX_LINK_DENSITY, LONG_CHARS, LOW_STOPS, HIGH_STOPS = 0.33, 70, 0.05, 0.15
GOOD, BAD, OPEN = 1, -1, 0

#: Elements that stay flagged even if they hold most of a page without a marked article.
STRICT_TAGS = CONTAINERS - {"form", "header"}

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STEP = re.compile(r">|=\s*([\"'])")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_LETTERS = re.compile(r"[^\W\d_]")
_NOT_LATIN = re.compile(r"[\u0370-\U0010FFFF]")
_WIDE = re.compile(r"[\u2E80-\uD7FF\uF900-\uFAFF\U00020000-\U0003FFFF]")


def tags_of(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag; comments and declarations have no name, and neither has what
    elements of raw text hold. Each character is looked at a bounded number of times."""
    out: list[tuple[int, int, str, bool, str]] = []
    at, n = 0, len(page)
    unclosed: set[str] = set()  # quotes and end tags that don't occur any more
    while m := _OPEN.search(page, at):
        start = m.start()
        if m[0] == "<!--":
            end = start + 5 if page.startswith(">", start + 4) else page.find("-->", start + 4) + 3
            at = n if end == 2 else end
            out.append((start, at, "", False, ""))
            continue
        pos, end = m.end(), 0
        while step := _STEP.search(page, pos):
            pos = step.end()
            if not step[1]:
                end = pos
                break
            if step[1] not in unclosed:
                close = page.find(step[1], pos)
                if close < 0:
                    unclosed.add(step[1])
                else:
                    pos = close + 1
        if not end:
            break  # the rest is text
        at = end
        if m[0][1] in "!?":
            out.append((start, end, "", False, ""))
            continue
        closing = m[0][1] == "/"
        name = _NAME.match(page, start + 1 + closing)
        tag = name[0].lower()
        out.append((start, end, tag, closing, page[name.end() : end - 1]))
        if tag in TEXT_TAGS and not closing and page[end - 2] != "/":
            close = None if tag in unclosed else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, end)
            if not close:
                unclosed.add(tag)
            at = close.start() if close else end if tag == "title" else n  # a title ends with its head at the latest
            out.append((end, at, "", False, ""))
    return out


def _flag(tag: str, attributes: str, inside: bool) -> str:
    """Why an element is flagged: ``reader``, ``strict``, ``layout``, or empty."""
    if tag in ("body", "html", "main"):
        return ""
    names = COMMENT_NAMES if tag == "article" else BAD_NAMES
    why = ""
    for m in _NAMES.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.strip().lower() in BAD_ROLES:
                why = why or "layout"
            continue
        for w in _WORDS.findall(value):
            if w.lower() in names:
                why = "reader" if w.lower() in READER_NAMES else why or "layout"
    if why == "reader":
        return why
    if tag in CONTAINERS and not (tag == "header" and inside):
        return "strict" if tag in STRICT_TAGS else "layout"
    return why


class Block:
    __slots__ = ("text", "linked", "flag", "article", "bad", "size")

    def __init__(self, text: str, linked: int, flag: int, article: int):
        self.text, self.linked, self.flag, self.article, self.bad = text, linked, flag, article, False
        self.size = len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))

    def prose(self) -> int:
        return self.size if self.size >= LONG_CHARS and self.linked <= MAX_LINK_DENSITY * len(self.text) else 0


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order. ``article``: number of the enclosing article element, else 0; ``bad``: flagged."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # open block-level elements: tag, innermost flag (0: none), article
    opened: dict[str, int] = {}  # how many of them by tag
    parts: list[tuple[str, bool]] = []  # pieces of the current block, whether in a link
    flags: list[tuple[str, int]] = [("", 0)]  # why, flag around it
    articles: list[tuple[int, int]] = [(0, 0)]  # the element's own flag, the flag around it
    links = breaks = 0

    def flush() -> None:
        nonlocal breaks
        breaks = 0
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(p for p, _ in parts))).strip()
            if text:
                linked = len(_SPACE.sub(" ", _html.unescape("".join(p for p, a in parts if a))).strip())
                out.append(Block(text, linked, *(stack[-1][1:] if stack else (0, 0))))
            parts.clear()

    def add(text: str) -> None:
        nonlocal breaks
        if text:
            parts.append((text, links > 0))
            if not text.isspace():
                breaks = 0

    def close(depth: int) -> None:
        for tag, _, _ in stack[depth:]:
            opened[tag] -= 1
        del stack[depth:]

    tags = tags_of(page)
    ends: dict[int, int] = {}  # of elements that are left out whole: where their content ends, by number of the start tag
    waiting: dict[str, list[int]] = {}
    head_end = None
    for i, (_, _, tag, closing, attributes) in enumerate(tags):
        if tag in RAW_TAGS and tag not in TEXT_TAGS:
            if not closing and not attributes.endswith("/"):
                waiting.setdefault(tag, []).append(i)
            elif closing and waiting.get(tag):
                ends[waiting[tag].pop()] = i
        elif head_end is None and ((tag == "head" and closing) or (tag == "body" and not closing)):
            head_end = i
    at = i = 0
    while i < len(tags):
        start, end, tag, closing, attributes = tags[i]
        add(page[at:start])
        at = end
        i += 1
        if tag == "head":
            if not closing and head_end is not None and head_end >= i:
                i, at = head_end, tags[head_end][0]
            continue
        if tag in RAW_TAGS:
            if not closing and i - 1 in ends:  # without an end tag of its own, only the start tag goes
                i = ends[i - 1] + 1
                at = tags[i - 1][1]
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else 1  # links don't nest
            continue
        if tag == "br":
            breaks += 1
            if breaks == 2:  # a blank line ends a block
                flush()
            else:
                parts.append((" ", False))
            continue
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if tag in VOID_TAGS:
            continue
        if closing:
            links = 0
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if tag == "p" and stack and stack[-1][0] == "p":  # a paragraph ends the one before
            close(len(stack) - 1)
        _, around, inside = stack[-1] if stack else ("", 0, 0)
        own = 0
        if why := _flag(tag, attributes, bool(inside)):
            own = len(flags)
            flags.append((why, around))
        if tag in ("article", "main") and not inside:
            inside = len(articles)
            articles.append((own, around))
        stack.append((tag, own or around, inside))
        opened[tag] = opened.get(tag, 0) + 1
    add(page[at:])
    flush()
    _judge(out, flags, articles)
    return out


def _judge(blocks: list[Block], flags: list[tuple[str, int]], articles: list[tuple[int, int]]) -> None:
    """Sets ``bad`` of blocks under a flag that isn't void. Flags stand after those around them."""
    prose, of_article, total = [0] * len(flags), [0] * len(articles), 0
    for b in blocks:
        prose[b.flag] += b.prose()
        of_article[b.article] += len(b.text) - b.linked
        total += b.prose()
    reader = [False] * len(flags)
    for f in range(1, len(flags)):
        reader[f] = flags[f][0] == "reader" or reader[flags[f][1]]
    for f in range(len(flags) - 1, 0, -1):
        prose[flags[f][1]] += prose[f]
    void = [False] * len(flags)
    clean = max((of_article[a] for a, (own, around) in enumerate(articles) if a and not own and not around), default=0)
    void_for = [a for a, (own, around) in enumerate(articles) if a and not own and around and of_article[a] > clean]
    if any(not reader[articles[a][1]] for a in void_for):
        void_for = [a for a in void_for if not reader[articles[a][1]]]
    elif clean:
        void_for = []
    else:  # all of them among readers' comments
        void_for = [a for a in void_for if 2 * prose[articles[a][1]] > total]
    for a in void_for:
        f = articles[a][1]
        while f and not void[f]:
            void[f] = True
            f = flags[f][1]
    if not clean and not void_for:
        for f in range(1, len(flags)):
            void[f] = flags[f][0] == "layout" and 2 * prose[f] > total
    live = [False] * len(flags)
    for f in range(1, len(flags)):
        live[f] = not void[f] or live[flags[f][1]]
    for b in blocks:
        b.bad = live[b.flag]


def first_pass(block: Block, marked: bool, blind: bool = False) -> int:
    """``blind``: stop words tell nothing here."""
    if block.bad or (marked and not block.article):
        return BAD
    if block.linked / len(block.text) > MAX_LINK_DENSITY:
        return BAD
    if block.size < LONG_CHARS:
        return OPEN
    if blind or (not block.text.isascii() and 2 * len(_NOT_LATIN.findall(block.text)) > len(_LETTERS.findall(block.text))):
        return OPEN if marked else GOOD
    words = [w.strip(".,;:!?\"'()").lower() for w in block.text.split(" ")]
    density = sum(w in ALL_STOP_WORDS for w in words) / len(words)
    if density >= HIGH_STOPS:
        return GOOD
    if density < LOW_STOPS:
        return BAD
    return OPEN


def second_pass(labels: list[int], groups: list[int], apart: list[bool]) -> list[int]:
    """Labels without OPEN: each such block takes the nearest decided neighbour's within its article, blocks ``apart`` left out."""
    n, out = len(labels), list(labels)
    before: list[tuple[int, int]] = []
    last = (-1, 0)
    for i in range(n):
        if i and groups[i] != groups[i - 1]:
            last = (i - 1, 0)
        if labels[i] != OPEN and not apart[i]:
            last = (i, labels[i])
        before.append(last)
    last = (n, 0)
    for i in range(n - 1, -1, -1):
        if i < n - 1 and groups[i] != groups[i + 1]:
            last = (i + 1, 0)
        if labels[i] != OPEN and not apart[i]:
            last = (i, labels[i])
        if labels[i] == OPEN:
            edge = GOOD if groups[i] else BAD
            (a, x), (b, y) = before[i], last
            x, y = x or edge, y or edge
            out[i] = x if i - a < b - i else y if b - i < i - a else GOOD if x == y == GOOD else BAD
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    marked = any(b.article and not b.bad for b in blocks)
    groups = [b.article if marked else 0 for b in blocks]
    labels = [first_pass(b, marked) for b in blocks]
    known = {g for g, label in zip(groups, labels, strict=True) if label == GOOD}
    labels = [label if g in known else first_pass(b, marked, True) for b, g, label in zip(blocks, groups, labels, strict=True)]
    labels = second_pass(labels, groups, [marked and b.bad and b.article > 0 for b in blocks])
    return "\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label == GOOD)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return bare(pages, page_id="bigint", url="string", html="string").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
