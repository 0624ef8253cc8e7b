"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
    "p pre search section select summary table tbody td tfoot th thead tr ul title".split()
)
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template textarea iframe object svg math canvas audio video noframes title xmp".split())
#: Elements that hold page furniture.
FURNITURE = frozenset("nav header footer aside menu dialog button select head".split())
#: Elements that are furniture unless they hold most of the page's text: whole
#: pages are wrapped into forms.
FORMS = frozenset("form fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role attributes that name page furniture.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adsbygoogle|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|"
    r"breadcrumbs?|sidebar|widget|cookies?(?:bar|banner|notice|consent)?|consent|notice|popup|modal|newsletter|subscribe|signup|login|social|share|"
    r"sharing|related|recommended|comments?|commentlist|respond|replies|disqus|footer|header|masthead|toolbar|pagination|"
    r"pager|contentinfo|complementary|search|skip)(?:$|[\s_-]|\d)",
    re.I,
)
#: Of these, those that an element inside the article has for its own headline.
HEADLINE = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-]|\d)", re.I)
#: Words of class and id attributes of article elements that aren't the article.
OTHER_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|ads?|adverts?|advertisement|sponsor(?:ed)?|promo|related|recommended|teaser)(?:$|[\s_-]|\d)", re.I)
#: Lines of a window, and the characters in it that begin a passage.
WINDOW, SURGE = 3, 90
OUTSIDE = 6
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACE = re.compile(r"\s+")
#: An end tag of these also closes what is still open inside.
_SCOPES = frozenset("div section article aside nav header footer main ul ol table form menu body html fieldset dialog select li td tr button".split())


def _is_furniture(name: str, attributes: str, article: bool) -> bool:
    if name in FURNITURE and not (article and name == "header"):
        return True
    if not attributes or name in ("body", "html", "main"):
        return False
    words = OTHER_ARTICLE if name == "article" else HINT
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key in ("class", "id", "role") and value:
            found = words.search(HEADLINE.sub("", value) if article else value)
            # a section of an article may be named for what it is about: related-work
            if found and not (article and key == "id" and found[0].strip("-_ ") != value):
                return True
    return False


def lines_of(html: str) -> list[tuple[str, int, bool, bool, bool]]:
    """Strip the markup: (text, characters inside links, furniture, inside an
    article element, inside a form) for each block of the page, in page order,
    empty ones left out."""
    out: list[tuple[str, int, bool, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, furniture, article, form
    linked, in_link, furniture, article, form = 0, 0, 0, 0, 0
    at, n = 0, len(html)

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at:
            s = html[at:end]
            parts.append(unescape(s) if "&" in s else s)
            if in_link:
                linked += len(s)

    def flush() -> None:
        nonlocal linked
        if parts:
            s = SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if s:
                out.append((s, min(linked, len(s)), furniture > 0, article > 0, form > 0))
        linked = 0

    def pop() -> None:
        nonlocal furniture, article, form
        _, f, a, o = stack.pop()
        furniture -= f
        article -= a
        form -= o

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            break
        text_to(m.start())
        at = m.end()
        name = m[2]
        if name is None:
            if html.startswith("<![CDATA[", m.start()):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = 0
            if name in BLOCKS:
                flush()
                if name in _SCOPES:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            while len(stack) > k:
                                pop()
                            break
                elif stack and stack[-1][0] == name:
                    pop()
            elif stack and stack[-1][0] == name:
                pop()
            continue
        if name in RAW:
            flush_needed = name in BLOCKS
            if not m[3].rstrip().endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            if flush_needed:
                flush()
            continue
        if name in VOID:
            if name in BLOCKS:
                flush()
            elif name == "br":
                parts.append(" ")
            continue
        if name == "a":
            in_link = 1
        if name in BLOCKS:
            flush()
        f, a, o = _is_furniture(name, m[3], article > 0), name in ("article", "main"), name in FORMS
        if name in _SCOPES or f or a:
            stack.append((name, f, a, o))
            furniture += f
            article += a
            form += o
    if at < n:
        text_to(n)
    flush()
    return out


def passages(sizes: np.ndarray, level: int, window: int = WINDOW) -> np.ndarray:
    """Which lines lie between a surge and the dive after it.  ``sizes`` are the
    lines' text lengths; where the sum over a window of lines reaches ``level`` a
    passage begins, at the first filled line of that window, and it goes on to the
    first line from which a whole window is empty."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes), np.full(window, sizes.sum())])
    sums = total[window : window + n] - total[:n]
    keep = np.zeros(n, bool)
    inside = False
    for k in range(n):
        inside = sums[k] > 0 and (inside or sums[k] >= level)
        keep[k] = inside and sizes[k] > 0
    return keep


def main_text(html: str, surge: int = SURGE, link_share: float = 0.5) -> str:
    """The article of one page.

    The blocks of the stripped page are its lines.  Markup weighs them: a line of
    page furniture has no text; one of links mostly has none outside an article
    element.  The lines inside article elements and those outside have each a
    distribution of text of their own, and :func:`passages` finds where it surges
    and dives.  Inside any text is a surge, since the element's border is one; on
    a page without such text a window needs ``surge`` characters, or a third of
    the largest sum where that is less; and outside the articles of a page that
    has some, ``OUTSIDE`` times ``surge``, so that a passage beside mere teasers
    is found and a notice isn't.
    """
    lines = lines_of(html)
    if not lines:
        return ""
    text = np.array([len(s) for s, *_ in lines], np.int64)
    links, furniture, article, form = (np.array([x[k] for x in lines]) for k in (1, 2, 3, 4))
    free = ~furniture
    if 2 * text[free & form].sum() < text[free].sum():
        free &= ~form
    body = np.where(free & article, text, 0)
    rest = np.where(free & ~article & (links <= link_share * text), text, 0)
    if body.any():
        keep = passages(body, 1) | passages(rest, OUTSIDE * surge)
    else:
        keep = passages(rest, max(1, min(surge, _largest(rest) // 3)))
    return "\n".join(lines[k][0] for k in np.flatnonzero(keep))


def _largest(sizes: np.ndarray) -> int:
    return int(np.convolve(sizes, np.ones(WINDOW, np.int64)).max())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, text, n_chars.

    One row per input row, repeated rows included; a null or empty page, or one
    without an article, has the empty text.  Null ids and urls stay null.  Each
    page is worked on alone and whole: no shuffle, memory of one batch.
    """
    return pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), text_or_empty("html").alias("html")
    ).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
