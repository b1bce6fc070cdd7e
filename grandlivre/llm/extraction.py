"""Main text of web pages by line-block distribution.

Markup is stripped first: every block element starts a *line*, inline elements do not; comments, scripts, styles and
their like vanish with their content. Lines inside a menu, header, footer, sidebar, notice, advert, form or reader
comments, as elements, roles and class names tell, stay as lines of no text, and link text counts for nothing, so
such places are gaps. ``block_sums`` adds the text lengths of ``WINDOW`` lines from each line on. A *surge point* is the
first line whose block exceeds the threshold, a *dive point* the next line whose block is empty, that is a gap of
``WINDOW`` lines; the text between the two is kept.

In a page that marks its article (``article`` or its like, else ``main``) only lines inside it and the headings of
``main`` have length, any text there surges, and all stretches belong to the article. In other pages a stretch must reach ``SURGE`` characters in a block, or
half of the page's greatest block if no block reaches that; a heading that leads up to a stretch without a
gap begins it.

Character references are decoded, white space (as Python's ``str.split`` knows it, so U+00A0 too) becomes one space,
blocks are trimmed and joined by one space. A null or empty page, and one without such text, gives ''. Unclosed and
stray tags are tolerated; a tag that never ends is text. Repeated rows each get a row, ids and urls may
be null, other columns are not read. An empty table gives no rows. A page is held whole by its task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Lines of a block, and characters of a block at which text surges in a page that does not mark its article.
WINDOW, SURGE = 3, 80

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_ARTICLE, _MAIN = re.compile(r"\barticleBody\b|\brole\s*=\s*[\"']?article\b"), re.compile(r"\brole\s*=\s*[\"']?main\b")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and others whose content is never text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
GONE = frozenset("head noscript template svg object canvas audio video select datalist button dialog".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SIDE = frozenset("nav header footer aside form menu fieldset".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note".split())
SIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner comment comments disqus respond replies reply cookie cookies consent gdpr
    notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar widget widgets related recommended recommendations breadcrumb breadcrumbs menu
    nav navbar navigation navi pagination pager toolbar skip copyright footer foot header masthead topbar search form tags teaser teasers""".split())  # fmt: skip
#: Names that begin so tell what a page has or how it is filed, not what the element is.
WRAPS = frozenset("has no with without tag category".split())
#: A new element of the first name ends an open one of the second.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
#: An article inside one of these is still the page's article.
SOFT = frozenset("form header nav menu fieldset".split())
_LEGAL = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos)", re.I)
_REMARKS = re.compile(r"\s*\d*\s*(?:reader comments|comments?|kommentare?|commentaires?|comentarios?|responses|leave a (?:reply|comment))\s*(?:\(\d+\)|:)?\s*", re.I)


#: (tag, side, article, soft) outside any element. ``article`` is 1 in a main element and 2 in an article.
OUTSIDE = ("", False, 0, False)


@dataclass(slots=True)
class Line:
    """A block's text as pieces, the length of what counts, and where it lies."""

    pieces: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    side: bool = False
    article: int = 0
    heading: bool = False


def _side(tag: str, attributes: str, article: int) -> bool:
    """Whether an element is a margin of the page; a header inside an article is the article's own."""
    if tag in SIDE and not (tag == "header" and article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    has = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in has or has.get("aria-hidden") == "true" or has.get("role", "").lower() in SIDE_ROLES or re.search(r"display\s*:\s*none", has.get("style", "")):
        return True
    for name in f"{has.get('class', '')} {has.get('id', '')}".split():
        parts = [p.lower() for p in _NAME_PART.findall(name)]
        words = SIDE_WORDS.intersection(parts)
        own_header = words == {"header"} and (article or not {"article", "post", "entry"}.isdisjoint(parts))
        if words and not own_header and parts[0] not in WRAPS and (tag != "article" or len(parts) == 1):
            return True
    return False


def lines(page: str) -> list[Line]:
    """The lines of a page, markup stripped."""
    out, now, at, end = [], Line(), 0, len(page)
    stack: list[tuple[str, bool, int, bool]] = []  # (tag, side, article, soft) of the open elements
    link, gone = 0, 0

    def text(piece: str) -> None:
        if piece and not gone:
            (now.links if link else now.pieces).append(html.unescape(piece))
            if link:
                now.pieces.append(now.links[-1])

    def line(heading: bool = False) -> None:
        nonlocal now
        _, side, article, _ = stack[-1] if stack else OUTSIDE
        if now.pieces:
            out.append(now)
        now = Line(side=side, article=article, heading=heading)

    while at < end:
        m = _MARKUP.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if found is not None:
                gone -= sum(s[0] in GONE for s in stack[found:])
                del stack[found:]
            if tag in BLOCK or found is not None:
                line()
            elif tag == "br":
                text(" ")
            continue
        if tag == "br":
            text(" ")
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
            if close:
                at = page.find(">", at) + 1 or end
            continue
        if tag in VOID:
            if tag in BLOCK:
                line()
            continue
        if tag == "a":
            link = 1
        if tag in BLOCK and stack and stack[-1][0] == "p":
            stack.pop()
        elif tag in BLOCK and stack and stack[-1][0] == "head":
            gone -= 1  # a head that was not closed
            stack.pop()
        while stack and stack[-1][0] in ENDS.get(tag, ()):
            stack.pop()
        _, side, article, soft = stack[-1] if stack else OUTSIDE
        mark = _side(tag, m[3], article)
        landmark = 0 if mark else 2 if tag == "article" or _ARTICLE.search(m[3]) else 1 if tag == "main" or _MAIN.search(m[3]) else 0
        if landmark and soft:
            side = False
        if tag in BLOCK or tag in GONE or mark or landmark:
            if tag not in BLOCK and m[3].endswith("/"):
                continue
            soft = (soft or not side) and tag in SOFT if mark else soft and not landmark
            stack.append((tag, side or mark, article if side else max(article, landmark), soft))
            gone += tag in GONE
            line(tag in ("h1", "h2", "h3"))
    if now.pieces:
        out.append(now)
    return out


def block_sums(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The sum of ``window`` lengths from each line on."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(len(lengths))
    return total[np.minimum(at + window, len(lengths))] - total[at]


def stretches(lengths: np.ndarray, least: int, heading: np.ndarray) -> list[tuple[int, int]]:
    """(first line, dive line) of every stretch: from a block of ``least`` characters to the next empty block.

    A stretch begins at its surge point, or at the first heading of the lines that lead up to it without an empty block.
    """
    sums = block_sums(lengths)
    empty = np.append(np.flatnonzero(sums == 0), len(lengths))
    out, at = [], 0
    for surge in np.flatnonzero(sums >= max(1, least)):
        if surge >= at:
            k = int(np.searchsorted(empty, surge))
            since = max(at, int(empty[k - 1]) + 1 if k else 0)
            titles = np.flatnonzero(heading[since:surge])
            at = int(empty[k])
            out.append((since + int(titles[0]) if len(titles) else int(surge), at))
    return out


def main_text(page: str | None) -> str:
    """The article of a page; '' if it has none."""
    found = lines(page or "")
    texts = [" ".join("".join(x.pieces).split()) for x in found]
    mark = max((x.article for x, t in zip(found, texts, strict=True) if t and not x.side), default=0)
    remarks = next((k for k, (x, t) in enumerate(zip(found, texts, strict=True)) if x.heading and not mark and _REMARKS.fullmatch(t)), len(found))
    length = np.zeros(len(found), np.int64)
    for k, (x, t) in enumerate(zip(found, texts, strict=True)):
        if x.side or k >= remarks:
            continue
        if not mark:
            length[k] = 0 if _LEGAL.match(t) else max(0, len(t) - len(" ".join("".join(x.links).split())))
        elif x.article == mark or (x.article and x.heading):
            length[k] = len(t)
    if not length.any():
        return ""
    least = 1 if mark else min(SURGE, int(block_sums(length).max()) // 2)
    heading = np.array([x.heading for x in found]) & (length > 0)
    return " ".join(texts[k] for lo, hi in stretches(length, least, heading) for k in range(lo, hi) if length[k])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
