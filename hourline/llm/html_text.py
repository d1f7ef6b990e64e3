"""Main text of web pages by line-block distribution.

Markup is stripped to one line for each block of the page. A line's length counts its characters of running
text: text in links counts nothing, nor does anything in elements that are never part of an article.
Sums over a sliding window of ``WINDOW`` lines rise where running text begins (a surge) and fall to
nothing where it ends (a dive); lines between a surge and its dive are kept, so a short paragraph
between long ones stays. So do short runs between two surges, such as a paragraph between two adverts. Elements that hold no article text (menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts, styles) are told by their tag or the last word of a role,
class or id and leave a gap of empty lines as wide as the window, which ends any run; such that
hold ``BULK`` of the running text (of the marked article, if there is one), alone or with all told by the
same name, are taken as part of the article, unless they are hidden. If the page marks its article or main
part, and at least half of the page's running text stands in it, the lines in it are the ones the distribution is taken over, and there
even a single short line is a surge of its own; a mark around less, such as a teaser's, decides nothing.

Defined results: a null page counts as empty and has an empty text. Any markup is read: unclosed and
misnested tags, comments without end, and a page cut off in a tag. Character references are decoded,
white space within a block becomes one space, blocks are joined by one space in page order, and
nothing else is dropped or cut. Repeated rows, null ids and null urls are kept as they are.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourline.llm.frames import col

WINDOW = 3
#: A window's characters, spaces apart, at which text surges outside a marked article.
SURGE = 40
#: Elements that hold this share of the running text are never dropped for their tag or name.
BULK = 0.8

# Fixed values of HTML: elements whose content is no text, or never part of an article; elements
# without content; elements that run on within a block of text.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "noembed", "xmp", "svg", "math", "object", "canvas", "audio", "video")
ASIDE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "input", "fieldset", "head")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
)
#: Last words of a class, id or role that name a part outside the article.
NAMES = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "contentinfo", "consent", "cookie", "cookies",
    "disqus", "disclaimer", "footer", "gdpr", "header", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "navigations", "newsletter", "notice", "notices", "pager",
    "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
    "tags", "toolbar", "topbar", "widget", "widgets", "alert", "complementary", "popular", "recommended", "copyright", "discussion",
)
#: Names of an <article> element that is no main text.
OTHER_ARTICLES = ("ad", "ads", "advert", "advertisement", "comment", "comments", "notice", "promo", "related", "reply", "sponsored", "teaser", "widget")
#: First words of names that tell of an element's surroundings.
ABOUT = ("has", "with", "without", "no")
#: Elements that are followed to their end wherever they stand.
_KEPT_OPEN = frozenset(("article", "main", "a", "div", "section", "td", "tr", "table", "ul", "ol", "body"))
_OTHER_ARTICLES, _ABOUT = frozenset(OTHER_ARTICLES), frozenset(ABOUT)
_RAW, _ASIDE, _VOID, _INLINE, _NAMES = map(frozenset, (RAW, ASIDE, VOID, INLINE, NAMES))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"  # comments, declarations
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:[\"'][^>]*)?(?:>|\Z)",
    re.S,
)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_EMPTY = re.compile(r"""(?:^|[\s"'])/$""")  # "<div/>", but not "<a href=/>"
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def _outside(tag: str, rest: str) -> str:
    """What tells that an element is no part of an article: its tag, words of its names, or that it is hidden."""
    if tag in _ASIDE:
        return f"<{tag}>"
    if not rest or tag in ("html", "body", "main"):
        return ""
    words: set[str] = set()
    for m in _NAME.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
            if parts and parts[0] not in _ABOUT:  # "has-sidebar" is said of what stands beside one
                words.add(parts[-1])  # "widget-container" is a container
    return " ".join(sorted(words & (_OTHER_ARTICLES if tag == "article" else _NAMES))) or "hidden" * _hidden(tag, rest)


def _hidden(tag: str, rest: str) -> bool:
    return bool(rest) and tag not in ("html", "body", "main") and _HIDDEN.search(rest) is not None


def _bulk(page: str) -> set[int]:
    """Where the elements begin that are told as outside but hold ``BULK`` of the running text, alone or with
    all that are told by the same: of that in articles if there is some, else in the main part, else of the page."""
    totals = [0, 0, 0, 0]  # characters of the page, in the main part, in articles, and beside these outside of what is told
    held: list[tuple[int, str, bool, list[int]]] = []  # start, what tells it, whether in one that the same tells, characters
    stack: list[tuple[str, int, str, list[int], bool, bool]] = []  # tag, start, what tells it, totals before, hidden, article
    told: Counter[str] = Counter()
    open_: Counter[str] = Counter()  # open elements by tag: an end tag that ends none costs nothing
    mains = articles = links = hidden = n_told = 0
    at = 0

    def add(text: str) -> None:
        if not links and not hidden:
            n = len("".join(text.split()))
            totals[0] += n
            totals[1] += n if mains else 0
            totals[2] += n if articles else 0
            totals[3] += n if not (mains or articles or n_told) else 0

    def close() -> str:
        nonlocal mains, articles, links, hidden, n_told
        tag, start, by, before, is_hidden, is_article = stack.pop()
        open_[tag] -= 1
        mains -= tag == "main"
        articles -= is_article
        links -= tag == "a"
        hidden -= is_hidden
        if by:
            told[by] -= 1
            n_told -= 1
            held.append((start, by, told[by] > 0, [now - then for now, then in zip(totals, before, strict=True)]))
        return tag

    while found := _TOKEN.search(page, at):
        add(page[at : found.start()])
        at = max(found.end(), found.start() + 1)
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if found["end"]:
            if open_[tag]:
                while close() != tag:
                    pass
        elif tag in _RAW:
            if not _EMPTY.search(found["rest"]):
                ends = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = ends.end() if ends else len(page)
        elif tag not in _VOID and not _EMPTY.search(found["rest"]):
            is_hidden = _hidden(tag, found["rest"])
            by = "" if is_hidden else _outside(tag, found["rest"])
            if is_hidden or hidden or by or n_told or tag in _KEPT_OPEN:
                stack.append((tag, found.start(), by, list(totals), is_hidden, tag == "article" and not by))
                open_[tag] += 1
                if by:
                    told[by] += 1
                    n_told += 1
                mains += tag == "main"
                articles += tag == "article" and not by
                links += tag == "a"
                hidden += is_hidden
    add(page[at:])
    while stack:
        close()
    kind = next((k for k in (2, 1) if totals[k] and totals[k] >= totals[3]), 0)  # a mark around less than what stands beside it says little
    least = max(1, BULK * totals[kind])
    alone = [(start, by) for start, by, _, n in held if n[kind] >= least]
    sums: Counter[str] = Counter()
    for _, by, inner, n in held:
        sums[by] += 0 if inner else n[kind]
    together = {by for by, n in sums.items() if n >= least} - {by for _, by in alone}
    return {start for start, _ in alone} | {start for start, by, _, _ in held if by in together}


def _size(text: str) -> int:
    return len("".join(text.split()))


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters of running text, whether it is in a marked article) of each block of a page; an
    element outside the article gives ``WINDOW`` empty lines."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool]] = []  # open elements that matter, and whether they are outside
    open_: Counter[str] = Counter()
    outside = inside = links = 0
    at = 0
    bulk = _bulk(page)

    def end_line() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append((text, max(0, _size(text) - linked), inside > 0))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not outside:
            parts.append(text)
            if links:
                linked += _size(html.unescape(text))

    while True:
        found = _TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = max(found.end(), found.start() + 1)
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if tag in _RAW and not found["end"]:
            if not _EMPTY.search(found["rest"]):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if tag not in _INLINE:
            end_line()
        if found["end"]:
            if open_[tag]:
                while stack:
                    name, was_outside = stack.pop()
                    open_[name] -= 1
                    outside -= was_outside
                    inside -= name in ("article", "main")
                    links -= name == "a"
                    if was_outside and not outside:
                        out.extend([("", 0, inside > 0)] * WINDOW)
                    if name == tag:
                        break
        elif tag not in _VOID and not _EMPTY.search(found["rest"]):
            is_outside = bool(_outside(tag, found["rest"])) and found.start() not in bulk
            if is_outside and not outside:
                end_line()
            if is_outside or outside or tag in _KEPT_OPEN:
                stack.append((tag, is_outside))
                open_[tag] += 1
                outside += is_outside
                inside += tag in ("article", "main")
                links += tag == "a"
    end_line()
    return out


def main_text(page: str) -> str:
    """The lines between surges and dives, joined by one space."""
    found = lines(page)
    inner = sum(_size(text) for text, _, inside in found if inside)
    marked = inner > 0 and inner >= sum(n for _, n, inside in found if not inside)
    if marked:
        found = [(text, _size(text), True) if inside else ("", 0, False) for text, _, inside in found]
    if not found:
        return ""
    sizes = np.array([n for _, n, _ in found])
    sums = np.convolve(sizes, np.ones(WINDOW, dtype=np.int64))  # block i: lines i - WINDOW + 1 to i
    runs: list[tuple[int, int, bool]] = []  # from a rise to the last line before its dive, and whether it surges
    begin = None
    for i, total in enumerate([*sums.tolist(), 0]):
        if begin is None and total > 0:
            begin = i
        elif begin is not None and total == 0:
            runs.append((begin, min(i - WINDOW + 1, len(found)), marked or sums[begin:i].max() >= SURGE))
            begin = None
    surging = [k for k, run in enumerate(runs) if run[2]]
    keep = np.zeros(len(found), dtype=bool)
    for begin, end, _ in runs[surging[0] : surging[-1] + 1] if surging else runs:  # no surge: the whole page is short
        keep[begin:end] = sizes[begin:end] > 0 if not surging else True
    return " ".join(text for (text, _, _), ok in zip(found, keep, strict=True) if ok and text)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each row; n_chars counts code points."""
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "") for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.select(col(id_col), col(url_col), col(html_col).cast("string")).mapInArrow(run, schema)
