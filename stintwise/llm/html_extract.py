"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Scripts, styles, forms,
navigation, headers, footers, sidebars, notices, adverts and reader comments
(by element, role, class or id) give no line. Each remaining line counts its
text length without link text. Over sliding windows of ``WINDOW`` lines the
lengths are summed: a *surge* is the first line whose window rises above the
threshold, a *dive* the point where a window has nothing left; the lines
between are the main text. On pages that mark their article (``article`` or
``main``), lines outside it count zero and the threshold is zero, so the kept
lines are the whole marked article, however short its paragraphs; a mark that
holds less text than the lines outside it (a teaser card, say) does not count.
Without a mark, lines that lead from a heading to the surge belong to it, and a
page whose paragraphs are links alone gives those.

A class, id or role drops a block, whatever its size, only when all words of one
of its names are noise (``cookie-notice``, not ``has-sidebar``), headings and
paragraphs of an article only as adverts, and never a block that holds the
page's only marked article. Of a ``header`` inside a marked article its headings
stay. Text of ``math`` is text; fallbacks of ``object`` and ``iframe`` are not.

Defined results: null, empty or text-free html gives an empty text; unclosed
elements end with the one that holds them; a truncated tag is dropped and a
truncated character reference stays as written; repeated rows are extracted
each; an empty table gives no row.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW, SURGE_CHARS, SURGE_SHARE = 3, 80, 0.5

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|\Z)"""
                  r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"<]*"|'[^'<]*')*+)>"""
                  r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PARAGRAPHS = {"p"} | _HEADINGS
_ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo"}

_RAW = {"script", "style", "textarea", "noscript", "iframe", "template", "svg", "object", "title", "select"}
_DROP = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "label", "fieldset"}
_BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "thead",
          "tbody", "tfoot", "caption", "section", "article", "main", "blockquote", "pre", "figure", "figcaption", "hr",
          "address", "details", "summary", "body", "html", "center", "hgroup", "search"} | _DROP
_SPACED = {"br", "td", "th", "img", "wbr"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Elements kept on the stack even without a drop mark: they hold other blocks.
_HOLDERS = {"div", "section", "article", "main", "ul", "ol", "dl", "table", "blockquote", "figure", "details", "center",
            "body", "html"} | _DROP
#: Words of class, id and role that mark what is not the article.
_NOISE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner",
          "sidebar", "sidebars", "aside", "nav", "navigation", "navbar", "menu", "menus", "breadcrumb", "breadcrumbs",
          "footer", "header", "masthead", "comment", "comments", "disqus", "reply", "replies", "respond", "notice",
          "notices", "cookie", "cookies", "consent", "gdpr", "newsletter", "subscribe", "subscription", "popup",
          "modal", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager",
          "login", "signup", "copyright", "disclaimer", "contentinfo", "complementary", "search", "dialog", "alert"}


def _hidden(attrs: str) -> bool:
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif name not in ("class", "id", "role") and (name == "hidden" and value != "false" or value == "true"):
            return True
    return False


def _noisy(attrs: str, noise: set[str] = _NOISE) -> bool:
    for m in _ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id", "role"):
            for token in (m[2] or "").strip("\"'").lower().split():
                words = _WORD.findall(token)
                if words and noise.issuperset(words):
                    return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool, str]]:
    """(text, length without link text, in a marked article, heading or
    paragraph that it is) of every line."""
    out: list[tuple[str, int, bool, str, tuple[int, ...]]] = []
    line: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []
    noisy: list[int] = []           # open blocks that class, id or role call noise
    holds: list[bool] = []          # of each such block: a marked article
    free = False                    # a marked article outside them
    opened: dict[str, int] = {}
    dropped = anchors = marked = headers = 0
    kind = ""                       # the heading or paragraph that is open

    def flush() -> None:
        nonlocal linked
        if line:
            text = " ".join("".join(line).split())
            if text and (not headers or kind in _HEADINGS):
                out.append((text, max(0, len(text) - linked), marked > 0, kind, tuple(noisy)))
            line.clear()
        linked = 0

    def pop() -> None:
        nonlocal dropped, marked, headers
        name, drop, soft = stack.pop()
        headers -= name == "header" and not drop
        opened[name] -= 1
        dropped -= drop
        if soft:
            noisy.pop()
        marked -= name in ("article", "main")

    pos, end = 0, len(page)
    while pos < end:
        m = _TAG.search(page, pos)
        stop = m.start() if m else end
        if stop > pos and not dropped:
            text = _html.unescape(page[pos:stop]) if "&" in page[pos:stop] else page[pos:stop]
            line.append(text)
            if anchors:
                linked += len(text)
        if not m:
            break
        pos = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name in _BLOCK:
                flush()
                kind = ""
            elif name in _SPACED:
                line.append(" ")
            if name == "a":
                anchors = max(0, anchors - 1)
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        attrs = m["attrs"] if m["name"] else m["attrs2"] or ""
        if name in _RAW:
            if not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = close.end() if close else end
            continue
        if name == "body":
            flush()
            while stack:
                pop()
        if name in _BLOCK:
            flush()
            kind = name if name in _PARAGRAPHS else ""
            while stack and stack[-1][0] in ("p", "li") and name != "span":
                pop()          # an unclosed dropped paragraph or item ends here
        elif name in _SPACED:
            line.append(" ")
        if name == "a":
            anchors += 1
        if name in _VOID:
            continue
        drop, soft = name in _DROP and not (name == "header" and marked), False
        if not drop and attrs and name not in ("body", "html", "article", "main"):
            noise = _noisy(attrs, _ADVERTS if marked and name in _PARAGRAPHS else _NOISE)
            drop = _hidden(attrs) or noise and name not in _BLOCK
            soft = noise and not drop and not dropped
        if drop or soft or name in _HOLDERS:
            stack.append((name, drop, soft))
            opened[name] = opened.get(name, 0) + 1
            dropped += drop
            headers += name == "header" and not drop
            if soft:
                noisy.append(len(holds))
                holds.append(False)
            if name in ("article", "main"):
                if not marked and not dropped:
                    free = free or not noisy
                    for i in noisy:
                        holds[i] = True
                marked += 1
    flush()
    return [t[:4] for t in out if all(holds[i] and not free for i in t[4])]


def main_lines(lines: list[tuple[str, int, bool, str]]) -> list[str]:
    """The lines between surge and dive points of the line-block distribution."""
    inner = sum(len(t) for t, _, m, _ in lines if m)
    marked = inner > 0 and inner >= sum(n for _, n, m, _ in lines if not m)
    lengths = [(len(t) if m else 0) if marked else n for t, n, m, _ in lines]
    if not marked and not any(lengths):
        lengths = [len(t) if k else 0 for t, _, _, k in lines]
    n = len(lengths)
    sums = [sum(lengths[i:i + WINDOW]) for i in range(n)]
    surge_at = 0 if marked else min(SURGE_CHARS, SURGE_SHARE * max(sums, default=0))
    kept, inside = [], False
    for i in range(n):
        if not inside and sums[i] > surge_at and lengths[i] > 0:
            inside = True
            kept += [] if marked else _led_in(lines, lengths, i)
        elif inside and sums[i] == 0:
            inside = False
        if inside and (lengths[i] > 0 or not marked):
            kept.append(lines[i][0])
    return kept


def _led_in(lines: list[tuple[str, int, bool, str]], lengths: list[int], surge: int) -> list[str]:
    """Lines from the first heading to the surge, if text leads without a gap
    from one to the other."""
    first = at = surge
    while at and lengths[at - 1] > 0:
        at -= 1
        if lines[at][3] in _HEADINGS:
            first = at
    return [lines[i][0] for i in range(first, surge)]


def main_text(page: str | None) -> str:
    return "\n".join(main_lines(lines_of(page))) if page else ""


def extract_text(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``column`` as ``out``."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None).astype(object)

    return pages.withColumn(out, text(F.col(column)))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    got = extract_text(pages)
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
