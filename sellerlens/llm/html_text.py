"""The article of a web page: flat text blocks, judged one by one by a small decision tree.

Block-level tags cut a page into blocks of text. A block is described by its number of words and the
share of them inside links, by the same of the blocks before and after it, by whether it is a heading,
and by whether the elements around it are an article or are marked as something else (navigation,
footer, advert, comments, ...). Elements that may as well wrap a page, such as a form or one named top, mark
their blocks only if they hold no more than half of the page's words. The tree is grown on ``EXAMPLES``, a table of blocks labelled by
hand, each time a worker starts; that takes milliseconds.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.llm.shared import by_batches

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "article", "marked"]

# Blocks labelled by hand: the features in the order above, then 1 for the article's text.
EXAMPLES = np.array([
    # running text, in an article and elsewhere
    [62, 0.00, 48, 0.00, 55, 0.00, 0, 1, 0, 1], [120, 0.03, 9, 0.00, 80, 0.00, 0, 1, 0, 1], [33, 0.06, 62, 0.00, 41, 0.00, 0, 1, 0, 1],
    [71, 0.00, 45, 0.00, 66, 0.00, 0, 0, 0, 1], [45, 0.04, 7, 0.00, 90, 0.02, 0, 0, 0, 1], [150, 0.01, 60, 0.00, 4, 1.00, 0, 0, 0, 1],
    [28, 0.00, 80, 0.00, 35, 0.00, 0, 0, 0, 1], [22, 0.09, 40, 0.00, 51, 0.00, 0, 0, 0, 1], [18, 0.00, 30, 0.00, 25, 0.00, 0, 0, 0, 1],
    [240, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1], [90, 0.10, 3, 1.00, 2, 1.00, 0, 0, 0, 1], [40, 0.00, 12, 1.00, 38, 0.00, 0, 0, 0, 1],
    # short paragraphs between long ones, and at the edges of an article
    [1, 0.00, 44, 0.00, 1, 0.00, 0, 1, 0, 1], [2, 0.00, 1, 0.00, 37, 0.00, 0, 1, 0, 1], [5, 0.00, 60, 0.00, 52, 0.00, 0, 1, 0, 1],
    [1, 0.00, 2, 0.00, 8, 0.30, 0, 1, 0, 1], [3, 0.00, 9, 0.00, 0, 0.00, 0, 1, 0, 1], [4, 0.00, 10, 0.00, 6, 0.00, 0, 1, 0, 1],
    [6, 0.00, 58, 0.00, 47, 0.00, 0, 0, 0, 1], [9, 0.00, 70, 0.00, 33, 0.00, 0, 0, 0, 1], [4, 0.00, 39, 0.00, 61, 0.00, 0, 0, 0, 1],
    [8, 0.12, 35, 0.00, 80, 0.00, 0, 0, 0, 1], [3, 0.33, 41, 0.00, 30, 0.00, 0, 1, 0, 1], [7, 0.43, 52, 0.00, 44, 0.00, 0, 1, 0, 1],
    # headings
    [7, 0.00, 8, 0.00, 40, 0.00, 1, 1, 0, 1], [12, 0.00, 1, 1.00, 65, 0.00, 1, 1, 0, 1], [2, 0.00, 50, 0.00, 48, 0.00, 1, 1, 0, 1],
    [6, 0.00, 1, 1.00, 70, 0.00, 1, 0, 0, 1], [4, 0.00, 65, 0.00, 55, 0.00, 1, 0, 0, 1], [9, 0.00, 2, 1.00, 30, 0.00, 1, 0, 0, 1],
    [2, 0.00, 3, 1.00, 4, 1.00, 1, 0, 0, 0], [3, 0.00, 60, 0.00, 3, 1.00, 1, 0, 0, 0], [3, 1.00, 40, 0.00, 12, 1.00, 1, 0, 0, 0],
    [2, 0.00, 1, 1.00, 44, 0.00, 1, 1, 0, 1], [3, 0.00, 2, 1.00, 60, 0.00, 0, 1, 0, 1], [1, 0.00, 6, 1.00, 30, 0.00, 1, 1, 0, 1],
    [2, 0.00, 4, 1.00, 3, 0.00, 0, 1, 0, 1], [3, 0.00, 1, 1.00, 1, 0.00, 1, 1, 0, 1],
    # lists and tables of an article
    [11, 0.00, 30, 0.00, 10, 0.00, 0, 1, 0, 1], [5, 0.20, 11, 0.00, 7, 0.00, 0, 1, 0, 1], [2, 0.00, 2, 0.00, 3, 0.00, 0, 1, 0, 1],
    # running text without an article element around it: its neighbours are text, short lines or nothing
    [45, 0.00, 0, 0.00, 3, 0.00, 0, 0, 0, 1], [45, 0.00, 3, 0.00, 0, 0.00, 0, 0, 0, 1], [45, 0.00, 5, 0.00, 40, 0.00, 0, 0, 0, 1],
    [40, 0.00, 45, 0.00, 2, 1.00, 0, 0, 0, 1], [40, 0.00, 45, 0.00, 1, 1.00, 0, 0, 0, 1], [38, 0.00, 41, 0.00, 12, 1.00, 0, 0, 0, 1],
    [30, 0.00, 2, 1.00, 28, 0.00, 0, 0, 0, 1], [60, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1], [35, 0.00, 50, 0.00, 0, 0.00, 0, 0, 0, 1],
    [16, 0.00, 45, 0.00, 40, 0.00, 0, 0, 0, 1], [15, 0.00, 30, 0.00, 2, 1.00, 0, 0, 0, 1], [26, 0.08, 4, 1.00, 3, 1.00, 0, 0, 0, 1],
    [19, 0.00, 1, 1.00, 1, 1.00, 0, 0, 0, 1], [21, 0.00, 6, 0.00, 2, 1.00, 0, 0, 0, 1], [33, 0.15, 36, 0.00, 3, 0.00, 0, 0, 0, 1],
    [14, 0.00, 22, 0.00, 18, 0.00, 0, 0, 0, 1], [13, 0.00, 16, 0.00, 24, 0.00, 0, 0, 0, 1], [17, 0.20, 24, 0.00, 20, 0.00, 0, 0, 0, 1],
    # short blocks: text between text, loose lines at its edges
    [3, 0.00, 45, 0.00, 45, 0.00, 0, 0, 0, 1], [1, 0.00, 20, 0.00, 31, 0.00, 0, 0, 0, 1], [2, 0.00, 55, 0.00, 28, 0.00, 0, 0, 0, 1],
    [7, 0.00, 24, 0.00, 19, 0.00, 0, 0, 0, 1], [10, 0.00, 33, 0.00, 26, 0.00, 0, 0, 0, 1], [5, 0.20, 42, 0.00, 37, 0.00, 0, 0, 0, 1],
    [4, 0.00, 2, 1.00, 45, 0.00, 0, 0, 0, 0], [5, 0.00, 45, 0.00, 3, 1.00, 0, 0, 0, 0], [3, 0.00, 1, 1.00, 38, 0.00, 0, 0, 0, 0],
    [6, 0.00, 52, 0.00, 1, 1.00, 0, 0, 0, 0], [10, 0.00, 2, 1.00, 4, 1.00, 0, 0, 0, 0], [11, 0.00, 4, 1.00, 3, 0.50, 0, 0, 0, 0],
    [2, 0.00, 4, 0.00, 3, 0.00, 0, 0, 0, 0], [7, 0.00, 6, 0.00, 2, 1.00, 0, 0, 0, 0], [3, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0, 0],
    [2, 1.00, 45, 0.00, 45, 0.00, 0, 0, 0, 0], [4, 1.00, 30, 0.00, 26, 0.00, 0, 0, 0, 0], [9, 1.00, 44, 0.00, 35, 0.00, 0, 0, 0, 0],
    # headings over text, and over lists of links
    [5, 0.00, 0, 0.00, 45, 0.00, 1, 0, 0, 1], [8, 0.00, 0, 0.00, 60, 0.00, 1, 0, 0, 1], [4, 0.00, 3, 1.00, 40, 0.00, 1, 0, 0, 1],
    [5, 0.00, 40, 0.00, 38, 0.00, 1, 0, 0, 1], [2, 0.00, 45, 0.00, 33, 0.00, 1, 0, 0, 1], [3, 0.00, 36, 0.00, 16, 0.00, 1, 0, 0, 1],
    [2, 0.00, 40, 0.00, 2, 1.00, 1, 0, 0, 0], [3, 0.00, 45, 0.00, 1, 1.00, 1, 0, 0, 0], [2, 0.00, 2, 1.00, 1, 1.00, 1, 0, 0, 0],
    # lists of links
    [1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0], [2, 1.00, 3, 1.00, 1, 1.00, 0, 0, 0, 0], [5, 1.00, 4, 1.00, 6, 1.00, 0, 0, 0, 0],
    [8, 1.00, 7, 1.00, 30, 0.00, 0, 0, 0, 0], [3, 0.67, 2, 1.00, 4, 1.00, 0, 0, 0, 0], [12, 0.90, 10, 1.00, 11, 0.80, 0, 0, 0, 0],
    [2, 1.00, 40, 0.00, 2, 1.00, 0, 1, 0, 0], [3, 1.00, 2, 1.00, 3, 1.00, 0, 1, 0, 0], [6, 0.83, 5, 1.00, 6, 1.00, 0, 1, 0, 0],
    [25, 0.70, 12, 0.90, 8, 1.00, 0, 0, 0, 0], [20, 0.60, 40, 0.00, 15, 0.80, 0, 0, 0, 0], [1, 1.00, 0, 0.00, 9, 0.00, 0, 0, 0, 0],
    # short loose lines outside an article
    [2, 0.00, 1, 1.00, 2, 0.00, 0, 0, 0, 0], [4, 0.00, 3, 1.00, 5, 0.50, 0, 0, 0, 0], [7, 0.00, 90, 0.00, 2, 1.00, 0, 0, 0, 0],
    [6, 0.17, 4, 1.00, 0, 0.00, 0, 0, 0, 0], [5, 0.00, 3, 0.00, 6, 0.00, 0, 0, 0, 0], [8, 0.00, 0, 0.00, 3, 1.00, 0, 0, 0, 0],
    [9, 0.00, 5, 0.00, 7, 0.00, 0, 0, 0, 0], [3, 0.00, 12, 1.00, 40, 0.00, 0, 0, 0, 0], [9, 0.20, 60, 0.00, 0, 0.00, 0, 0, 0, 0],
    # inside marked elements, however long and however close to text
    [9, 0.00, 1, 1.00, 12, 0.00, 0, 0, 1, 0], [30, 0.00, 1, 1.00, 40, 0.00, 0, 0, 1, 0], [55, 0.02, 60, 0.00, 48, 0.00, 0, 1, 1, 0],
    [14, 0.00, 70, 0.00, 33, 0.00, 0, 1, 1, 0], [80, 0.00, 90, 0.00, 0, 0.00, 0, 0, 1, 0], [3, 0.00, 20, 0.00, 25, 0.00, 1, 1, 1, 0],
    [2, 0.00, 18, 0.00, 4, 0.00, 1, 0, 1, 0], [1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 1, 0], [25, 0.00, 3, 0.00, 31, 0.00, 0, 0, 1, 0],
    [45, 0.00, 38, 0.00, 52, 0.00, 0, 0, 1, 0], [110, 0.05, 30, 0.00, 25, 0.00, 0, 1, 1, 0], [6, 0.00, 44, 0.00, 39, 0.00, 0, 1, 1, 0],
])

_WORDS = "|".join("""ads? advert\\w* sponsor\\w* promo\\w* banner\\w* sidebar\\w* widget\\w* menu\\w* nav\\w* breadcrumb\\w* masthead cookies? consent gdpr
    notices? alerts? popup modal overlay newsletter subscri\\w* signup login share\\w* social related recommend\\w* trending comments? replies reply
    respond disqus search pagination pager copyright legal disclaimer toolbar skip hidden tagcloud meta byline""".split())
_MARK = re.compile(rf"(?:^|[^a-z])(?:{_WORDS})(?![a-z])")
# Names and elements that may as well wrap a whole page.
_EDGE = re.compile(r"(?:^|[^a-z])(?:header|footer|top|bottom)(?![a-z])")
_FORM = re.compile(r"(?:^|[^a-z])forms?(?![a-z])")
_WRAPS = 0.5   # share of a page's words beyond which such an element is a wrapper and no mark
_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu"}
_BODY = re.compile(r"(?:^|[^a-z])(?:article|content|story|post|entry)[-_]?(?:body|text|content|main)?(?![a-z])")
_NESTED = set("div section article main nav header footer aside form ul ol table tbody tr td th blockquote figure dl details center span p li".split())
_BREAK = set("""p div section article main nav header footer aside form ul ol li table thead tbody tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre
    figure figcaption dl dt dd hr body html fieldset legend address details summary center option title label""".split())
_MARKED = {"nav", "aside", "footer", "header", "menu", "dialog"}
_FORMS = {"form", "fieldset"}
_SILENT = "script|style|noscript|template|textarea|select|button|svg|math|iframe|object|canvas|video|audio|title"
# A quote only holds a ">" where an attribute's value begins; elsewhere it is a stray one.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_SILENT})\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*?)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")


def _kind(tag: str, attributes: str, in_article: bool) -> str:
    """``marked``, ``weak`` (marked unless it wraps the page), ``article`` or nothing, for an element."""
    if tag in ("article", "main"):
        return "article"
    if tag in _MARKED:
        return "" if in_article and tag in ("header", "footer") else "marked"
    if tag in _FORMS:
        return "weak"
    if not attributes.strip() or tag in ("body", "html"):
        return ""
    names = []
    for key, *value in _ATTRIBUTE.findall(attributes):
        key, text = key.lower(), " ".join(value[:3]).strip()
        if value[3] or key == "aria-hidden" and text == "true" or key == "style" and re.search(r"display\s*:\s*none", text):
            return "marked"
        if key == "role" and text.lower() in _ROLE:
            return "marked"
        if key == "role" and text.lower() == "form":
            return "weak"
        if key in ("class", "id"):
            names.append(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", text).lower())
    joined = " ".join(names)
    if _MARK.search(joined):
        return "marked"
    if _FORM.search(joined) or not in_article and _EDGE.search(joined):
        return "weak"
    return "article" if tag in ("div", "section", "td") and _BODY.search(joined) else ""


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """A page's blocks in order, and their features.

    Whether a weak mark counts is known when the page has been read: an element that holds most of its words is a wrapper.
    """
    texts: list[str] = []
    rows: list[list[float]] = []
    under: list[tuple[int, ...]] = []      # weakly marked elements around each block
    stack: list[tuple[str, str]] = []
    parts: list[tuple[str, bool]] = []
    weak: list[int] = []
    links = heading = marked = inside = seen = 0

    def close() -> None:
        nonlocal parts
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = len(html.unescape(" ".join(p for p, a in parts if a)).split())
            n = text.count(" ") + 1
            texts.append(text)
            rows.append([n, min(1.0, linked / n), 0, 0, 0, 0, heading, inside > 0, marked > 0])
            under.append(tuple(weak))
        parts = []

    def leave() -> str:
        nonlocal marked, inside
        name, kind = stack.pop()
        marked, inside = marked - (kind == "marked"), inside - (kind == "article")
        if kind == "weak":
            weak.pop()
        return name

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in _BREAK:
            close()
        if tag == "br":
            parts.append((" ", False))
        elif tag == "a":
            links = max(0, links - 1) if m[2] else 1
        elif re.fullmatch("h[1-6]", tag):
            heading = 0 if m[2] else 1
        if tag in _BREAK and tag != "a":
            links = links if tag in ("li", "span", "div", "p") else 0
        if tag in _NESTED or tag in _MARKED or tag in _FORMS:
            if not m[2]:
                if not m[4].rstrip().endswith("/"):
                    if tag in ("p", "li") and stack and stack[-1][0] == tag:
                        leave()
                    kind = _kind(tag, m[4], inside > 0)
                    if kind in ("marked", "weak") and tag == "span":
                        close()
                    stack.append((tag, kind))
                    marked, inside = marked + (kind == "marked"), inside + (kind == "article")
                    if kind == "weak":
                        weak.append(seen)
                        seen += 1
            elif any(t == tag for t, _ in stack):
                if tag == "span" and stack[-1][0] == "span" and stack[-1][1] in ("marked", "weak"):
                    close()
                while leave() != tag:
                    pass
    if at < len(page):
        parts.append((page[at:], links > 0))
    close()
    x = np.array(rows, dtype=float).reshape(-1, len(FEATURES))
    if seen:
        words = x[:, 0] * (1 - x[:, 1])
        held = np.zeros(seen)
        for n, around in zip(words, under, strict=True):
            for w in around:
                held[w] += n
        small = held <= _WRAPS * words.sum()
        for k, around in enumerate(under):
            if any(small[w] for w in around):
                x[k, 8] = 1
    if len(x):
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
    return texts, x


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A tree of Gini splits: ``(feature, threshold, low, high)``, or the label of a leaf."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() > len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= t
            impurity = sum(p.sum() * (1 - p.sum() / len(p)) for p in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, t, low)
    if best is None:
        return int(2 * y.sum() > len(y))
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def decide(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, below, above = tree
    low = x[:, f] <= t
    out = np.empty(len(x), int)
    out[low], out[~low] = decide(below, x[low]), decide(above, x[~low])
    return out


@cache
def tree():
    return grow(EXAMPLES[:, :-1], EXAMPLES[:, -1])


def main_text(page: str | None) -> str:
    texts, x = blocks(page or "")
    return " ".join(t for t, good in zip(texts, decide(tree(), x), strict=True) if good)


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [main_text(p) for p in batch["html"]]
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    Null and empty pages, and pages without an article, give an empty text. Null ids and urls stay
    null, repeated rows get a row each, pages are read whole, no rows give none.
    """
    by_batches(pages.sparkSession, 500)
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return rows.mapInPandas(_extracted, "page_id long, url string, text string, n_chars long")
