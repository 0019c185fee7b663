"""Main text of HTML pages by the distribution of line blocks.

Markup is stripped to lines, one for each block element; elements that are furniture by kind, role, class or id leave an
empty line where they were.  The length of a line block is the sum over WINDOW lines; text starts at a surge (a block
above SURGE characters with text going on) and ends at a dive (blocks without text), and all such spans are kept.  Marks
of an article are evidence on every page: spans end at its borders, its lines are one block, so that short lines and
furniture inside do not cut it, and its text counts MARKED times.  A page without any surge gives its marked lines, or
all lines.

A kept line has its character references decoded and its white space turned into single spaces; lines are joined by two
newlines.

Edge cases: null or empty html, and pages without text, give ""; unclosed and crossing tags, comments without end and
``<`` as text are read as browsers do, roughly; repeated rows get equal texts; an input column named like a result is
replaced by the result; an empty table gives no rows.
"""

from __future__ import annotations

import html as references
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_results

WINDOW, SURGE, MARKED = 3, 80, 2

#: Kinds of elements, and class or id words of furniture.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas textarea select button option head title".split())
FURNITURE = frozenset("nav footer aside form dialog menu".split())
RAW = frozenset("script style textarea title iframe noscript".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promotion promoted related replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z]+|\d+")


def _is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE or name == "header" and not in_article:
        return True
    if not attributes.strip() or name in ("html", "body", "article", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and not WORDS.isdisjoint(_NAME.findall(value)):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, number of the article around it or 0) of each line; furniture is an empty line."""
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, furniture, article
    hidden, article, articles, at, end = 0, 0, 0, 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append((text, article))

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if not hidden and not (m[0].startswith("<") and len(m[0]) > 1):
                parts.append(m[0])
            continue
        name = name.lower()
        if m[1]:
            known = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name in BLOCKS:
                flush()
            if known is not None:
                for closed, furniture, around in reversed(stack[known:]):
                    if furniture:
                        hidden -= 1
                        if not hidden:
                            lines.append(("", around))
                    del closed
                article = stack[known][2]
                del stack[known:]
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br" and not hidden:
                parts.append(" ")
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in BLOCKS:
            flush()
            if stack and name in ("p", "li", "td", "th", "tr", "dd", "dt"):
                alike = {"td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt")}.get(name, (name,))
                if stack[-1][0] in alike and not stack[-1][1]:  # closed by its next
                    stack.pop()
        if name not in BLOCKS and name not in SILENT and not m[3].strip():
            continue  # inline
        furniture = name in SILENT or _is_furniture(name, m[3], article > 0)
        if name not in BLOCKS and not furniture:
            continue
        if m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        if furniture:
            flush()
        stack.append((name, furniture, article))
        hidden += furniture
        if name in ("article", "main") and not hidden and not article:
            articles += 1
            article = articles
    flush()
    return lines


def _spans(lines: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """All spans from surge to dive; without a surge, the marked lines, or else all lines."""
    spans: list[tuple[int, int]] = []
    marked: list[tuple[int, int]] = []
    for article, group in groupby(range(len(lines)), key=lambda i: lines[i][1]):
        at, *rest = group
        n = at + 1 + len(rest)
        lengths = {i: len(lines[i][0]) for i in range(at, n)}
        if article:
            marked.append((at, n))
            if MARKED * sum(lengths.values()) > SURGE:
                spans.append((at, n))
            continue
        while at < n:
            if lengths[at] and sum(lengths.get(i, 0) for i in range(at, at + WINDOW)) > SURGE:
                end = at
                while end < n and (lengths[end] or lengths.get(end + 1, 0)):
                    end += 1
                spans.append((at, end))
                at = end
            at += 1
    return spans or (marked if any(lines[i][0] for lo, hi in marked for i in range(lo, hi)) else [(0, len(lines))])


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    return "\n\n".join(text for lo, hi in _spans(lines) for text, _ in lines[lo:hi] if text)


def text_of(html: Column) -> Column:
    return F.pandas_udf(lambda pages: pd.Series([main_text(p) for p in pages], dtype=object), "string")(html)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars in place of the html."""
    body = text_of(F.col(f"`{html}`"))
    rows = with_results(pages, {"text": body})
    return with_results(rows, {"n_chars": F.length("text").cast("long")}).drop(html)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("page_id", "url", "text", "n_chars")
