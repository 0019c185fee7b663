"""Absolutely placed HTML to rows of flex boxes: markup is read back into a table of elements, clustered and written again.

A page is cut into tags and texts and walked once: a closing tag belongs to the tag before it on its depth, and the offset of
an element is the running sum of the offsets of all tags that are still open.  A page costs its own length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import folds

PAGE = ["doc_id", "page_no"]
#: Size of text without one; shares of a size for a character's width and a line's height.
USUAL, CHAR, LINE = 12.0, 0.55, 1.15
#: Distance of tops within a row, and the least gap that gets a spacer.
ROW, GAP = 8.0, 0.5
ELEMENTS = "item_no long, tag string, body string, x double, top double, width double, height double"
PAGES = "n_rows long, n_spacers long, widths double, heights double, html string"

_SPACE = " \t\n\x0b\f\r"
_PIECE = re.compile("<[^>]+>|[^<]+")
_VOID = re.compile(r"<(br|img|input|hr|meta|link)\b", re.I)
_DECLARED = re.compile(r"(?:^|;)\s*(left|top|width|height|line-height):\s*(-?[0-9]*\.?[0-9]+)", re.A)
_NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
_SPACES = re.compile(r"\s+", re.A)
_ABSOLUTE = re.compile(r"position:\s*absolute", re.A)
_PLACE = re.compile(r";\s*(?:left|top):[^;\"]*", re.A)
_LAYOUT = re.compile(r"\b(gap|region|line)\b")
_NAME = re.compile(r"<(\w+)", re.A)


def attribute(tag: str, name: str) -> str:
    """Value of an attribute; empty without it."""
    key = name + '="'
    at = tag.find(key)
    while at > 0:
        if tag[at - 1] in _SPACE:
            start = at + len(key)
            end = tag.find('"', start)
            return tag[start:end] if end >= 0 else ""
        at = tag.find(key, at + 1)
    return ""


def declared(style: str) -> dict[str, float]:
    """Lengths of a style in px by their names: left, top, width, height, line-height; the first of each counts."""
    return {name: float(value) for name, value in reversed(_DECLARED.findall(style))}


@lru_cache(10_000)
def usual_size(size: str) -> float:
    """A font size; the usual one for what is no positive finite number."""
    size = size.strip(_SPACE)
    value = float(size) if _NUMBER.fullmatch(size) else 0.0
    return value if 0 < value < math.inf else USUAL


def _half_up(v: float) -> float:
    return math.floor(v * 1000 + 0.5) / 1000.0


def text_width(text: str, size: float) -> float:
    return max(1.0, _half_up(len(_SPACES.sub(" ", text)) * max(2.0, size * CHAR)))


@lru_cache(10_000)
def text_height(size: float) -> float:
    return max(1.0, _half_up(size * LINE))


@lru_cache(10_000)
def _of_layout(cls: str) -> bool:
    return bool(_LAYOUT.search(cls))


def is_adaptable(tag: str, style: str) -> bool:
    """Placed text with a known font that is no spacer, region or line of a layout."""
    return bool(_ABSOLUTE.search(style)) and attribute(tag, "data-font-family") != "" and not _of_layout(attribute(tag, "class"))


def in_flow(tag: str) -> str:
    """The tag with a relative position and without left and top."""
    return _PLACE.sub("", _ABSOLUTE.sub("position: relative", tag))


def unescaped(text: str) -> str:
    if "&" in text:
        for name, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            text = text.replace(name, raw)
    return text


def px(v: float) -> str:
    """As ``markup.px``: three decimals at most, halves go away from zero."""
    if v.is_integer():
        return f"{int(v)}px"
    part = abs(v * 1000) % 1
    said = str(Decimal(repr(v)).quantize(Decimal("0.001"), ROUND_HALF_UP)) if 0.25 < part < 0.75 else f"{v:.3f}"
    return f"{said.rstrip('0').rstrip('.')}px"


def page_elements(html: str | None) -> list[tuple]:
    """Adaptable elements of a page, the columns of ``ELEMENTS``; positions within the page."""
    pieces = _PIECE.findall(html or "")
    out: list[tuple] = []
    depth, x, top = 0, 0.0, 0.0
    last: dict[int, tuple[float, float] | None] = {}  # of each depth the offsets of the tag before, none after a closing one
    for i, tag in enumerate(pieces):
        if tag[0] != "<":
            continue
        if tag[1] == "/":
            if own := last.get(depth):
                x, top = x - own[0], top - own[1]
            last[depth] = None
            depth -= 1
            continue
        if tag[1] == "!" or tag.endswith("/>") or _VOID.match(tag):
            continue
        depth += 1
        style = attribute(tag, "style")
        if not style:
            last[depth] = None
            continue
        said = declared(style)
        own = last[depth] = said.get("left", 0.0), said.get("top", 0.0)
        x, top = x + own[0], top + own[1]
        if not is_adaptable(tag, style):
            continue
        body = pieces[i + 1] if i + 1 < len(pieces) and pieces[i + 1][0] != "<" else ""
        size = usual_size(attribute(tag, "data-font-size"))
        width, line, tall = said.get("width", 0.0), said.get("line-height", 0.0), text_height(size)
        out.append((i, tag, body, x, top, width if width > 0 else text_width(unescaped(body), size), max(said.get("height", 0.0), line if line > 0 else tall, tall)))
    return out


def page_rows(found: list[tuple]) -> list[tuple]:
    """Elements of a page (``ELEMENTS``) as the flex rows of ``PAGES``; nothing without any.

    Rows go from the top, each anchored at the top of its first element; within a row a gap is what lies between an element
    and the farthest end before it.
    """
    if not found:
        return []
    rows: list[list[tuple]] = []
    anchor = None
    for e in sorted(found, key=lambda e: (e[4], e[3], e[0])):
        if anchor is None or e[4] - anchor > ROW:
            rows.append([])
            anchor = e[4]
        rows[-1].append(e)
    html = ['<div data-layout-adapter="flex" style="display: flex; flex-direction: column; align-items: flex-start; gap: 0; position: relative; width: 100%">']
    spacers, widths, heights = 0, 0.0, 0.0
    for k, row in enumerate(rows):
        top, end = row[0][4], 0.0
        html.append('<div style="display: flex; align-items: flex-start; gap: 0; position: relative">')
        row.sort(key=lambda e: (e[3], e[4], e[0]))
        for _, tag, body, x, _, width, _ in row:
            gap = x - end
            if gap > GAP:
                spacers, widths = spacers + 1, widths + gap
                html.append(f'<div class="gap" style="width: {px(gap)}; flex-shrink: 0"></div>')
            name = _NAME.match(tag)
            html.append(f"{in_flow(tag)}{body}</{name[1] if name else ''}>")
            end = max(end, x + max(0.0, width))
        html.append("</div>")
        if k + 1 < len(rows) and (below := rows[k + 1][0][4] - (top + max(e[6] for e in row))) > GAP:
            spacers, heights = spacers + 1, heights + below
            html.append(f'<div style="height: {px(below)}; flex-shrink: 0"></div>')
    html.append("</div>")
    return [(len(rows), spacers, widths, heights, "".join(html))]


def _of_pages(pages: DataFrame, read: Callable[[str | None], list[tuple]], schema: str) -> DataFrame:
    """``read`` over the html of each page; its results get the page's keys in front.  A batch goes out before its html is large."""
    types = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in PAGE)
    schema = f"{types}, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for *key, html in zip(*batch.columns, strict=True):
                said = html.as_py()
                out += [(*(k.as_py() for k in key), *r) for r in read(said)]
                held += len(said or "")
                if out and held >= 8_000_000:
                    yield table(out)
                    out, held = [], 0
        if out:
            yield table(out)

    return pages.select(*PAGE, "html").mapInArrow(each, schema)


def elements(pages: DataFrame) -> DataFrame:
    """Adaptable elements of pages (keys, html): item_no, tag, body, x, top, width, height; positions within the page."""
    return _of_pages(pages, page_elements, ELEMENTS)


def flex_pages(found: DataFrame) -> DataFrame:
    """One row per page of elements: html, n_rows, n_spacers and the sums of their widths and heights."""
    names, made = [c.split()[0] for c in ELEMENTS.split(", ")], [c.split()[0] for c in PAGES.split(", ")]

    def fold(items: list[dict]) -> list[dict]:
        return [dict(zip(made, r, strict=True)) for r in page_rows([tuple(e[n] for n in names) for e in items])]

    return folds.per_page(found.select(*PAGE, *names), fold, PAGES)


def adapted(pieces: DataFrame, order: list[str], glue: str = "", opening: str = "", closing: str = "") -> DataFrame:
    """``flex_pages`` of the ``elements`` of pages that come in pieces of html (keys, html), joined in ``order``.

    One pass: a page is put together, read and written within its task, and is never a row of a shuffle or an aggregate.
    """
    made = [c.split()[0] for c in PAGES.split(", ")]

    def fold(page: pa.Table) -> dict[str, list]:
        html = glue.join(t for t in page.column("html").to_pylist() if t is not None)
        rows = page_rows(page_elements(f"{opening}{html}{closing}"))
        return {c: [r[i] for r in rows] for i, c in enumerate(made)}

    return folds.per_page_columns(pieces.select(*PAGE, *order, "html"), fold, PAGES, order)
