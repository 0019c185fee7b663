"""HTML, SVG and CSS pieces as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_html


def number(c: Column) -> Column:
    """A number with three decimals at most and no empty ones."""
    return F.rtrim(F.rtrim(F.round(c, 3).cast("decimal(20,3)").cast("string"), F.lit("0")), F.lit("."))


def px(c: Column) -> Column:
    return F.concat(number(c), F.lit("px"))


def attributes(pairs: dict[str, Column]) -> Column:
    """`` name="value"`` of those that are not null."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f' {k}="'), v, F.lit('"')), F.lit("")) for k, v in pairs.items()])


def element(tag: Column | str, content: Column, pairs: dict[str, Column] | None = None) -> Column:
    name = F.lit(tag) if isinstance(tag, str) else tag
    return F.concat(F.lit("<"), name, attributes(pairs or {}), F.lit(">"), content, F.lit("</"), name, F.lit(">"))


def style_key(size: Column, color: Column, weight: Column, style: Column, decoration: Column | None = None) -> Column:
    """Declarations of a visual style in the order of their names; what is plain is left out."""
    parts = [F.concat(F.lit("color:"), color), F.concat(F.lit("font-size:"), px(size)), F.when(style != "normal", F.concat(F.lit("font-style:"), style)), F.when(weight != 400, F.concat(F.lit("font-weight:"), weight.cast("string")))]
    if decoration is not None:
        parts.append(F.when(decoration != "none", F.concat(F.lit("text-decoration:"), decoration)))
    return F.concat_ws(";", *parts)


def css_rule(name: Column, key: Column) -> Column:
    """A rule of a style key."""
    return F.concat(F.lit("."), name, F.lit(" { "), F.replace(key, F.lit(";"), F.lit("; ")), F.lit("; }"))


def positioned_text(text: Column, x: Column, top: Column, height: Column, cls: Column, tag: Column | str = "span", rotation: Column | None = None) -> Column:
    turn = F.lit("") if rotation is None else F.when(F.abs(rotation) > 0.01, F.concat(F.lit("; transform: rotate("), number(rotation), F.lit("deg)"))).otherwise("")
    place = F.concat(F.lit("position: absolute; left: "), px(x), F.lit("; top: "), px(top), F.lit("; line-height: "), px(F.greatest(F.lit(1.0), F.floor(height + 0.5))), turn)
    return element(tag, escape_html(text), {"class": cls, "style": place})


def svg_safe(text: Column, width: Column, size: Column) -> Column:
    """Text that can be stretched to its width: two characters or more, a width within 0.3 and 3 of the usual, a size up to 72."""
    ratio = width / (F.length(text) * size * 0.6)
    return (F.length(F.trim(text)) >= 2) & F.coalesce((ratio >= 0.3) & (ratio <= 3), F.lit(True)) & (size <= 72)


def svg_text(text: Column, x: Column, baseline: Column, width: Column, size: Column, color: Column) -> Column:
    look = F.concat(F.lit("font-size: "), px(size), F.lit("; fill: "), color)
    return element("text", escape_html(text), {"x": number(x), "y": number(baseline), "textLength": number(F.greatest(F.lit(0.0), width)), "lengthAdjust": F.lit("spacing"), "style": look})


def graphic(kind: Column, path: Column, x: Column, y: Column, width: Column, height: Column, stroke: Column, fill: Column, stroke_width: Column) -> Column:
    """An SVG element of a graphic; empty where it lacks its shape."""
    look = attributes({"stroke": stroke, "fill": F.coalesce(fill, F.lit("none")), "stroke-width": F.when(stroke_width != 0, number(stroke_width))})
    shape = (
        F.when(kind.isin("path", "curve"), F.concat(F.lit('<path d="'), path, F.lit('"'), look, F.lit(" />")))
        .when(kind == "rectangle", F.concat(F.lit("<rect"), attributes({"x": number(x), "y": number(y), "width": number(width), "height": number(height)}), look, F.lit(" />")))
        .when(kind == "circle", F.concat(F.lit("<circle"), attributes({"cx": number(x + width / 2), "cy": number(y + width / 2), "r": number(width / 2)}), look, F.lit(" />")))
        .when(kind == "line", F.concat(F.lit("<line"), attributes({"x1": number(x), "y1": number(y), "x2": number(x + width), "y2": number(y + height)}), look, F.lit(" />")))
    )
    return F.coalesce(shape, F.lit(""))


def placed_box(x: Column, top: Column, width: Column, height: Column) -> Column:
    return F.concat(F.lit("position: absolute; left: "), px(x), F.lit("; top: "), px(top), F.lit("; width: "), px(width), F.lit("; height: "), px(height))


def image(src: Column, x: Column, top: Column, width: Column, height: Column) -> Column:
    return F.concat(F.lit("<img"), attributes({"src": escape_html(F.coalesce(src, F.lit("#"))), "alt": F.lit(""), "style": placed_box(x, top, width, height)}), F.lit(" />"))


def form_field(kind: Column, name: Column, value: Column, checked: Column, style: Column) -> Column:
    """A control of a form; names and values are escaped."""
    own = {"name": escape_html(name)}
    box = lambda t: F.concat(F.lit("<input"), attributes({"type": F.lit(t), **own, "style": style}), F.when(F.coalesce(checked, F.lit(False)), " checked").otherwise(""), F.lit(" />"))
    said = escape_html(F.coalesce(value, F.lit("")))
    return (
        F.when(kind == "text", F.concat(F.lit("<input"), attributes({"type": F.lit("text"), **own, "value": said, "style": style}), F.lit(" />")))
        .when(kind == "checkbox", box("checkbox"))
        .when(kind == "radio", box("radio"))
        .when(kind == "button", element("button", said, {**own, "style": style}))
        .when(kind == "dropdown", element("select", element("option", said), {**own, "style": style}))
        .otherwise("")
    )


def annotation(kind: Column, content: Column, url: Column, style: Column) -> Column:
    """A mark on the page; a link without a target is nothing."""
    said = escape_html(F.coalesce(content, F.lit("")))
    mark = lambda tag, extra: element(tag, said, {"class": F.concat(F.lit("annotation-"), kind), "style": F.concat(style, F.lit(extra))})
    return (
        F.when((kind == "link") & url.isNotNull(), element("a", said, {"href": escape_html(url), "style": style}))
        .when(kind == "note", element("div", F.lit("📝"), {"class": F.lit("annotation-note"), "style": style, "title": said}))
        .when(kind == "highlight", mark("div", "; background: yellow; opacity: 0.3"))
        .when(kind == "underline", mark("span", "; text-decoration: underline"))
        .when(kind == "strikeout", mark("span", "; text-decoration: line-through"))
        .otherwise("")
    )
