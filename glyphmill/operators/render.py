"""Rendering: pages and documents as HTML, SVG, CSS and plain text by ordered aggregation of fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HtmlOptions
from ..functions import fonts as N
from ..functions import markup as M
from ..functions import text as X
from ..schema import PAGE_HEIGHT, PAGE_WIDTH

PAGE = ["doc_id", "page_no"]
#: Layers of a page from the back to the front.
LAYERS = {"graphics": 0, "images": 1, "text": 2, "forms": 3, "annotations": 4}


def joined(value: Column, order: list[Column | str], glue: str) -> Column:
    """Ordered string aggregation."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("said_")))), lambda x: x["said_"]), glue)


def with_style_classes(items: DataFrame, key: Column, prefix: str = "s") -> DataFrame:
    """Numbers the styles of each document by where they are first seen: style_key, style_class."""
    rows = items.withColumn("style_key", key)
    first = rows.groupBy("doc_id", "style_key").agg(F.min(F.struct("page_no", "line_no", "word_no")).alias("first"))
    numbered = first.withColumn("style_class", F.concat(F.lit(prefix), (F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1).cast("string"))).drop("first")
    return rows.join(numbered, ["doc_id", "style_key"])


def style_sheet(styled: DataFrame) -> DataFrame:
    """One rule for each style of a document, in the order of their numbers."""
    rows = styled.select("doc_id", "style_key", "style_class").distinct()
    n = F.regexp_replace("style_class", "[^0-9]", "").cast("int")
    return rows.groupBy("doc_id").agg(joined(M.css_rule(F.col("style_class"), F.col("style_key")), [n.alias("n")], "\n").alias("css"))


def absolute_text(styled: DataFrame) -> DataFrame:
    """Fragments (page keys, layer, seq, html) of words placed one by one."""
    tag = F.when(F.col("font_style") != "normal", "em").when(F.col("font_weight") >= 600, "strong").otherwise("span")
    html = M.positioned_text(F.col("text"), F.col("x"), PAGE_HEIGHT - (F.col("y") + F.col("height")), F.greatest("height", F.col("font_size") * 1.15), F.col("style_class"), tag)
    return styled.select(*PAGE, F.lit(LAYERS["text"]).alias("layer"), (F.col("line_no").cast("long") * 100_000 + F.col("word_no")).cast("long").alias("seq"), html.alias("html"))


def pages_html(fragments: DataFrame) -> DataFrame:
    """Fragments of all layers to one string a page."""
    rows = fragments.groupBy(*PAGE).agg(joined(F.col("html"), ["layer", "seq"], "").alias("body"))
    frame = F.concat(F.lit('<div class="page page-'), (F.col("page_no") + 1).cast("string"), F.lit(f'" style="position: relative; width: {PAGE_WIDTH:g}px; height: {PAGE_HEIGHT:g}px">'), F.col("body"), F.lit("</div>"))
    return rows.select(*PAGE, frame.alias("html"))


def documents_html(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """Pages to documents (doc_id, page_count); a page without content stands as an empty one."""
    every = counts.where("page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page_no"))
    empty = F.concat(F.lit('<div class="page page-'), (F.col("page_no") + 1).cast("string"), F.lit(f'" style="position: relative; width: {PAGE_WIDTH:g}px; height: {PAGE_HEIGHT:g}px"></div>'))
    rows = every.join(pages.select("doc_id", F.col("page_no").cast("int").alias("page_no"), "html"), PAGE, "left").withColumn("html", F.coalesce("html", empty))
    return rows.groupBy("doc_id").agg(joined(F.col("html"), ["page_no"], "\n").alias("html"))


def page_shell(title: Column, body: Column, css: Column, options: HtmlOptions) -> Column:
    """A whole document; the style stands in the head, or a link to it."""
    head = F.concat(F.lit("<style>"), css, F.lit("</style>")) if options.format == "html+inline-css" else F.lit('<link rel="stylesheet" href="styles.css" />' if options.format == "html+css" else "")
    return F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8" /><title>'), X.escape_html(title), F.lit("</title>"), head, F.lit("</head>\n<body>"), body, F.lit("</body></html>"))


def base_css(options: HtmlOptions, pages: list[tuple[int, float, float]]) -> str:
    """The sections that depend on options and page sizes only."""
    parts = []
    if options.include_reset:
        parts += ["* { margin: 0; padding: 0; box-sizing: border-box; }", "body { font-family: system-ui, sans-serif; line-height: 1.6; color: #333; background-color: #fff; }", ".font-default { font-family: Arial, Helvetica, sans-serif; }"]
    parts.append(".content { margin: 0; padding: 0; }" if options.preserve_layout else ".content { max-width: 100%; margin: 0 auto; padding: 20px; }")
    if options.responsive:
        parts.append(f"@media (max-width: 768px) {{ .content {{ padding: {'0' if options.preserve_layout else '10px'}; }} }}")
    if options.preserve_layout:
        parts += [f".page-{n + 1} {{ width: {w:g}px; height: {h:g}px; aspect-ratio: {w / h:.6g}; position: relative; }}" for n, w, h in pages]
    if options.dark_mode:
        parts.append("@media (prefers-color-scheme: dark) { body { background-color: #1a1a1a; color: #e0e0e0; } .page { background-color: #2a2a2a; } }")
    if options.include_print:
        parts.append("@media print { body { background: white; color: black; } .page { page-break-after: always; } @page { margin: 0; } }")
    if options.custom_styles:
        parts.append(options.custom_styles)
    return "\n\n".join(parts)


def font_imports(mappings: DataFrame) -> DataFrame:
    """(doc_id, web_family, weight, seq) -> one import of all families with their weights in hundreds, families as first seen."""
    weight = F.greatest(F.lit(100), F.least(F.lit(900), (F.floor(F.col("weight") / 100 + 0.5) * 100).cast("int")))
    rows = mappings.where("trim(web_family) <> ''").groupBy("doc_id", "web_family").agg(F.min("seq").alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_set(weight)), lambda w: w.cast("string")), ";").alias("weights"))
    part = F.concat(F.lit("family="), F.replace(F.url_encode("web_family"), F.lit("%20"), F.lit("+")), F.lit(":wght@"), F.col("weights"))
    out = rows.groupBy("doc_id").agg(joined(part, ["seq"], "&").alias("families"))
    return out.select("doc_id", F.concat(F.lit("@import url('https://fonts.googleapis.com/css2?"), F.col("families"), F.lit("&display=swap');")).alias("css"))


def font_rules(mappings: DataFrame) -> DataFrame:
    """A class for each web family of a document: slug, quoted family, fallbacks."""
    rows = mappings.groupBy("doc_id", "web_family").agg(F.min("seq").alias("seq"), F.min("fallback_chain").alias("fallback_chain"))
    rule = F.concat(F.lit(".font-"), N.class_suffix(F.col("web_family")), F.lit(" { font-family: "), N.quoted(F.col("web_family")), F.lit(", "), F.col("fallback_chain"), F.lit("; }"))
    return rows.groupBy("doc_id").agg(joined(rule, ["seq"], "\n").alias("css"))


def semantic_html(lines: DataFrame) -> DataFrame:
    """Lines of paragraphs (with region_no, paragraph_no, heading) to headings, lists and paragraphs, one string a page.

    A line with a marker is a list item; neighbouring items of a kind share a list; a paragraph of one heading line is a
    heading; soft hyphens at joins go.
    """
    keys = [*PAGE, "region_no", "paragraph_no"]
    order = ["top", "min_x", "line_no"]
    rows = lines.withColumn("kind", X.list_marker(F.col("text")))
    items = rows.where("kind is not null").select(*keys, *order, "kind", M.element("li", X.escape_html(X.strip_marker(F.col("text")))).alias("html"))
    prose = rows.where("kind is null").withColumn("after", F.lead("join_with").over(Window.partitionBy(*keys).orderBy(*order)))
    piece = X.escape_html(F.when(F.col("after") == "hyphenation", X.without_soft_hyphen(F.col("text"))).otherwise(F.col("text")))
    piece = F.concat(F.when(F.col("join_with").isNotNull(), "").otherwise(" "), piece)
    blocks = prose.groupBy(*keys).agg(joined(piece, order, "").alias("said"), F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"), F.max("heading").alias("level"))
    tag = F.when((F.col("n") == 1) & F.col("level").isNotNull(), F.concat(F.lit("h"), F.col("level").cast("string"))).otherwise("p")
    blocks = blocks.select(*keys, "first.*", F.lit("block").alias("kind"), M.element(tag, F.ltrim(F.col("said"))).alias("html"))
    both = items.unionByName(blocks)
    w = Window.partitionBy(*PAGE).orderBy(*order)
    both = both.withColumn("run", F.sum(F.when((F.col("kind") == "block") | (F.col("kind") != F.lag("kind").over(w)) | F.lag("kind").over(w).isNull(), 1).otherwise(0)).over(w))
    runs = both.groupBy(*PAGE, "run", "kind").agg(joined(F.col("html"), order, "\n").alias("html"))
    whole = F.when(F.col("kind") == "block", F.col("html")).otherwise(M.element(F.col("kind"), F.concat(F.lit("\n"), F.col("html"), F.lit("\n"))))
    return runs.groupBy(*PAGE).agg(joined(whole, ["run"], "\n\n").alias("html"))


def page_text(lines: DataFrame) -> DataFrame:
    """Plain text of documents: lines by newline (without one where a line continues the one before), pages by an empty line."""
    order = ["top", "min_x", "line_no"]
    before = F.lag("text").over(Window.partitionBy(*PAGE).orderBy(*order))
    rows = lines.withColumn("glue", F.when(before.isNull() | X.continues(F.rtrim(before), F.ltrim("text")), "").otherwise("\n"))
    pages = rows.groupBy(*PAGE).agg(joined(F.concat("glue", "text"), order, "").alias("text"))
    return pages.where("text <> ''").groupBy("doc_id").agg(joined(F.col("text"), ["page_no"], "\n\n").alias("text"))


def table_html(cells: DataFrame) -> DataFrame:
    """(doc_id, row_no, col, text) -> a table: cells to rows to the whole."""
    rows = cells.groupBy("doc_id", "row_no").agg(M.element("tr", joined(M.element("td", X.escape_html(F.col("text"))), ["col"], "")).alias("html"))
    return rows.groupBy("doc_id").agg(M.element("table", joined(F.col("html"), ["row_no"], "\n")).alias("html"))


def svg_layer(items: DataFrame) -> DataFrame:
    """Text that an SVG layer may hold, and how many items must stay HTML."""
    safe = M.svg_safe(F.col("text"), F.col("width"), F.col("font_size"))
    text = M.svg_text(F.col("text"), F.col("x"), PAGE_HEIGHT - F.col("y"), F.col("width"), F.col("font_size"), F.col("color"))
    seq = (F.col("line_no").cast("long") * 100_000 + F.col("word_no")).alias("seq")
    rows = items.select(*PAGE, seq, safe.alias("safe"), text.alias("text"))
    out = rows.groupBy(*PAGE).agg(joined(F.when(F.col("safe"), F.col("text")).otherwise(""), ["seq"], "").alias("body"), F.count_if(~F.col("safe")).alias("n_html"))
    return out.select(*PAGE, "n_html", F.concat(F.lit(f'<svg width="{PAGE_WIDTH:g}" height="{PAGE_HEIGHT:g}">'), F.col("body"), F.lit("</svg>")).alias("svg"))


def flex_lines(words: DataFrame, space: float = 0.35) -> DataFrame:
    """Words of a line as flex items: each with the space that it keeps from what is before it."""
    keys = [*PAGE, "line_no"]
    before = Window.partitionBy(*keys).orderBy("x", "word_no").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("x").over(Window.partitionBy(*keys))
    gap = F.greatest(F.lit(0.0), F.col("x") - F.coalesce(F.max(F.col("x") + F.col("width")).over(before), first))
    item = M.element("span", X.escape_html(F.col("text")), {"style": F.when(gap > F.col("font_size") * space, F.concat(F.lit("margin-left: "), M.px(gap)))})
    rows = words.select(*keys, "word_no", "x", item.alias("item"), first.alias("first"))
    return rows.groupBy(*keys, "first").agg(joined(F.col("item"), ["x", "word_no"], " ").alias("body")).select(*keys, F.concat(F.lit('<div class="line" style="display: flex; padding-left: '), M.px(F.col("first")), F.lit('">'), F.col("body"), F.lit("</div>")).alias("html"))


def token_html(tokens: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Tokens of a line (text, space before it, class) as inline HTML: a span for each piece, plain spaces between."""
    span = M.element("span", X.escape_html(F.col("text")), {"class": F.col("cls")})
    piece = F.concat(F.when(F.col("space"), " ").otherwise(""), span)
    return tokens.groupBy(*keys).agg(joined(piece, list(order), "").alias("html"))
