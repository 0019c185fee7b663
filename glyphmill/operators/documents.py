"""Roll-ups of pages to documents: scans, quality, presets, reports, lists, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import suggested_preset
from ..functions.text import is_title_case_or_caps

PAGE = ["doc_id", "page_no"]


def text_quality(items: DataFrame) -> DataFrame:
    """(doc_id, line_no, word_no, text) -> score between 0 and 1: long words count for, short ones and runs of fragments against; 1 under 80 characters."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "word_no", "text"))), lambda x: x["text"])
    rows = items.groupBy("doc_id").agg(
        F.array_join(ordered, " ").alias("joined"), F.count("*").alias("n_items"), F.count_if(F.col("text").rlike("[A-Za-z]")).alias("alpha_items"), F.count_if(F.col("text").rlike("^[A-Za-z]{1,2}$")).alias("short_items")
    )
    joined = F.trim(F.regexp_replace("joined", r"\s+", " "))
    rows = rows.withColumn("joined", joined).withColumn("alpha", F.filter(F.split("joined", " "), lambda w: w.rlike("^[A-Za-z]+$")))
    share = lambda keep: F.size(F.filter("alpha", keep)) / F.greatest(F.lit(1), F.size("alpha"))
    # possessive loops: Java's others recurse once a round and end the JVM on long runs
    edge, after = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    singles = F.regexp_count("joined", F.lit(rf"{edge}(?:[A-Za-z]\s+(?=[A-Za-z]{after})){{4,}}+[A-Za-z]"))
    fragments = F.regexp_count("joined", F.lit(rf"{edge}(?:[A-Za-z]{{1,2}}\s+(?=[A-Za-z]{{1,2}}{after})){{4,}}+[A-Za-z]{{1,2}}"))
    per_char = F.least(F.lit(1.0), F.col("n_items") / F.greatest(F.lit(1), F.length(F.replace("joined", F.lit(" "), F.lit("")))))
    penalty = F.least(F.lit(1.0), singles * 0.25 + fragments * 0.15 + F.col("short_items") / F.greatest(F.lit(1), F.col("alpha_items")) * 0.9 + per_char * 0.75)
    score = share(lambda w: F.length(w) >= 3) - share(lambda w: F.length(w) <= 2) * 0.6 - penalty
    return rows.select("doc_id", "n_items", F.when(F.length("joined") < 80, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("score"))


def better_text(first: DataFrame, second: DataFrame, least: float = 0.32, gain: float = 0.08) -> DataFrame:
    """Two readings of the same documents (doc_id, page_no, text, score): the second replaces the first where the first is poor and the second better by ``gain``, and has text."""
    b = second.select("doc_id", "page_no", F.col("text").alias("t2"), F.col("score").alias("s2"))
    rows = first.join(b, PAGE, "left")
    use = (F.col("score") < least) & (F.col("s2") > F.col("score") + gain) & (F.coalesce(F.col("t2"), F.lit("")) != "")
    return rows.select(*PAGE, F.when(F.coalesce(use, F.lit(False)), F.col("t2")).otherwise(F.col("text")).alias("text"), F.coalesce(use, F.lit(False)).alias("replaced"))


def page_figures(pages: DataFrame, texts: DataFrame, images: DataFrame) -> DataFrame:
    """Text length, items, images and image area of each page."""
    t = texts.groupBy(*PAGE).agg(F.sum(F.length("text")).alias("text_length"), F.count("*").alias("items"))
    i = images.groupBy(*PAGE).agg(F.count("*").alias("images"), F.sum(F.col("width") * F.col("height")).alias("image_area"))
    rows = pages.select(*PAGE, "width", "height").join(t, PAGE, "left").join(i, PAGE, "left")
    return rows.na.fill({"text_length": 0, "items": 0, "images": 0, "image_area": 0.0})


def document_figures(figures: DataFrame) -> DataFrame:
    return figures.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.sum("text_length").alias("text_length"),
        F.sum("items").alias("items"),
        F.sum("images").alias("images"),
        F.count_if(F.col("text_length") > 0).alias("pages_with_text"),
        F.count_if(F.col("images") > 0).alias("pages_with_images"),
        F.sum(F.col("width") * F.col("height")).alias("page_area"),
        F.sum("image_area").alias("image_area"),
        F.count_if((F.col("items") > 50) & (F.col("images") > 0)).alias("complex_pages"),
    )


def scan_analysis(documents: DataFrame) -> DataFrame:
    """Is a document a scan, and how sure: little text with many or large images, or images on most pages and text on few."""
    n = F.col("pages")
    text, images = F.col("text_length") / n, F.col("images") / n
    coverage = F.when(F.col("page_area") > 0, F.col("image_area") / F.col("page_area")).otherwise(0.0)
    with_images, with_text = F.col("pages_with_images") / n, F.col("pages_with_text") / n
    scanned = ((text < 50) & ((images >= 0.8) | (coverage > 0.3))) | ((with_images > 0.7) & (with_text < 0.3) & (images >= 0.8))
    bonus = lambda c, v: F.when(c, v).otherwise(0.0)
    sure = 0.5 + bonus(text < 20, 0.2) + bonus(images >= 1, 0.2) + bonus(coverage > 0.5, 0.15) + bonus((with_images > 0.9) & (with_text < 0.2), 0.15)
    confidence = F.when(scanned, F.least(F.lit(1.0), sure)).when(text > 200, 0.9).otherwise(0.5)
    return documents.withColumn("is_scanned", scanned).withColumn("confidence", confidence).withColumn("text_ratio", text / 1000).withColumn("image_ratio", images.cast("double"))


def presets(documents: DataFrame) -> DataFrame:
    """The preset that suits each document."""
    choice = suggested_preset(F.col("pages"), F.col("images"), F.col("items"), F.col("complex_pages"), F.col("is_scanned"))
    return documents.select("doc_id", choice.alias("c")).select("doc_id", "c.preset", "c.reason")


def image_statistics(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Images of each document: all, those that cover a page (nine tenths of both sides), those that are placed."""
    rows = images.join(pages.select(*PAGE, F.col("width").alias("pw"), F.col("height").alias("ph")), PAGE)
    full = (F.col("width") >= F.col("pw") * 0.9) & (F.col("height") >= F.col("ph") * 0.9)
    return rows.groupBy("doc_id").agg(F.count("*").alias("images"), F.count_if(full).alias("full_page"), F.count_if(~full & ((F.col("x") != 0) | (F.col("y") != 0))).alias("positioned"))


def report(figures: DataFrame, fonts: DataFrame) -> DataFrame:
    """A JSON report of each document: counts, flags, fonts, orientation of pages."""
    own = fonts.groupBy("doc_id").agg(F.array_sort(F.collect_set("font_family")).alias("fonts"))
    orientation = F.when(F.col("width") > F.col("height"), "landscape").when(F.col("width") < F.col("height"), "portrait").otherwise("square")
    pages = F.array_sort(F.collect_list(F.struct("page_no", "items", "images", orientation.alias("orientation"))))
    rows = figures.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("items").alias("items"), F.sum("images").alias("images"), pages.alias("page_list"))
    rows = rows.join(own, "doc_id", "left")
    issues = F.array_compact(F.array(F.when(F.col("items") == 0, "no text"), F.when(F.size("fonts") > 2, "many fonts")))
    return rows.select(
        "doc_id", F.to_json(F.struct("pages", "items", "images", (F.col("items") > 0).alias("has_text"), (F.col("images") > 0).alias("has_images"), "fonts", issues.alias("issues"), F.col("page_list").alias("page_list"))).alias("report")
    )


def list_items(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, indent, kind, text, plain) -> items: a marker starts one, lines indented by six or more go on, other lines start their own; lines before the first marker drop out."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("base", F.min("indent").over(Window.partitionBy("doc_id"))).withColumn("seen", F.count("kind").over(w)).where("seen > 0")
    rows = rows.withColumn("item", F.sum(F.when(F.col("kind").isNotNull() | (F.col("indent") - F.col("base") < 6.0), 1).otherwise(0)).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    out = rows.groupBy("doc_id", "item").agg(F.max("kind").alias("kind"), F.count("*").alias("n_lines"), F.count_if("plain").alias("n_plain"), F.md5(F.trim(text)).alias("text_md5"))
    return out.withColumn("item_no", F.col("item") - F.min("item").over(Window.partitionBy("doc_id"))).drop("item")


#: Least ratios of a font size to the page's for heading levels, by mean size and by median size.
LEVELS_BY_MEAN = ((2.0, "h1"), (1.75, "h2"), (1.5, "h3"), (1.25, "h4"), (1.1, "h5"), (1.05, "h6"))
LEVELS_BY_MEDIAN = ((2.0, 1), (1.8, 2), (1.5, 3), (1.3, 4), (1.2, 5))


def level(ratio: Column, table: tuple, otherwise: Column) -> Column:
    out = otherwise
    for least, name in reversed(table):
        out = F.when(ratio >= least, name).otherwise(out)
    return out


def semantic_tag(items: DataFrame) -> DataFrame:
    """Adds ``tag``: a heading by size against the page's mean, else em for slanted, strong for heavy text, else span."""
    ratio = F.col("font_size") / F.avg("font_size").over(Window.partitionBy(*PAGE))
    plain = F.when(F.col("font_style").isin("italic", "oblique"), "em").when(F.col("font_weight") >= 600, "strong").otherwise("span")
    return items.withColumn("tag", level(ratio, LEVELS_BY_MEAN, plain))


def heading_lines(lines: DataFrame, most: int = 100, least: float = 1.2) -> DataFrame:
    """Adds ``heading``: the level of lines that are short, large against the page's median size, and heavy or in capitals; else null."""
    sizes = lines.groupBy(*PAGE).agg(F.percentile("font_size", 0.5).alias("median_size"))
    rows = lines.join(sizes, PAGE)
    ratio, text = F.col("font_size") / F.col("median_size"), F.trim("text")
    caps = (text == F.upper(text)) & text.rlike("[A-Z]")
    is_heading = (text != "") & (F.length(text) <= most) & (ratio >= least) & ((F.col("font_weight") > 450) | caps)
    return rows.withColumn("heading", F.when(is_heading, level(ratio, LEVELS_BY_MEDIAN, F.lit(6)))).drop("median_size")


def content_style(items: DataFrame) -> DataFrame:
    """Weight and style that the text itself suggests: titles at least 700, short words of letters at least 600 and italic."""
    text = F.trim("text")
    emphasis = text.rlike("^[A-Za-z]{2,20}$")
    title = is_title_case_or_caps(F.col("text"))
    weight = F.when(title, F.greatest("font_weight", F.lit(700))).when(emphasis, F.greatest("font_weight", F.lit(600))).otherwise(F.col("font_weight"))
    return items.withColumn("styled_weight", weight).withColumn("styled_style", F.when(~title & emphasis, "italic").otherwise(F.col("font_style")))


def decoration(explicit: Column, name: Column) -> Column:
    """The item's own decoration, else what its font's name says."""
    lower = F.lower(name)
    named = F.when(lower.contains("underline"), "underline").when(lower.contains("strike"), "line-through").when(lower.contains("overline"), "overline").otherwise("none")
    return F.when(explicit.isNotNull() & (explicit != "none"), explicit).otherwise(named)
