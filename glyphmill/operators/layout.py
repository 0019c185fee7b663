"""Layout of a page: statistics, regions, paragraphs, clusters, columns, blocks, reading order.

Breaks depend on the row before, so each is a ``lag`` and a running sum over one page; everything is keyed by
(doc_id, page_no) and state never crosses a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import round_half_up
from ..functions.text import continues, hyphen_joins
from ..schema import PAGE_HEIGHT, PAGE_WIDTH

PAGE = ["doc_id", "page_no"]
LINE = [*PAGE, "line_no"]


def at_share(values: Column, share: float) -> Column:
    """The value at floor(n * share) of the sorted values."""
    return F.get(F.array_sort(values), F.floor(F.size(values) * share).cast("int"))


def or_default(value: Column, default: float) -> Column:
    """Missing and zero both give the default."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(default))


def word_gaps(words: DataFrame) -> DataFrame:
    """Gaps between neighbours of a line, as character gaps, word gaps or both by their size in font sizes."""
    w = Window.partitionBy(*LINE).orderBy("x", "word_no")
    gap = F.lead("x").over(w) - (F.col("x") + F.col("width"))
    size = (F.col("font_size") + F.lead("font_size").over(w)) / 2
    rows = words.select(*LINE, gap.alias("gap"), (gap / F.greatest(F.lit(1.0), size)).alias("norm")).where("gap >= 0")
    return rows.select(*LINE, "gap", (F.col("norm") < 0.8).alias("is_char"), (F.col("norm") > 0.25).alias("is_word"))


def line_gaps(lines: DataFrame) -> DataFrame:
    """Gaps between a line and the next below; a gap above one and a half heights parts paragraphs."""
    w = Window.partitionBy(*PAGE).orderBy("top", "line_no")
    gap = F.lead("top").over(w) - (F.col("top") + F.col("height"))
    return lines.select(*PAGE, gap.alias("gap"), (gap > F.col("height") * 1.5).alias("is_paragraph")).where("gap >= 0")


def gap_statistics(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Medians and quartiles of the gaps of each page, with defaults where there are none."""
    median = lambda c, on: F.percentile(F.when(on, c), 0.5)
    own = F.collect_list(F.when(F.col("is_word"), F.col("gap")))
    by_word = word_gaps(words).groupBy(*PAGE).agg(
        median(F.col("gap"), F.col("is_char")).alias("char_gap"), median(F.col("gap"), F.col("is_word")).alias("word_gap"), at_share(own, 0.25).alias("p25_word_gap"), at_share(own, 0.75).alias("p75_word_gap")
    )
    by_line = line_gaps(lines).groupBy(*PAGE).agg(F.percentile("gap", 0.5).alias("line_gap"), median(F.col("gap"), F.col("is_paragraph")).alias("paragraph_gap"))
    rows = lines.select(*PAGE).distinct().join(by_word, PAGE, "left").join(by_line, PAGE, "left")
    defaults = {"char_gap": 0.0, "word_gap": 3.0, "line_gap": 12.0, "paragraph_gap": 20.0, "p25_word_gap": 2.0, "p75_word_gap": 5.0}
    return rows.select(*PAGE, *[or_default(F.col(c), d).alias(c) for c, d in defaults.items()])


def page_sizes(words: DataFrame) -> DataFrame:
    """Median height and font size of the items of a page."""
    return words.groupBy(*PAGE).agg(F.percentile(F.greatest(F.lit(1.0), "height"), 0.5).alias("median_height"), F.percentile(F.greatest(F.lit(1.0), "font_size"), 0.5).alias("median_font_size"))


def dominant(words: DataFrame, column: Column, name: str, otherwise) -> DataFrame:
    """The most frequent value of a page; the first seen of equals."""
    counts = words.groupBy(*PAGE, column.alias("v")).agg(F.count("*").alias("n"), F.min(F.struct("line_no", "word_no")).alias("first"))
    return counts.groupBy(*PAGE).agg(F.coalesce(F.min_by("v", F.struct(-F.col("n"), F.col("first"))), F.lit(otherwise)).alias(name))


def page_statistics(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Gap, font and density figures of each page."""
    fonts = words.groupBy(*PAGE).agg(
        F.var_pop("font_size").alias("size_variance"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("n_words"), F.countDistinct("line_no").alias("n_lines")
    )
    rows = fonts.join(page_sizes(words), PAGE).join(gap_statistics(words, lines), PAGE)
    rows = rows.join(dominant(words, round_half_up(F.col("font_size"), 1), "dominant_size", 12.0), PAGE).join(dominant(words, F.col("font_family"), "dominant_family", "default"), PAGE)
    return rows.withColumn("text_density", F.col("chars") / (PAGE_WIDTH * PAGE_HEIGHT)).withColumn("words_per_line", F.col("n_words") / F.col("n_lines")).drop("chars")


def islands(rows: DataFrame, keys: list[str], order: list, starts: Column, name: str) -> DataFrame:
    """Numbers the groups that begin where ``starts`` holds (null holds)."""
    return rows.withColumn(name, F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def with_regions(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lines with region_no: a new region after a large gap, or after a jump of the left edge further down."""
    w = Window.partitionBy(*PAGE).orderBy("top", "min_x", "line_no")
    rows = lines.join(sizes, PAGE)
    before = lambda c: F.lag(c).over(w)
    gap = F.col("top") - (before("top") + before("height"))
    jump = (F.abs(F.col("min_x") - before("min_x")) > F.greatest(F.lit(8.0), F.col("median_font_size") * 2)) & (F.col("top") - before("top") > F.greatest(F.lit(2.0), F.col("median_height") * 0.6))
    rows = rows.withColumn("starts_", (gap > F.greatest(F.lit(6.0), F.col("median_height") * 1.8)) | jump)
    return islands(rows, PAGE, ["top", "min_x", "line_no"], F.col("starts_"), "region_no").drop("starts_")


def regions(lines: DataFrame) -> DataFrame:
    """Boxes of the regions of lines that have region_no."""
    return lines.groupBy(*PAGE, "region_no").agg(
        F.count("*").alias("n_lines"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("top").alias("top"), F.max(F.col("top") + F.col("height")).alias("bottom"),
        F.first("median_height").alias("median_height"), F.first("median_font_size").alias("median_font_size"), F.collect_list("height").alias("heights"), F.collect_list("min_x").alias("lefts"),
    )


def stable_flags(found: DataFrame) -> DataFrame:
    """Regions with stable line heights and stable left edges (middle four fifths)."""
    lefts = F.col("lefts")
    heights = F.array_max("heights") <= F.greatest(F.array_min("heights") + 4, F.col("median_height") * 1.4)
    spread = at_share(lefts, 0.9) - at_share(lefts, 0.1) <= F.greatest(F.lit(18.0), F.col("median_font_size") * 2.5)
    return found.withColumn("stable_height", (F.col("n_lines") <= 1) | heights).withColumn("stable_indent", (F.col("n_lines") <= 2) | spread)


def with_paragraphs(lines: DataFrame) -> DataFrame:
    """Lines of regions with paragraph_no and how they join the line before: hyphenation, continuation or not."""
    keys = [*PAGE, "region_no"]
    w = Window.partitionBy(*keys).orderBy("top", "min_x", "line_no")
    before = lambda c: F.lag(c).over(w)
    gap = F.col("top") - (before("top") + before("height"))
    by_gap = gap > F.greatest(F.lit(4.0), F.col("median_height") * 0.8)
    by_indent = (F.abs(F.col("min_x") - before("min_x")) > F.greatest(F.lit(10.0), F.col("median_height") * 1.2)) & (gap > F.greatest(F.lit(1.0), F.col("median_height") * 0.15))
    previous = F.rtrim(before("text"))
    rows = lines.withColumn("gap_", gap).withColumn("starts_", by_gap | by_indent).withColumn("join_", F.when(hyphen_joins(previous, F.ltrim("text")), "hyphenation").when(continues(previous, F.ltrim("text")), "continuation"))
    rows = islands(rows, keys, ["top", "min_x", "line_no"], F.col("starts_"), "paragraph_no")
    first = F.coalesce(F.col("starts_"), F.lit(True))
    return rows.withColumn("gap_before", F.when(first, F.greatest(F.lit(0.0), F.coalesce(F.col("gap_"), F.lit(0.0))))).withColumn("join_with", F.when(~first, F.col("join_"))).drop("starts_", "join_", "gap_")


def paragraphs(lines: DataFrame) -> DataFrame:
    """One row per paragraph: lines, top, gap before it, text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("top", "min_x", "line_no", "text"))), lambda x: x["text"])
    return lines.groupBy(*PAGE, "region_no", "paragraph_no").agg(
        F.count("*").alias("n_lines"), F.min("top").alias("top"), F.max("gap_before").alias("gap_before"), F.count("join_with").alias("n_joined"), F.array_join(ordered, " ").alias("text")
    )


def clusters(values: DataFrame, keys: list[str], value: str, tolerance: float, least: int = 2) -> DataFrame:
    """Means of the runs of values whose neighbours are at most ``tolerance`` apart; runs of fewer than ``least`` are left out."""
    w = Window.partitionBy(*keys).orderBy(value)
    rows = values.withColumn("starts_", F.col(value) - F.lag(value).over(w) > tolerance)
    rows = rows.withColumn("cluster_no", F.sum(F.when(F.col("starts_"), 1).otherwise(0)).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "cluster_no").agg(F.avg(value).alias("centre"), F.count("*").alias("n")).where(F.col("n") >= least)


def margins(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Left margin, indent levels beyond it and column positions of each page."""
    base = lines.groupBy(*PAGE).agg(F.percentile("min_x", 0.5).alias("left_margin"), F.percentile(PAGE_WIDTH - F.col("max_x"), 0.5).alias("right_margin"))
    indented = lines.join(base, PAGE).where("min_x > left_margin").select(*PAGE, "min_x")
    levels = lambda df, name: df.groupBy(*PAGE).agg(F.array_sort(F.collect_list(round_half_up(F.col("centre"), 3))).alias(name))
    found = clusters(words.select(*PAGE, round_half_up(F.col("x")).alias("v")), PAGE, "v", 5)
    none = F.array().cast("array<double>")
    rows = base.join(levels(clusters(indented, PAGE, "min_x", 3), "indents"), PAGE, "left").join(levels(found, "columns"), PAGE, "left")
    return rows.select(*PAGE, "left_margin", "right_margin", F.coalesce("indents", none).alias("indents"), F.coalesce("columns", none).alias("columns"))


def column_gaps(words: DataFrame, share: float = 0.1) -> DataFrame:
    """Columns of a page between gaps of rounded edges that are wider than a share of the text's width, with their items."""
    edges = words.select(*PAGE, F.explode(F.array(round_half_up(F.col("x")), round_half_up(F.col("x") + F.col("width")))).alias("edge")).distinct()
    width = words.groupBy(*PAGE).agg(F.max(F.col("x") + F.col("width")).alias("page_width"))
    gaps = edges.join(width, PAGE).withColumn("next_edge", F.lead("edge").over(Window.partitionBy(*PAGE).orderBy("edge")))
    starts = gaps.where(F.col("next_edge") - F.col("edge") > F.col("page_width") * share).select(*PAGE, F.col("next_edge").alias("start"))
    bounds = width.select(*PAGE, F.lit(0.0).alias("start")).unionByName(starts).join(width, PAGE)
    bounds = bounds.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy(*PAGE).orderBy("start")), F.col("page_width")))
    # few columns on a page: a join by page, then the interval
    held = words.select(*PAGE, "x", "width").alias("w").join(bounds.alias("b"), PAGE).where("w.x >= b.start and w.x < b.end")
    return held.groupBy(*PAGE, F.col("b.start").alias("start"), F.col("b.end").alias("end")).agg(F.count("*").alias("n_items"))


def nearest_columns(words: DataFrame, centres: DataFrame) -> DataFrame:
    """Items by their nearest column centre (the first of equals), for pages with two columns or more."""
    own = centres.groupBy(*PAGE).agg(F.array_sort(F.collect_set(round_half_up(F.col("centre")))).alias("centres")).where(F.size("centres") >= 2)
    rows = words.join(own, PAGE)
    nearest = F.array_min(F.transform("centres", lambda c: F.struct(F.abs(F.col("x") - c).alias("d"), c.alias("c"))))["c"]
    return rows.groupBy(*PAGE, nearest.alias("centre")).agg(F.count("*").alias("n_items"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"))


def blocks(words: DataFrame) -> DataFrame:
    """Blocks of a page read from the top: a new one where y moves by more than three quarters of the first height."""
    top = Window.partitionBy(*PAGE).orderBy(F.col("y").desc(), "x", "word_no")
    rows = words.withColumn("line_height", F.first("height").over(top.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * 1.5)
    rows = rows.withColumn("starts_", F.abs(F.col("y") - F.lag("y").over(top)) > F.col("line_height") / 2)
    rows = islands(rows, PAGE, [F.col("y").desc(), "x", "word_no"], F.col("starts_"), "block_no")
    size = F.avg("font_size")
    return rows.groupBy(*PAGE, "block_no").agg(
        F.count("*").alias("n_items"), F.min("x").alias("x"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), size.alias("font_size"), F.when(size > 14, "h3").otherwise("p").alias("tag")
    )


def cursor_gaps(words: DataFrame) -> DataFrame:
    """Gap of each item to the furthest end before it on its line; the start of the line for the first."""
    before = Window.partitionBy(*LINE).orderBy("x", "word_no").rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("cursor_gap", F.col("x") - F.coalesce(F.max(F.col("x") + F.col("width")).over(before), F.lit(0.0)))


def covered_length(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the union of the intervals (start, end) of each key."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("added", F.greatest(F.lit(0.0), F.col("end") - F.greatest(F.col("start"), F.coalesce(reach, F.col("start")))))
    return rows.groupBy(*keys).agg(F.sum("added").alias("covered"))


def reading_order(words: DataFrame) -> DataFrame:
    """Mean move along x within a line, mean step down between items, and the direction of each page."""
    w = Window.partitionBy(*PAGE).orderBy(F.col("y").desc(), "x", "word_no")
    dx, dy = F.col("x") - F.lag("x").over(w), F.lag("y").over(w) - F.col("y")
    rows = words.select(*PAGE, F.when(F.abs(dy) < 5, dx).alias("move"), F.when(dy > 0, dy).alias("step"), F.col("text").rlike("[\\u0590-\\u08FF\\uFB50-\\uFDFF\\uFE70-\\uFEFF]").alias("rtl"))
    out = rows.groupBy(*PAGE).agg(F.coalesce(F.avg("move"), F.lit(0.0)).alias("x_move"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("y_step"), F.bool_or("rtl").alias("rtl"))
    return out.withColumn("direction", F.when(F.col("rtl") | (F.col("x_move") < 0), "rtl").otherwise("ltr")).drop("rtl")


def table_rows(cells: DataFrame) -> DataFrame:
    """(page keys, row_no, x) -> the rows of the most common number of cells (two at least; the first seen of equals), if they align.

    Alignment is the mean over columns of 1 / (1 + variance of x); above a half with two rows or more there is a table.
    """
    w = Window.partitionBy(*PAGE, "row_no").orderBy("x", "cell_no")
    rows = cells.withColumn("col", F.row_number().over(w) - 1).withColumn("n_cells", F.count("*").over(Window.partitionBy(*PAGE, "row_no"))).where("n_cells >= 2")
    counts = rows.where("col = 0").groupBy(*PAGE, "n_cells").agg(F.count("*").alias("n_rows"), F.min("row_no").alias("first"))
    common = counts.groupBy(*PAGE).agg(F.min_by(F.struct("n_cells", "n_rows"), F.struct(-F.col("n_rows"), F.col("first"))).alias("m"))
    rows = rows.join(common.select(*PAGE, F.col("m.n_cells").alias("n_cells"), F.col("m.n_rows").alias("n_rows")), [*PAGE, "n_cells"]).where("n_rows >= 2")
    per_col = rows.groupBy(*PAGE, "n_cells", "n_rows", "col").agg((1 / (1 + F.var_pop("x"))).alias("score"))
    out = per_col.groupBy(*PAGE, "n_cells", "n_rows").agg(F.avg("score").alias("alignment"))
    return out.withColumn("is_table", F.col("alignment") > 0.5)
