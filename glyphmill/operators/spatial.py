"""Joins of what lies on a page: obstacles, rules under text, overlaps, style transfer.

All are equi-joins on (doc_id, page_no) with a condition on the boxes, so pairs never cross a page.  Where one side is
text and the other any number of graphics, both sides are also cut into bands of y, so that only neighbours meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, box_distance, centre_distance, intersection_area, overlap_ratio
from .layout import PAGE, covered_length

BAND, CELL = 48.0, 96.0


def in_bands(rows: DataFrame, top: Column, bottom: Column, height: float = BAND) -> DataFrame:
    """A row for each band of the page that it touches."""
    return rows.withColumn("band", F.explode(F.sequence(F.floor(top / height), F.floor(F.greatest(top, bottom) / height))))


def obstacles(images: DataFrame, graphics: DataFrame, annotations: DataFrame, forms: DataFrame, page_height: float) -> DataFrame:
    """(doc_id, page_no, kind, box): images, annotations and forms are hard and soft, graphics with both sides above 1.25 soft only."""
    placed = lambda df: df.select(*PAGE, box(F.col("x"), page_height - (F.col("y") + F.col("height")), F.col("width"), F.col("height")).alias("box"))
    solid = placed(images).unionByName(placed(annotations)).unionByName(placed(forms))
    loose = placed(graphics.where("least(abs(width), abs(height)) > 1.25"))
    return solid.withColumn("kind", F.explode(F.array(F.lit("hard"), F.lit("soft")))).unionByName(loose.withColumn("kind", F.lit("soft")))


def region_obstacles(regions: DataFrame, found: DataFrame) -> DataFrame:
    """Regions with hard and soft overlap areas, the verdict and the distance to the nearest soft obstacle (infinite without one)."""
    r = regions.withColumn("rbox", box(F.col("min_x"), F.col("top"), F.col("max_x") - F.col("min_x"), F.col("bottom") - F.col("top")))
    met = r.join(found, PAGE, "left")
    area = F.when(F.col("box").isNotNull(), intersection_area(F.col("rbox"), F.col("box"))).otherwise(0.0)
    out = met.groupBy(*PAGE, "region_no", "median_height").agg(
        F.max(F.when(F.col("kind") == "hard", area).otherwise(0.0)).alias("hard_area"),
        F.sum(F.when(F.col("kind") == "soft", area).otherwise(0.0)).alias("soft_area"),
        F.coalesce(F.min(F.when(F.col("kind") == "soft", box_distance(F.col("rbox"), F.col("box")))), F.lit(float("inf"))).alias("nearest"),
    )
    return out.withColumn("overlaps", (F.col("hard_area") > 0) | (F.col("soft_area") > F.greatest(F.lit(2.0), F.col("median_height") * F.col("median_height") * 0.2)))


def border_counts(regions: DataFrame, graphics: DataFrame) -> DataFrame:
    """How many thin graphics (a side of two or less, the other of ten or more) touch each region."""
    thin = graphics.where("least(width, height) <= 2 and greatest(width, height) >= 10")
    g = thin.select(*PAGE, box(F.col("x"), F.col("y"), F.col("width"), F.col("height")).alias("gbox"))
    r = regions.withColumn("rbox", box(F.col("min_x"), F.col("top"), F.col("max_x") - F.col("min_x"), F.col("bottom") - F.col("top")))
    touch = (F.col("gbox.left") <= F.col("max_x")) & (F.col("gbox.left") + F.col("gbox.width") >= F.col("min_x")) & (F.col("gbox.top") <= F.col("bottom")) & (F.col("gbox.top") + F.col("gbox.height") >= F.col("top"))
    met = r.join(g, PAGE, "left").withColumn("touch", F.coalesce(touch, F.lit(False)))
    return met.groupBy(*PAGE, "region_no").agg(F.count_if("touch").alias("borders"))


def underlines(words: DataFrame, rules: DataFrame, page_width: float, page_height: float) -> tuple[DataFrame, DataFrame]:
    """(rules that underline text, word keys that are underlined).

    ``rules`` (doc_id, page_no, seq, x, y, width, height, stroke_width) are in page space.  A rule is thin and long for its
    height; it matches the words just above it that it overlaps by a fifth; rules to be filled in and long separators are
    left alone, by how much of the rule the union of its words covers.
    """
    stroke = F.coalesce(F.abs("stroke_width"), F.lit(1.0))
    r = rules.withColumn("thick", F.greatest("height", stroke)).where((F.col("width") >= max(2.0, page_width * 0.003)) & (F.col("thick") <= F.greatest(F.lit(6.5), stroke * 4)) & (F.col("width") / F.greatest(F.lit(0.35), F.col("thick")) >= 8))
    r = r.select(*PAGE, "seq", F.col("x").alias("r0"), (F.col("x") + F.col("width")).alias("r1"), (F.col("y") + F.col("height") / 2).alias("ry"), F.col("width").alias("rw"))
    t = words.select(*PAGE, "line_no", "word_no", F.col("x").alias("t0"), (F.col("x") + F.col("width")).alias("t1"), (page_height - F.col("y")).alias("bottom"), F.greatest(F.lit(1.0), "height").alias("h"))
    t = in_bands(t, F.col("bottom") - F.greatest(F.lit(0.8), F.col("h") * 0.12), F.col("bottom") + F.greatest(F.lit(1.5), F.col("h") * 0.65))
    r = r.withColumn("band", F.floor(F.col("ry") / BAND))  # a rule has one height, so a pair meets in one band
    met = t.join(r, [*PAGE, "band"]).where("r0 < t1 and t0 < r1")
    dy = F.col("ry") - F.col("bottom")
    met = met.withColumn("s0", F.greatest("r0", "t0")).withColumn("s1", F.least("r1", "t1"))
    met = met.where(((F.col("s1") - F.col("s0")) / F.greatest(F.lit(1.0), F.least(F.col("rw"), F.greatest(F.lit(1.0), F.col("t1") - F.col("t0")))) >= 0.2) & (dy >= -F.greatest(F.lit(0.8), F.col("h") * 0.12)) & (dy <= F.greatest(F.lit(1.5), F.col("h") * 0.65)))
    union = covered_length(met.select(*PAGE, "seq", F.col("s0").alias("start"), F.col("s1").alias("end")), [*PAGE, "seq"])
    spans = met.groupBy(*PAGE, "seq", "rw").agg(F.greatest(F.lit(1.0), F.max("t1") - F.min("t0")).alias("span"), F.count("*").alias("n_words")).join(union, [*PAGE, "seq"])
    fill = (F.col("rw") >= page_width * 0.25) & (F.col("rw") / F.col("span") >= 1.8)
    separator = (F.col("rw") >= page_width * 0.45) & (F.col("covered") / F.greatest(F.lit(1.0), F.col("rw")) < 0.5) & (F.col("covered") / F.col("span") < 0.65)
    used = spans.where(~fill & ~separator).select(*PAGE, "seq", "n_words", "covered")
    marked = met.join(used.select(*PAGE, "seq"), [*PAGE, "seq"], "left_semi").select(*PAGE, "line_no", "word_no").distinct()
    return used, marked


def with_underlines(words: DataFrame, rules: DataFrame, page_width: float, page_height: float) -> tuple[DataFrame, DataFrame]:
    """Words with text_decoration, and the rules that are left."""
    used, marked = underlines(words, rules, page_width, page_height)
    key = [*PAGE, "line_no", "word_no"]
    flagged = words.join(marked.withColumn("underlined_", F.lit(True)), key, "left")
    out = flagged.withColumn("text_decoration", F.when(F.col("underlined_"), "underline").otherwise("none")).drop("underlined_")
    return out, rules.join(used.select(*PAGE, "seq"), [*PAGE, "seq"], "left_anti")


def overlaps(items: DataFrame, least: float = 0.1) -> DataFrame:
    """Pairs of items of a page (by item_no) whose boxes share at least ``least`` of the smaller one."""
    boxed = items.select(*PAGE, "item_no", box(F.col("x"), F.col("y"), F.col("width"), F.col("height")).alias("box"))
    cut = in_bands(boxed, F.col("box.top"), F.col("box.top") + F.col("box.height"))
    across = lambda x: F.floor(x / CELL)
    cut = cut.withColumn("cell", F.explode(F.sequence(across(F.col("box.left")), across(F.col("box.left") + F.col("box.width")))))
    met = cut.alias("a").join(cut.alias("b"), [*PAGE, "band", "cell"]).where("a.item_no < b.item_no")
    # a pair that meets in several bands or cells counts in the first
    met = met.where(F.col("band") == F.greatest(F.floor(F.col("a.box.top") / BAND), F.floor(F.col("b.box.top") / BAND)))
    met = met.where(F.col("cell") == F.greatest(across(F.col("a.box.left")), across(F.col("b.box.left"))))
    ratio = overlap_ratio(F.col("a.box"), F.col("b.box"))
    return met.select(*PAGE, F.col("a.item_no").alias("first"), F.col("b.item_no").alias("second"), ratio.alias("ratio")).where(F.col("ratio") >= least)


def pushed_apart(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Items of overlapping pairs, the second moved below the first by the shared height (by each item's largest share)."""
    a = items.select(*PAGE, F.col("item_no").alias("first"), (F.col("y") + F.col("height")).alias("bottom"))
    moved = pairs.join(a, [*PAGE, "first"]).groupBy(*PAGE, F.col("second").alias("item_no")).agg(F.max("bottom").alias("below"))
    out = items.join(moved, [*PAGE, "item_no"], "left")
    return out.withColumn("y", F.when(F.col("below") > F.col("y"), F.col("below")).otherwise(F.col("y"))).drop("below")


def style_matches(items: DataFrame, samples: DataFrame, reach: float = 50.0) -> DataFrame:
    """For each item the styled sample of its page that suits it best: four fifths nearness, one fifth like length; above a half."""
    # a score above a half needs centres within 0.625 of ``reach``, so samples stand in the cells around theirs
    cell = lambda c, side: F.floor((c["left" if side == "width" else "top"] + c[side] / 2) / reach)
    i = items.select(*PAGE, "item_no", box(F.col("x"), F.col("y"), F.col("width"), F.col("height")).alias("ibox"), F.length("text").alias("ilen"))
    i = i.withColumn("cx", cell(F.col("ibox"), "width")).withColumn("cy", cell(F.col("ibox"), "height"))
    s = samples.select(*PAGE, "sample_no", "style", box(F.col("x"), F.col("y"), F.col("width"), F.col("height")).alias("sbox"), F.length("text").alias("slen"))
    around = lambda c: F.explode(F.sequence(c - 1, c + 1))
    s = s.withColumn("cx", around(cell(F.col("sbox"), "width"))).withColumn("cy", around(cell(F.col("sbox"), "height")))
    near = F.greatest(F.lit(0.0), 1 - centre_distance(F.col("ibox"), F.col("sbox")) / reach)
    alike = F.least("ilen", "slen") / F.greatest("ilen", "slen", F.lit(1))
    scored = i.join(s, [*PAGE, "cx", "cy"]).withColumn("score", near * 0.8 + alike * 0.2).where("score > 0.5")
    return scored.groupBy(*PAGE, "item_no").agg(F.min_by(F.struct("sample_no", "style", "score"), F.struct(-F.col("score"), F.col("sample_no"))).alias("m")).select(*PAGE, "item_no", "m.*")


def alone_on_line(items: DataFrame) -> DataFrame:
    """Items of a page with no other item within half their height of their y."""
    mine = items.select(*PAGE, "item_no", "y", "height")
    ys = items.groupBy(*PAGE, "y").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*PAGE).orderBy("y")
    # on sorted different heights only the neighbours above and below can be near
    ys = ys.withColumn("below", F.lag("y").over(w)).withColumn("above", F.lead("y").over(w))
    half = F.col("height") * 0.5
    near = (F.col("n") > 1) | F.coalesce(F.col("y") - F.col("below") < half, F.lit(False)) | F.coalesce(F.col("above") - F.col("y") < half, F.lit(False))
    return mine.join(ys, [*PAGE, "y"]).where(~near).select(*PAGE, "item_no")


def structured_lines(words: DataFrame, region_width: DataFrame) -> DataFrame:
    """Lines with a gap that looks like a table: 22, 2.6 font sizes and 8 percent of the region's width at least."""
    w = Window.partitionBy(*PAGE, "line_no").orderBy("x", "word_no")
    gap = F.lead("x").over(w) - (F.col("x") + F.col("width"))
    rows = words.withColumn("gap", gap).join(region_width, PAGE)
    least = F.greatest(F.lit(22.0), F.col("font_size") * 2.6, F.col("region_width") * 0.08)
    return rows.groupBy(*PAGE, "line_no").agg(F.coalesce(F.bool_or(F.col("gap") >= least), F.lit(False)).alias("structured"))


def layout_decision(regions: DataFrame) -> DataFrame:
    """A region flows unless it overlaps an obstacle, has two borders or more, or a structured line."""
    return regions.withColumn("absolute", F.col("overlaps") | (F.col("borders") >= 2) | F.col("structured"))
