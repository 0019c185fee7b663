"""Single items and their neighbours on a line: items of a reader, repaired sizes, padding, budgets, glue, lexical checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fonts as N
from ..functions.geometry import estimated_width, round_half_up, snapped_rotation
from ..functions.words import word_likelihood

PAGE = ["doc_id", "page_no"]
LINE = [*PAGE, "line_no"]


def reader_item(text: Column, matrix: Column, font_name: Column, style_size: Column, width: Column, height: Column) -> Column:
    """A text item of a reader's output: place and rotation from its matrix, a repaired size, given or estimated box (sides change places at a quarter turn)."""
    g = lambda i: F.get(matrix, F.lit(i))
    turn = F.degrees(F.atan2(g(1), g(0)))
    raw = F.coalesce(F.nullif(style_size, F.lit(0.0)), F.lit(12.0))
    size = F.when((raw <= 2) & (F.coalesce(height, F.lit(0.0)) >= 4), height).otherwise(raw)
    one = lambda v: F.when(v == 0, 1.0).otherwise(v)
    w = F.coalesce(width, F.length(text) * size * 0.6 * one(F.hypot(g(0), g(1))))
    h = F.coalesce(height, size * one(F.hypot(g(2), g(3))))
    quarter = F.abs(turn % 180) == 90
    return F.struct(
        g(4).alias("x"), g(5).alias("y"), F.when(quarter, h).otherwise(w).alias("width"), F.when(quarter, w).otherwise(h).alias("height"), size.alias("font_size"), turn.alias("rotation"), N.weight_of(font_name).cast("int").alias("font_weight"), N.style_of(font_name).alias("font_style"),
    )


def estimated_font_info(name: Column, size: Column) -> Column:
    """What a font's metrics should be when only its size is known."""
    shares = {"ascent": 0.8, "descent": 0.2, "cap_height": 0.7, "x_height": 0.5, "average_width": 0.6, "max_width": 1.2}
    metrics = F.struct(*[(size * v).alias(k) for k, v in shares.items()], F.lit(1000.0).alias("units_per_em"))
    return F.struct(name.alias("name"), F.lit(False).alias("embedded"), name.contains("+").alias("subset"), F.lit("WinAnsi").alias("encoding"), metrics.alias("metrics"))


def repaired_size(size: Column, box_height: Column, box_width: Column, scale: Column) -> Column:
    """A size of two or less becomes the box's height (from 4), 1.8 widths (from 3) or 10; times the font's scale, one at least."""
    raw = F.when(size > 2, size).when(box_height >= 4, box_height).when(box_width >= 3, box_width * 1.8).otherwise(10.0)
    return F.greatest(F.lit(1.0), round_half_up(F.greatest(F.lit(1.0), raw) * scale, 3))


def is_junk(text: Column, size: Column, height: Column, family: Column) -> Column:
    return (F.trim(F.coalesce(text, F.lit(""))) == "") | ((size <= 1.25) & (height <= 1.25)) | ((family == "Unknown") & (size <= 2))


def font_scales(glyphs: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, page_no, glyph_no, ch, height, font_size, font_name) with cap_height of each font's record -> scale of each font of a page.

    The median over the first 256 glyphs of height / (size * cap ratio), at most 1; at least 0.75, or 0.6 where thirty
    samples or more say so.
    """
    ratio = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("height") / F.greatest(F.lit(1.0), F.col("font_size") * F.greatest(F.lit(0.1), F.col("cap_height") / 1000))))
    rows = glyphs.join(records, "font_name").where((F.trim("ch") != "") & (F.col("height") > 0.5) & (F.col("font_size") >= 6) & (F.col("font_size") <= 72))
    nth = F.row_number().over(Window.partitionBy(*PAGE, "font_name").orderBy("glyph_no"))
    rows = rows.withColumn("ratio", ratio).withColumn("nth", nth).where("nth <= 256")
    out = rows.groupBy(*PAGE, "font_name").agg(F.percentile("ratio", 0.5).alias("median"), F.count("*").alias("n"))
    least = F.when((F.col("n") >= 30) & (F.col("median") < 0.75), 0.6).otherwise(0.75)
    return out.select(*PAGE, "font_name", "n", F.greatest(least, F.least(F.lit(1.0), F.col("median"))).alias("scale"))


_OPEN, _CLOSE, _TIGHT = "[(\\[{\"'‘“]", "[)\\]}\"'’”]", "[,.;:!?]"
_WORDY = "[\\p{L}\\p{N}]"


def _sticks(left: Column, right: Column) -> Column:
    """Punctuation that belongs to its neighbour: no padding between."""
    opens, closes = left.rlike(f"{_OPEN}$"), right.rlike(f"^{_CLOSE}") | right.rlike(f"^{_TIGHT}")
    return (opens & right.rlike(f"^{_WORDY}")) | (left.rlike("-$") & right.rlike(f"^{_WORDY}")) | (left.rlike(f"{_WORDY}$") & closes) | (opens & closes)


def _padding(gap: Column, size: Column, left: Column, right: Column, breaks: Column) -> Column:
    """A share of a small gap; nothing for word breaks and sticking punctuation."""
    ratio = gap / F.greatest(F.lit(0.01), size * 0.55)
    share = (
        F.when(gap < size * 0.25, F.least(gap * 0.6, size * 0.12))
        .when((gap < size * 0.5) & (ratio < 0.5), F.least(gap * 0.4, size * 0.08))
        .when((gap < size * 0.7) & (ratio < 0.7) & ~(left.rlike("[A-Za-z]$") & right.rlike("^[A-Z]")) & ~breaks, F.least(gap * 0.2, size * 0.05))
        .otherwise(0.0)
    )
    return F.when((gap > 0) & ~_sticks(left, right), round_half_up(share, 3)).otherwise(0.0)


def with_padding(runs: DataFrame, order: str = "word_no") -> DataFrame:
    """Runs of lines with padding_left, padding_right and width_adjustment from their neighbours."""
    w = Window.partitionBy(*LINE).orderBy("x", order)
    at = lambda f, c: f(c).over(w)
    rows = runs.withColumn("t_", F.trim("text"))
    for name, f in (("p", F.lag), ("n", F.lead)):
        rows = rows.withColumn(f"{name}_", F.struct(at(f, "x").alias("x"), at(f, "width").alias("w"), at(f, "font_size").alias("s"), at(f, "t_").alias("t")))
    left = _padding(F.col("x") - (F.col("p_.x") + F.col("p_.w")), F.greatest(F.lit(1.0), (F.col("p_.s") + F.col("font_size")) / 2), F.col("p_.t"), F.col("t_"), F.lit(False))
    right = _padding(F.col("n_.x") - (F.col("x") + F.col("width")), F.greatest(F.lit(1.0), (F.col("n_.s") + F.col("font_size")) / 2), F.col("t_"), F.col("n_.t"), F.col("n_.t").rlike("^[,.;:!?)]"))
    least = F.length("t_") * F.col("font_size") * 0.45
    narrow = F.when(F.col("width") <= 0, F.least(F.col("font_size") * 0.08, F.lit(2.0))).when(F.col("width") < least * 0.9, F.least((least - F.col("width")) * 0.3, F.col("font_size") * 0.15)).otherwise(0.0)
    rows = rows.withColumn("padding_left", F.coalesce(left, F.lit(0.0))).withColumn("padding_right", F.coalesce(right, F.lit(0.0)))
    return rows.withColumn("width_adjustment", F.when(F.length("t_") > 0, round_half_up(narrow, 3)).otherwise(0.0)).drop("t_", "p_", "n_")


def with_budget(runs: DataFrame, region_left: float, region_width: float, least_gap: float = 1.0, order: str = "word_no") -> DataFrame:
    """Adds ``final_width``: the run's width (half an em a character where it is missing or absurd), within what is left up to the next run or the region's edge."""
    w = Window.partitionBy(*LINE).orderBy("x", order)
    x = F.col("x") - region_left
    paddings = F.col("padding_left") + F.col("padding_right")
    budget = F.greatest(F.lit(0.0), round_half_up(F.coalesce(F.lead("x").over(w) - region_left - x - paddings - least_gap, region_width - x - paddings), 3))
    own = F.greatest(F.lit(0.0), round_half_up(F.when(F.col("width") > 0, F.col("width")).otherwise(estimated_width(F.col("text"), F.col("font_size"))) + F.col("width_adjustment"), 3))
    least = F.when(F.length("text") > 1, F.col("font_size") * 0.1 * F.length("text")).otherwise(F.col("font_size") * 0.05)
    wanted = F.when((own > 0) & (own >= least), own).otherwise(round_half_up(F.length("text") * F.col("font_size") * 0.5, 3))
    return runs.withColumn("final_width", F.when(budget > 0, F.least(wanted, budget)).otherwise(wanted))


def glue(left: Column, right: Column, gap: Column, size: Column) -> Column:
    """What stands between two runs of a paragraph: nothing or a space."""
    a, b = F.rtrim(left), F.ltrim(right)
    spaced = left.rlike(r"\s$") | right.rlike(r"^\s")
    none = (a == "") | (b == "") | a.rlike("-$") | a.rlike(f"{_OPEN}$") | b.rlike(f"^(?:{_CLOSE}|{_TIGHT})") | (gap <= size * 0.12)
    return F.when(none, "").when(spaced | (gap >= F.greatest(F.lit(0.6), size * 0.28)) | (a.rlike(f"{_WORDY}$") & b.rlike(f"^{_WORDY}")), " ").otherwise("")


def merged_paragraph(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Runs (text, x, width, font_size) to one text per key: glue between neighbours, hyphens at joins dropped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    gap = F.col("x") - (before("x") + before("width"))
    between = F.when(before("text").isNull(), "").otherwise(glue(before("text"), F.col("text"), gap, (F.col("font_size") + before("font_size")) / 2))
    cut = F.when(F.lead("text").over(w).isNotNull(), F.regexp_replace(F.trim("text"), "-$", "")).otherwise(F.trim("text"))
    rows = runs.select(*keys, *order, F.concat(between, cut).alias("piece"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "piece"))), lambda r: r["piece"]), "").alias("text"))


def lexical_lines(lines: DataFrame, dictionary: DataFrame, share: float = 0.45) -> DataFrame:
    """Lines (doc_id, page_no, line_no, text) with ``lexical``: three words or more of 3 to 24 letters, enough of which are words or begin one.

    Words meet the dictionary's beginnings in a join, not in a set on the driver.
    """
    starts = dictionary.select(F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("word"))), lambda i: F.substr("word", F.lit(1), i))).alias("start")).distinct()
    tokens = lines.select(*LINE, F.explode_outer(F.filter(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z]+", " ")), " "), lambda t: (F.length(t) >= 3) & (F.length(t) <= 24))).alias("token"))
    met = tokens.join(starts, tokens["token"] == starts["start"], "left")
    out = met.groupBy(*LINE).agg(F.count("token").alias("n"), F.count("start").alias("good"))
    return out.withColumn("lexical", (F.col("n") >= 3) & (F.col("good") >= F.col("n") * share))


def lexical_split(runs: DataFrame, dictionary: frozenset[str], text: str = "text") -> DataFrame:
    """Runs with long alphabetic text cut where a dictionary and the letter pairs agree; the word's letters stay."""
    from .folds import suggested_cuts

    @F.pandas_udf("array<string>")
    def parts(texts):
        import pandas as pd

        out = []
        for t in texts:
            cuts = [c for c, _ in suggested_cuts(t or "", dictionary) if 1 < c < len(t) - 1]
            edges = [0, *cuts, len(t or "")]
            out.append([t[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)] if cuts else [t or ""])
        return pd.Series(out, dtype=object)

    raw = F.col(text)
    trimmed = F.trim(raw)
    compact = F.regexp_replace(trimmed, "[^A-Za-z]+", "")
    usable = (F.length(trimmed) >= 8) & (F.length(compact) >= 8) & (F.length(compact) / F.length(trimmed) >= 0.65) & (F.regexp_count(trimmed, F.lit(r"\s+")) < F.greatest(F.lit(1.0), F.length(trimmed) / 12))
    rows = runs.withColumn("parts_", F.when(usable, parts(compact)))
    mean = F.aggregate(F.transform("parts_", word_likelihood), F.lit(0.0), lambda a, x: a + x) / F.size("parts_")
    better = usable & (F.size("parts_") > 1) & (mean > word_likelihood(compact) + 0.02)
    return rows.withColumn("split_text", F.when(better, F.array_join("parts_", " ")).otherwise(raw)).drop("parts_")


def split_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of blocks (with line_no, heading, kind of list marker) with part: a first line that is a heading, or that stands before a list of two markers or more, becomes a block of its own."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    every = Window.partitionBy(*keys)
    rows = lines.withColumn("nth", F.row_number().over(w)).withColumn("n", F.count("*").over(every))
    headed = F.max(F.when((F.col("nth") == 1) & F.col("heading").isNotNull(), 1).otherwise(0)).over(every) == 1
    markers = F.count("kind").over(every)
    first_marker = F.min(F.when(F.col("kind").isNotNull(), F.col("nth"))).over(every)
    splits = (F.col("n") >= 2) & (headed | ((first_marker == 2) & (markers >= 2)))
    return rows.withColumn("splits", splits).withColumn("part", F.when(splits & (F.col("nth") > 1), 1).otherwise(0)).drop("nth", "n", "splits")


def structures(lines: DataFrame) -> DataFrame:
    """Lines of a page as header (with level, by size against the page's mean), list or paragraph."""
    from ..functions.text import is_list_item

    ratio = F.col("font_size") / F.avg("font_size").over(Window.partitionBy(*PAGE))
    kind = F.when(ratio >= 1.5, "header").when(is_list_item(F.col("text")), "list").otherwise("paragraph")
    level = F.when(ratio >= 2.0, 1).when(ratio >= 1.75, 2).when(ratio >= 1.5, 3)
    return lines.withColumn("structure", kind).withColumn("level", level)


def search_web_fonts(fonts: DataFrame, query: str) -> DataFrame:
    """Web fonts whose family or category holds the query."""
    q = F.lower(F.lit(query))
    return fonts.where(F.lower("family").contains(q) | F.lower("category").contains(q)).select("family", "category").distinct()


def rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    """``rgba()`` of four bytes, alpha with three decimals."""
    return F.concat(F.lit("rgba("), F.concat_ws(", ", r.cast("int").cast("string"), g.cast("int").cast("string"), b.cast("int").cast("string"), F.format_string("%.3f", a / 255.0)), F.lit(")"))


def glyph_rotation(radians: Column) -> Column:
    """The rotation of a glyph, snapped."""
    degrees = F.degrees(F.coalesce(radians, F.lit(0.0)))
    return snapped_rotation(degrees - 360 * F.floor((degrees + 180) / 360))


def with_overlays(html: Column, css: str) -> Column:
    """Debug styles before the end of the first head."""
    at = F.instr(html, "</head>")
    return F.when(at > 0, F.concat(F.substr(html, F.lit(1), at - 1), F.lit(f"<style>{css}</style>"), F.substr(html, at))).otherwise(html)
