"""Fonts: names, styles, metrics and the catalogue they are matched with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The metrics catalogue, in units of a thousandth of an em.
# id | family | category | ascent descent cap_height x_height average_width max_width space_width
_CATALOGUE = """
avenir | Avenir | sans-serif | 756 244 708 474 571 944 278
bodoni | Bodoni MT | serif | 917 278 655 384 576 969 245
book_antiqua | Book Antiqua | serif | 923 282 693 467 584 1000 250
bookman_old_style | Bookman Old Style | serif | 942 232 681 471 627 960 320
cantarell | Cantarell | sans-serif | 1094 322 694 482 612 1057 273
carlito | Carlito | sans-serif | 952 269 642 478 505 890 226
cascadia_code | Cascadia Code | monospace | 928 234 693 518 586 586 586
cascadia_mono | Cascadia Mono | monospace | 928 234 693 518 586 586 586
century_gothic | Century Gothic | sans-serif | 1122 307 718 531 586 960 277
century_schoolbook | Century Schoolbook | serif | 986 216 722 458 613 981 278
comic_sans_ms | Comic Sans MS | sans-serif | 1102 292 759 540 606 1040 299
consolas | Consolas | monospace | 743 257 638 490 550 550 550
constantia | Constantia | serif | 751 249 687 453 560 1020 251
courier | Courier | monospace | 627 373 572 434 600 600 600
droid_sans | Droid Sans | sans-serif | 931 240 714 536 552 896 260
fira_code | Fira Code | monospace | 990 322 689 527 600 600 600
fira_mono | Fira Mono | monospace | 935 265 689 527 600 600 600
garamond | Garamond | serif | 862 263 629 385 536 885 250
gill_sans | Gill Sans | sans-serif | 1046 331 684 442 534 1042 278
helvetica | Helvetica | sans-serif | 718 207 718 523 579 944 278
helvetica_neue | Helvetica Neue | sans-serif | 973 287 714 517 578 926 278
inconsolata | Inconsolata | monospace | 859 190 623 457 500 500 500
inter | Inter | sans-serif | 969 241 728 546 606 985 281
libre_baskerville | Libre Baskerville | serif | 970 270 770 530 676 1176 287
merriweather | Merriweather | serif | 984 273 743 556 617 997 237
noto_sans | Noto Sans | sans-serif | 1069 293 714 536 581 935 260
open_sans | Open Sans | sans-serif | 1069 293 714 535 575 926 260
palatino | Palatino | serif | 726 274 692 469 584 1000 250
palatino_linotype | Palatino Linotype | serif | 732 284 716 519 584 1000 250
playfair_display | Playfair Display | serif | 1082 251 708 514 560 905 249
proxima_nova | Proxima Nova | sans-serif | 920 298 667 483 561 883 258
pt_serif | PT Serif | serif | 1039 286 700 500 567 934 243
roboto | Roboto | sans-serif | 928 244 711 528 566 887 248
source_code_pro | Source Code Pro | monospace | 984 273 660 486 600 600 600
source_serif_4 | Source Serif 4 | serif | 1036 335 670 475 602 1005 237
ubuntu_mono | Ubuntu Mono | monospace | 830 170 693 520 500 500 500
arial | Arial | sans-serif | 905 212 716 523 515 1015 278
times_new_roman | Times New Roman | serif | 891 216 662 450 500 1000 250
courier_new | Courier New | monospace | 832 300 660 450 600 600 600
calibri | Calibri | sans-serif | 900 220 710 520 520 1050 270
cambria | Cambria | serif | 895 215 680 465 505 1020 250
symbol | Symbol | symbol | 820 210 700 500 600 1000 250
default_sans | sans-serif | sans-serif | 900 220 710 520 520 1050 270
default_serif | serif | serif | 890 220 670 460 500 1000 250
default_mono | monospace | monospace | 830 300 660 450 600 600 600
"""
#: Other names of a family; more can be given to ``aliases``.
_ALIASES = {
    "arial": "arial unicode ms, system, liberation sans, dejavu sans, nimbus sans, segoe ui, tahoma, verdana, geneva",
    "times_new_roman": "times, times roman, liberation serif, dejavu serif, nimbus roman, georgia",
    "courier_new": "couriernew, liberation mono, dejavu sans mono, nimbus mono, menlo, monaco",
    "helvetica": "helvetica lt",
    "symbol": "wingdings, zapfdingbats, webdings",
}
# Web fonts with their weights.
_WEB_FONTS = """
Roboto | sans-serif | 100 300 400 500 700 900
Open Sans | sans-serif | 300 400 600 700 800
Lato | sans-serif | 100 300 400 700 900
Montserrat | sans-serif | 100 200 300 400 500 600 700 800 900
Source Sans Pro | sans-serif | 200 300 400 600 700 900
Merriweather | serif | 300 400 700 900
Lora | serif | 400 500 600 700
Roboto Mono | monospace | 100 200 300 400 500 600 700
"""
METRICS = ("ascent", "descent", "cap_height", "x_height", "average_width", "max_width")


def catalogue_rows() -> list[tuple]:
    """(position, id, family, category, six metrics, space_width)."""
    out = []
    for i, line in enumerate(_CATALOGUE.strip().splitlines()):
        ident, family, category, numbers = (p.strip() for p in line.split("|"))
        out.append((i, ident, family, category, *(float(n) for n in numbers.split())))
    return out


def web_font_rows() -> list[tuple]:
    """(position, family, category, place of the weight, weight)."""
    out = []
    for i, line in enumerate(_WEB_FONTS.strip().splitlines()):
        family, category, weights = (p.strip() for p in line.split("|"))
        out += [(i, family, category, j, int(w)) for j, w in enumerate(weights.split())]
    return out


def catalogue(spark: SparkSession) -> DataFrame:
    names = ", ".join(f"{m} double" for m in METRICS)
    return spark.createDataFrame(catalogue_rows(), f"pos int, id string, family string, category string, {names}, space_width double")


def web_fonts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(web_font_rows(), "pos int, family string, category string, weight_pos int, weight int")


def alias_rows(more: dict[str, str] | None = None) -> list[tuple[int, str, str]]:
    """(pos, id, name) of every name of each record."""
    return [(pos, ident, n) for pos, ident, family, *_ in catalogue_rows() for n in [*((more or {}) | {}).get(ident, _ALIASES.get(ident, "")).split(","), family, ident.replace("_", " ")]]


def aliases(spark: SparkSession, more: dict[str, str] | None = None) -> DataFrame:
    """(alias, id): normalised names of each record, the first record of a name."""
    rows = spark.createDataFrame(alias_rows(more), "pos int, id string, name string").select("pos", "id", normalized_family(F.trim("name")).alias("alias"))
    return rows.where("alias <> ''").groupBy("alias").agg(F.min_by("id", "pos").alias("id"))


def without_subset(name: Column) -> Column:
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


_WEIGHT_WORDS = "bold|black|heavy|semibold|demibold|medium|light|thin|italic|oblique|regular|reg|regu|bd|it|bi"


def normalized_family(name: Column) -> Column:
    """Lower-case family without subset prefix, foundry marks, weights, styles and widths; words apart."""
    steps = (
        (r"([a-z])([A-Z])", "$1 $2"),
        (r"([A-Za-z])([0-9])", "$1 $2"),
        (r"([0-9])([A-Za-z])", "$1 $2"),
        (r"(?i)([A-Za-z])(PSMT|MT|PS)\b", "$1 $2"),
        (r"[_/]", " "),
        (r"-+", " "),
        (r"\s*,\s*", " "),
        (r"\b(psmt|ps|mt|std|otf|ttf)\b", ""),
    )
    c = _squeezed(without_subset(name))
    c = F.lower(_squeezed(reduce(lambda a, s: F.regexp_replace(a, *s), steps, c)))
    return _squeezed(F.regexp_replace(F.regexp_replace(c, rf"\b({_WEIGHT_WORDS})\b", ""), r"\b(condensed|narrow|expanded)\b", ""))


#: Words for weights in the order in which they are tried (whole words, then parts of words).
WEIGHT_HINTS = ((r"\bthin\b|\b100\b", 100), (r"\bextralight\b|\bultralight\b|\b200\b", 200), (r"\blight\b|\b300\b", 300), (r"\bregular\b|\bnormal\b|\b400\b", 400), (r"\bmedium\b|\b500\b", 500), (r"\bsemibold\b|\bdemibold\b|\b600\b", 600), (r"\bbold\b|\b700\b", 700), (r"\bextrabold\b|\bultrabold\b|\b800\b", 800), (r"\bblack\b|\bheavy\b|\b900\b", 900))
WEIGHT_PARTS = (("thin", 100), ("extralight|ultralight|extra light|ultra light", 200), ("light", 300), ("medium|(^|[^a-z0-9])md([^a-z0-9]|$)", 500), ("semibold|demibold|demi bold|(^|[^a-z0-9])demi([^a-z0-9]|$)", 600), ("extrabold|ultrabold|extra bold|ultra bold", 800), ("black|heavy", 900), ("bold|(^|[^a-z0-9])bd([^a-z0-9]|$)", 700))


def _first(c: Column, table: tuple, otherwise: Column) -> Column:
    out = otherwise
    for pattern, value in reversed(table):
        out = F.when(c.rlike(pattern), value).otherwise(out)
    return out


def weight_hint(name: Column) -> Column:
    return _first(F.lower(without_subset(name)), WEIGHT_HINTS, F.lit(None).cast("int"))


def style_hint(name: Column) -> Column:
    c = F.lower(without_subset(name))
    return F.when(c.rlike(r"(italic|it)\b"), "italic").when(c.rlike(r"oblique\b"), "oblique").otherwise("normal")


def weight_of(name: Column) -> Column:
    """Weight from a name: a number from 100 to 900 that stands alone, else a word, else 400."""
    c = F.lower(F.coalesce(name, F.lit("")))
    number = F.regexp_extract(c, r"(^|[^0-9])([1-9]00)([^0-9]|$)", 2)
    return F.when(number != "", number.try_cast("int")).otherwise(_first(c, WEIGHT_PARTS, F.lit(400)))


def style_of(name: Column) -> Column:
    c = F.lower(F.coalesce(name, F.lit("")))
    alone = lambda w: f"(^|[^a-z0-9]){w}([^a-z0-9]|$)"
    return F.when(c.rlike(f"italic|{alone('it')}|{alone('ital')}"), "italic").when(c.rlike(f"oblique|{alone('obl')}"), "oblique").otherwise("normal")


ITALIC_FLAG, FORCE_BOLD_FLAG = 64, 262144


def weight_and_style(name: Column, family: Column, flags: Column) -> Column:
    """struct<weight, style> from both names and the font's flags."""
    flags = F.coalesce(flags, F.lit(0))
    weight = F.greatest(weight_of(name), weight_of(family), F.when(flags.bitwiseAND(FORCE_BOLD_FLAG) != 0, 700).otherwise(0))
    by_name = style_of(name)
    style = F.when(flags.bitwiseAND(ITALIC_FLAG) != 0, "italic").when(by_name != "normal", by_name).otherwise(style_of(family))
    return F.struct(weight.alias("weight"), style.alias("style"))


def family_of(name: Column) -> Column:
    """Without one -Bold, then -Italic, -Regular, -Oblique at its end."""
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, f"-{s}$", ""), ("Bold", "Italic", "Regular", "Oblique"), name))


def characteristics(name: Column, average_width: Column, max_width: Column, weight: Column) -> Column:
    lower = F.lower(name)
    return F.struct(
        (lower.rlike("serif|times|georgia|garamond")).alias("is_serif"),
        F.coalesce(average_width / max_width > 0.9, F.lit(False)).alias("is_monospace"),
        F.when(weight < 400, "light").when(weight < 500, "normal").when(weight < 700, "medium").when(weight < 900, "bold").otherwise("heavy").alias("weight_category"),
    )


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal, 0.8 where one holds the other, else one minus the edit distance over the longer length."""
    x, y = F.lower(a), F.lower(b)
    edits = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.8).otherwise(edits)


def word_similarity(a: Column, b: Column) -> Column:
    """1 for equal, 0.8 where one holds the other, else the words of the first that the second has, repeats counted, over the longer number."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    wx, wy = F.split(x, r"[\s-]+"), F.split(y, r"[\s-]+")
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.8).otherwise(F.size(F.filter(wx, lambda w: F.array_contains(wy, w))) / F.greatest(F.size(wx), F.size(wy)))


def metric_similarity(a: Column, b: Column) -> Column:
    """1 minus the difference over the larger size."""
    tiny = F.lit(1e-6)
    return 1 - F.least(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), tiny), F.lit(1.0))


#: Weights of the metrics in the catalogue match and in the comparison with a web font.
CATALOGUE_WEIGHTS = dict(zip(METRICS, (0.22, 0.18, 0.15, 0.15, 0.18, 0.12), strict=True))
COMPARE_WEIGHTS = dict(zip(METRICS, (0.2, 0.2, 0.15, 0.15, 0.15, 0.15), strict=True))


def catalogue_score(mine: dict[str, Column], record: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [metric_similarity(mine[m], record[m]) * w for m, w in CATALOGUE_WEIGHTS.items()])


def compare_metrics(mine: dict[str, Column], other: dict[str, Column]) -> Column:
    """Weighted likeness over the metrics that neither side has as zero."""
    one = lambda m: 1 - F.least(F.abs(mine[m] - other[m]) / F.greatest(mine[m], other[m]), F.lit(1.0))
    both = lambda m: (mine[m] != 0) & (other[m] != 0)
    total = reduce(lambda a, b: a + b, [F.when(both(m), one(m) * w).otherwise(0.0) for m, w in COMPARE_WEIGHTS.items()])
    weight = reduce(lambda a, b: a + b, [F.when(both(m), w).otherwise(0.0) for m, w in COMPARE_WEIGHTS.items()])
    return F.when(weight > 0, total / weight).otherwise(0.0)


def web_font_metrics(category: Column, weight: Column) -> dict[str, Column]:
    """Metrics that a web font of a category and weight should have."""
    pick = lambda serif, mono, other: F.when(category == "serif", serif).when(category == "monospace", mono).otherwise(other)
    factor = F.when(weight >= 700, 1.1).when(weight <= 300, 0.9).otherwise(1.0)
    plain = {"ascent": (750.0, 800.0, 800.0), "descent": (250.0, 200.0, 200.0), "cap_height": (650.0, 700.0, 700.0), "x_height": (450.0, 500.0, 500.0), "average_width": (500.0, 600.0, 500.0), "max_width": (800.0, 600.0, 800.0)}
    return {m: pick(*v) * (factor if m.endswith("width") else 1.0) for m, v in plain.items()}


def per_thousand(value: Column, units: Column) -> Column:
    return value / F.when(units > 0, units).otherwise(1000.0) * 1000


def are_real_units(values: list[Column]) -> Column:
    """At least four numbers whose sizes are those of font units."""
    some = F.filter(F.array(*values), lambda v: v.isNotNull() & ~F.isnan(v))
    sizes = F.transform(some, F.abs)
    most, least = F.array_max(sizes), F.array_min(sizes)
    return (F.size(some) >= 4) & (most >= 150) & (most <= 5000) & ~((least == 0) & (most < 250))


def char_units(ch: Column, average: Column, space: Column) -> Column:
    """Width of a character in units of the record that its class gives."""
    factor = F.when(ch.rlike("[0-9]"), 0.95).when(ch.rlike("[A-Z]"), 1.05).when(ch.rlike("[a-z]"), 0.98).when(ch.rlike("[,.;:!?]"), 0.55)
    return F.when(ch == " ", F.coalesce(space, average)).when(factor.isNotNull(), F.greatest(F.lit(1.0), average * factor)).otherwise(average)


def fallback_id(key: Column) -> Column:
    return F.when(key.rlike("mono|courier"), "default_mono").when(key.rlike("serif|times|roman"), "default_serif").otherwise("default_sans")


def resolve_names(fonts: DataFrame, alias_table: DataFrame, name: str = "font_family") -> DataFrame:
    """Adds ``record_id`` and ``reason``: by normalised name, else a fallback by its words."""
    rows = fonts.withColumn("key_", normalized_family(F.col(name)))
    rows = rows.join(alias_table.select(F.col("alias").alias("a_"), F.col("id").alias("i_")), F.col("key_") == F.col("a_"), "left")
    return rows.select(*[F.col(c) for c in fonts.columns], F.coalesce("i_", fallback_id(F.col("key_"))).alias("record_id"), F.when(F.col("i_").isNotNull(), "alias").otherwise("fallback").alias("reason"))


def resolve_metrics(fonts: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, record_id, score, reason: the record with the best weighted likeness, the first of equals; a default under 0.55.

    ``records`` is the catalogue, a table of fixed size, so a pair of each font with each record is a bounded product.
    """
    mine = {m: F.col(f"f.{m}") for m in METRICS}
    scored = fonts.alias("f").join(F.broadcast(records.alias("r")), F.lit(True)).select(*[F.col(f"f.{k}") for k in keys], *mine.values(), F.col("r.id"), F.col("r.pos"), catalogue_score(mine, {m: F.col(f"r.{m}") for m in METRICS}).alias("score"))
    best = scored.groupBy(*keys, *METRICS).agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), F.col("pos"))).alias("best"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("best.score")))
    default = F.when((F.col("max_width") > 0) & (F.col("average_width") / F.col("max_width") > 0.88), "default_mono").otherwise("default_sans")
    return best.select(*keys, F.when(score < 0.55, default).otherwise(F.col("best.id")).alias("record_id"), F.when(score < 0.55, 0.5).otherwise(score).alias("score"), F.when(score < 0.55, "fallback").otherwise("metrics").alias("reason"))


def map_to_web_fonts(fonts: DataFrame, catalog: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Detected fonts (font_no, name, family, weight, style, six metrics) with the web font, weight, similarity and fallback chain.

    Candidates share the kind of font and a name likeness above 0.3; the best likeness of threshold or more wins, the first
    in the catalogue of equals; without one a default of the kind.  The catalogue is a table of fixed size.
    """
    traits = characteristics(F.col("name"), F.col("average_width"), F.col("max_width"), F.col("weight"))
    rows = fonts.withColumn("traits", traits)
    c = catalog.select(*[F.col(x).alias(f"c_{x}") for x in catalog.columns])
    kind = (
        F.when(F.col("traits.is_monospace") & (F.col("c_category") != "monospace"), False)
        .when(F.col("traits.is_serif") & (F.col("c_category") != "serif"), False)
        .when(~F.col("traits.is_serif") & ~F.col("traits.is_monospace") & (F.col("c_category") == "serif"), False)
        .otherwise(True)
    )
    likeness = word_similarity(F.col("family"), F.col("c_family")) * 0.3 + compare_metrics({m: F.col(m) for m in METRICS}, web_font_metrics(F.col("c_category"), F.col("c_weight"))) * 0.7
    met = rows.join(F.broadcast(c), kind & (name_similarity(F.col("family"), F.col("c_family")) > 0.3)).withColumn("similarity", likeness).where(F.col("similarity") >= threshold)
    best = met.groupBy("font_no").agg(F.min_by(F.struct("c_family", "c_weight", "similarity"), F.struct(-F.col("similarity"), F.col("c_pos"), F.col("c_weight_pos"))).alias("best"))
    out = rows.join(best, "font_no", "left")
    default = F.when(F.col("traits.is_monospace"), "Roboto Mono").when(F.col("traits.is_serif"), "Merriweather").otherwise("Roboto")
    found = F.col("best").isNotNull()
    family = F.when(found, F.col("best.c_family")).otherwise(default)
    tail = F.when(found & F.col("traits.is_monospace"), "Courier New, monospace").when(found & F.col("traits.is_serif"), "Times New Roman, serif").otherwise("Arial, sans-serif")
    return out.select(
        "font_no",
        "name",
        family.alias("web_family"),
        F.when(found, F.col("best.c_weight")).otherwise(400).alias("web_weight"),
        F.when(found, F.col("best.similarity")).otherwise(0.5).alias("similarity"),
        F.concat(family, F.lit(", "), tail).alias("fallback_chain"),
    )


def class_suffix(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-"), "^-+", ""), "-+$", "")


def quoted(family: Column) -> Column:
    """Generic names bare and lower, names with spaces in quotes."""
    raw = F.trim(family)
    return F.when(F.lower(raw).isin("serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui"), F.lower(raw)).when(raw.rlike("^\".*\"$|^'.*'$"), raw).when(raw.contains(" "), F.concat(F.lit("'"), raw, F.lit("'"))).otherwise(raw)


def css_stack(family: Column, category: Column) -> Column:
    own = F.when(family.contains(" "), F.concat(F.lit("'"), family, F.lit("'"))).otherwise(family)
    tail = F.when(category == "serif", ", 'Times New Roman', Times, serif").when(category == "monospace", ", 'Courier New', Courier, monospace").otherwise(", Arial, Helvetica, sans-serif")
    return F.concat(own, tail)
