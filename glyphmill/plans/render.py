"""Rendering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PRESETS, HtmlOptions
from ..functions import fonts as N
from ..functions import markup as M
from ..functions import text as X
from ..operators import adapter as A
from ..operators import documents as D
from ..operators import layout as L
from ..operators import render as R
from ..schema import PAGE_HEIGHT
from ..sources.typesetter import LINES_SQL, WORDS_SQL
from .documents import annotations, forms
from .fonts import _fonts
from .layout import _REGIONS, lines_and_words, words_of


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir)
    return R.with_style_classes(words, M.style_key(F.col("font_size"), F.col("color"), F.col("font_weight"), F.col("font_style")))


def style_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.style_sheet(_styled(spark, sf_dir)).select("doc_id", F.md5("css").alias("css_md5"))


def html_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with every word in its place; each has one more page than it has text for."""
    styled = _styled(spark, sf_dir)
    pages = R.pages_html(R.absolute_text(styled))
    counts = styled.groupBy("doc_id").agg((F.max("page_no") + 2).alias("page_count"))
    html = R.documents_html(pages, counts)
    return html.select("doc_id", F.length("html").cast("long").alias("n_chars"), F.md5("html").alias("html_md5"))


def html_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, words = lines_and_words(spark, sf_dir)
    marked = lines.withColumn("text", F.when(F.col("line_no") % 6 == 2, F.concat(F.lit("• "), "text")).when(F.col("line_no") % 6 == 4, F.concat(F.lit("1. "), "text")).otherwise(F.col("text")))
    rows = L.with_paragraphs(L.with_regions(D.heading_lines(marked), L.page_sizes(words)))
    return R.semantic_html(rows).select("doc_id", "page_no", F.length("html").cast("long").alias("n_chars"), F.md5("html").alias("html_md5"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = lines_and_words(spark, sf_dir)
    return R.page_text(lines).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def svg_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir).withColumn("width", F.col("width") * F.when(F.col("word_no") % 8 == 3, 4.0).otherwise(1.0))
    return R.svg_layer(words).select("doc_id", "page_no", "n_html", F.md5("svg").alias("svg_md5"))


def flex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flex_lines(words_of(spark, sf_dir)).select(*L.LINE, F.md5("html").alias("html_md5"))


def flex_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of placed words, half of them within a shifted region, read back and laid out as flex rows; some words have no font, some no width."""
    words = words_of(spark, sf_dir)
    n = F.col("line_no") + F.col("word_no")
    top = PAGE_HEIGHT - (F.col("y") + F.col("height")) + F.when(n % 6 == 1, 3.0).otherwise(0.0)
    style = F.concat(F.lit("position: absolute; left: "), M.px(F.col("x")), F.lit("; top: "), M.px(top), F.when(n % 3 == 0, F.concat(F.lit("; width: "), M.px(F.col("width")))).otherwise(""))
    text = M.element("span", X.escape_html(F.col("text")), {"class": F.when(n % 13 == 0, "gap").otherwise("t"), "data-font-family": F.when(n % 7 != 0, F.col("font_family")), "data-font-size": F.when(n % 5 != 0, M.number(F.col("font_size"))), "style": style})
    shifted = lambda said: F.when(F.col("line_no") % 2 == 1, said).otherwise("")
    inner = F.concat(shifted('<div class="region" style="position: absolute; left: 10px; top: 4.5px"><b>'), text, shifted("</b></div>"))
    pieces = words.select(*L.PAGE, "line_no", "word_no", inner.alias("html"))
    found = A.adapted(pieces, ["line_no", "word_no"], " ", '<div class="page"><br>', "</div>")
    times = lambda part: F.floor((F.octet_length("html") - F.octet_length(F.replace("html", F.lit(part), F.lit("")))) / len(part))
    absolute, elements = times("position: absolute") + times("left:") + times("top:"), times("<span")
    return found.select(*L.PAGE, "n_rows", "n_spacers", F.round("widths", 6).alias("widths"), F.round("heights", 6).alias("heights"), elements.cast("long").alias("n_elements"), absolute.cast("long").alias("n_absolute"))


def token_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of lines as tokens; a space stands where the gap before a word is half a character or more."""
    words = words_of(spark, sf_dir)
    line = Window.partitionBy(*L.LINE).orderBy("x", "word_no")
    gap = F.col("x") - (F.lag("x").over(line) + F.lag("width").over(line))
    tokens = words.select(*L.LINE, "word_no", "text", F.coalesce(gap >= 2.75, F.lit(False)).alias("space"), F.concat(F.lit("font-"), N.class_suffix(F.col("font_family"))).alias("cls"))
    return R.token_html(tokens, L.LINE, ["word_no"]).select(*L.LINE, F.md5("html").alias("html_md5"))


def css_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts of ten parts make a document."""
    f = _fonts(spark, sf_dir)
    f = f.select("font_no", "name", N.family_of(F.col("name")).alias("family"), N.weight_of(F.col("name")).cast("int").alias("weight"), *N.METRICS)
    mapped = N.map_to_web_fonts(f, N.web_fonts(spark), 0.55).join(f.select("font_no", "weight"), "font_no")
    rows = mapped.select(F.floor(F.col("font_no") / 10).alias("doc_id"), "web_family", F.col("weight"), F.col("font_no").alias("seq"), "fallback_chain")
    a, b = R.font_imports(rows), R.font_rules(rows)
    return a.withColumnRenamed("css", "imports").join(b.withColumnRenamed("css", "rules"), "doc_id")


def css_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed sections under each preset and with everything on."""
    made = [(n, R.base_css(c.html, [(0, 612.0, 792.0), (1, 792.0, 612.0)])) for n, c in PRESETS.items()] + [("all", R.base_css(HtmlOptions(dark_mode=True, custom_styles=".x {}"), []))]
    rows = spark.createDataFrame(made, "preset string, css string")
    shell = R.page_shell(F.lit("a<b"), F.lit("<p>x</p>"), F.col("css"), HtmlOptions())
    return rows.select("preset", F.regexp_count("css", F.lit(r"\{")).cast("long").alias("n_braces"), F.col("css").contains("@media print").alias("prints"), shell.contains("<title>a&lt;b</title><style>").alias("inline"))


def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables, line items as rows."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    rows = items.select(F.col("l_orderkey").alias("doc_id"), row.alias("r"))
    rows = rows.distinct().select("doc_id", F.col("r").alias("row_no"), F.posexplode(F.array(F.col("r.l_partkey").cast("string"), F.concat(F.col("r.l_returnflag"), F.lit(" & <"), F.col("r.l_linestatus"), F.lit(">")), F.col("r.l_suppkey").cast("string"))).alias("col", "text"))
    return R.table_html(rows).select("doc_id", F.md5("html").alias("html_md5"))


def form_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forms(spark, sf_dir)
    style = M.placed_box(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    return rows.select("doc_id", M.form_field(F.col("type"), F.concat("name", F.lit('"<')), F.col("value_str"), F.col("value_bool") == "true", style).alias("html"))


def annotation_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotations(spark, sf_dir)
    style = M.placed_box(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    return rows.select("doc_id", M.annotation(F.col("type"), F.concat("content", F.lit("<&")), F.col("url"), style).alias("html"))


def graphics_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as shapes of all kinds."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    kind = F.get(F.array(*map(F.lit, ("path", "rectangle", "circle", "line", "curve", "raster"))), (k % 6).cast("int"))
    path = F.when(k % 12 != 0, F.concat(F.lit("M 0 0 L "), k.cast("string"), F.lit(" 5")))
    html = M.graphic(kind, path, (k % 50).cast("double"), F.lit(7.25), (k % 40 + 1).cast("double"), F.lit(3.0), F.when(k % 2 == 0, "#112233"), F.when(k % 3 == 0, "#ffffff"), (k % 4).cast("double") / 2)
    return s.select(k.alias("id"), html.alias("svg"))


def image_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey").cast("double")
    src = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("s_name").cast("binary"))))
    return s.select(F.col("s_suppkey").alias("id"), M.image(src, k, PAGE_HEIGHT - k, k / 4, F.lit(20.0)).alias("html"))


QUERIES = {f.__name__: f for f in (style_dictionary, html_absolute, html_semantic, page_text, svg_text_layer, flex_lines, flex_adapter, token_html, css_imports, css_sections, table_html, form_html, annotation_html, graphics_svg, image_html)}


def _esc(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


def _num(c: str) -> str:
    return f"regexp_replace(CAST(CAST(round({c}, 3) AS DECIMAL(20,3)) AS VARCHAR), '\\.?0+$', '')"


def _box(x: str, y: str, w: str, h: str) -> str:
    return f"'position: absolute; left: ' || {_num(x)} || 'px; top: ' || {_num(y)} || 'px; width: ' || {_num(w)} || 'px; height: ' || {_num(h)} || 'px'"


_KEY = f"'color:' || color || ';font-size:' || {_num('font_size')} || 'px' || CASE WHEN font_style <> 'normal' THEN ';font-style:' || font_style ELSE '' END || CASE WHEN font_weight <> 400 THEN ';font-weight:' || font_weight ELSE '' END"
_STYLED = (
    WORDS_SQL
    + f""",
k AS (SELECT *, {_KEY} AS style_key FROM words),
n AS (SELECT doc_id, style_key, row_number() OVER (PARTITION BY doc_id ORDER BY min(CAST(line_no AS BIGINT) * 100000 + word_no)) - 1 AS nr FROM k GROUP BY doc_id, style_key)
"""
)
_FORM_BOX = _box("x", "y", "50.0", "20.0")
_FORM_NAME = _esc("p_name || '\"<'")
_NOTE_BOX = _box("CAST(c_custkey % 500 AS DOUBLE)", "792.0 - (c_custkey % 500 + 30)", "40.0", "20.0")
_NOTE = _esc("c_mktsegment || '<&'")
ORACLES = {
    "token_html": WORDS_SQL
    + """,
t AS (
  SELECT *, coalesce(x - (lag(x) OVER w + lag(width) OVER w) >= 2.75, false) AS space, regexp_replace(regexp_replace(regexp_replace(lower(font_family), '[^a-z0-9]+', '-', 'g'), '^-+', ''), '-+$', '') AS slug,
    replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS said
  FROM words WINDOW w AS (PARTITION BY doc_id, page_no, line_no ORDER BY x, word_no))
SELECT doc_id, page_no, line_no, md5(string_agg(CASE WHEN space THEN ' ' ELSE '' END || '<span class="font-' || slug || '">' || said || '</span>', '' ORDER BY word_no)) AS html_md5 FROM t GROUP BY doc_id, page_no, line_no
""",
    "flex_adapter": WORDS_SQL.replace("WITH", "WITH RECURSIVE", 1)
    + r""",
e AS (
  SELECT doc_id, page_no, line_no, word_no, x + CASE WHEN line_no % 2 = 1 THEN 10.0 ELSE 0.0 END AS x,
    792.0 - (y + height) + CASE WHEN (line_no + word_no) % 6 = 1 THEN 3.0 ELSE 0.0 END + CASE WHEN line_no % 2 = 1 THEN 4.5 ELSE 0.0 END AS top,
    CASE WHEN (line_no + word_no) % 5 <> 0 THEN font_size ELSE 12.0 END AS size, width, text FROM words WHERE (line_no + word_no) % 7 <> 0 AND (line_no + word_no) % 13 <> 0),
b AS (
  SELECT *, CASE WHEN (line_no + word_no) % 3 = 0 THEN width ELSE greatest(1.0, floor(length(regexp_replace(text, '\s+', ' ', 'g')) * greatest(2.0, size * 0.55) * 1000 + 0.5) / 1000.0) END AS w,
    greatest(1.0, floor(size * 1.15 * 1000 + 0.5) / 1000.0) AS h FROM e),
tp AS (SELECT doc_id, page_no, top, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY top) AS k FROM b GROUP BY doc_id, page_no, top),
rc AS (
  SELECT doc_id, page_no, top, k, top AS anchor, 0 AS row FROM tp WHERE k = 1
  UNION ALL
  SELECT tp.doc_id, tp.page_no, tp.top, tp.k, CASE WHEN tp.top - anchor > 8.0 THEN tp.top ELSE anchor END, row + CASE WHEN tp.top - anchor > 8.0 THEN 1 ELSE 0 END
  FROM rc JOIN tp ON rc.doc_id = tp.doc_id AND rc.page_no = tp.page_no AND tp.k = rc.k + 1),
g AS (
  SELECT b.*, row, x - greatest(0.0, coalesce(max(x + greatest(0.0, w)) OVER (PARTITION BY b.doc_id, b.page_no, row ORDER BY x, b.top, line_no, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS gap
  FROM b JOIN rc ON b.doc_id = rc.doc_id AND b.page_no = rc.page_no AND b.top = rc.top),
r AS (SELECT doc_id, page_no, row, min(top) AS top, max(h) AS h, count(*) AS n, count(CASE WHEN gap > 0.5 THEN 1 END) AS spacers, coalesce(sum(CASE WHEN gap > 0.5 THEN gap END), 0.0) AS widths FROM g GROUP BY doc_id, page_no, row),
v AS (SELECT *, lead(top) OVER (PARTITION BY doc_id, page_no ORDER BY row) - (top + h) AS below FROM r)
SELECT doc_id, page_no, count(*) AS n_rows, CAST(sum(spacers) + count(CASE WHEN below > 0.5 THEN 1 END) AS BIGINT) AS n_spacers, round(sum(widths), 6) AS widths,
  round(coalesce(sum(CASE WHEN below > 0.5 THEN below END), 0.0), 6) AS heights, CAST(sum(n) AS BIGINT) AS n_elements, CAST(0 AS BIGINT) AS n_absolute FROM v GROUP BY doc_id, page_no
""",
    "style_dictionary": _STYLED + "SELECT doc_id, md5(string_agg('.s' || nr || ' { ' || replace(style_key, ';', '; ') || '; }', chr(10) ORDER BY nr)) AS css_md5 FROM n GROUP BY doc_id",
    "html_absolute": _STYLED
    + f""",
f AS (
  SELECT k.doc_id, page_no, line_no, word_no, CASE WHEN font_style <> 'normal' THEN 'em' WHEN font_weight >= 600 THEN 'strong' ELSE 'span' END AS tag,
    ' class="s' || nr || '" style="position: absolute; left: ' || {_num("x")} || 'px; top: ' || {_num("792.0 - (y + height)")} || 'px; line-height: ' || {_num("greatest(1.0, floor(greatest(height, font_size * 1.15) + 0.5))")} || 'px">' || {_esc("text")} AS said
  FROM k JOIN n ON k.doc_id = n.doc_id AND k.style_key = n.style_key),
p AS (SELECT doc_id, page_no, string_agg('<' || tag || said || '</' || tag || '>', '' ORDER BY line_no, word_no) AS body FROM f GROUP BY doc_id, page_no),
c AS (SELECT doc_id, unnest(range(0, max(page_no) + 2)) AS page_no FROM words GROUP BY doc_id),
d AS (SELECT c.doc_id, string_agg('<div class="page page-' || (c.page_no + 1) || '" style="position: relative; width: 612px; height: 792px">' || coalesce(body, '') || '</div>', chr(10) ORDER BY c.page_no) AS html
  FROM c LEFT JOIN p ON c.doc_id = p.doc_id AND c.page_no = p.page_no GROUP BY c.doc_id)
SELECT doc_id, length(html) AS n_chars, md5(html) AS html_md5 FROM d
""",
    "page_text": LINES_SQL
    + """,
g AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, page_no ORDER BY top, min_x, line_no) AS prev FROM lines),
p AS (SELECT doc_id, page_no, string_agg(CASE WHEN prev IS NULL OR (regexp_matches(prev, '[A-Z][a-z]{0,2}$') AND regexp_matches(text, '^[a-z]{3,}')) THEN '' ELSE chr(10) END || text, '' ORDER BY top, min_x, line_no) AS text FROM g GROUP BY doc_id, page_no),
d AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text FROM p GROUP BY doc_id)
SELECT doc_id, length(text) AS n_chars, md5(text) AS text_md5 FROM d
""",
    "html_semantic": _REGIONS.replace("\nsizes AS", "\nhm AS (SELECT doc_id, page_no, quantile_cont(font_size, 0.5) AS ms FROM lines GROUP BY doc_id, page_no),\nsizes AS")
    + f""",
t0 AS (SELECT l2.* REPLACE (CASE WHEN line_no % 6 = 2 THEN '• ' || text WHEN line_no % 6 = 4 THEN '1. ' || text ELSE text END AS text), font_size / ms AS ratio FROM l2 JOIN hm ON l2.doc_id = hm.doc_id AND l2.page_no = hm.page_no),
t1 AS (SELECT *, CASE WHEN trim(text) <> '' AND length(trim(text)) <= 100 AND ratio >= 1.2 AND (font_weight > 450 OR (trim(text) = upper(trim(text)) AND regexp_matches(text, '[A-Z]')))
    THEN CASE WHEN ratio >= 2.0 THEN 1 WHEN ratio >= 1.8 THEN 2 WHEN ratio >= 1.5 THEN 3 WHEN ratio >= 1.3 THEN 4 ELSE 5 END END AS heading,
  top - lag(top + height) OVER w AS gap, abs(min_x - lag(min_x) OVER w) AS shift, lag(text) OVER w AS ptext FROM t0 WINDOW w AS (PARTITION BY doc_id, page_no, region_no ORDER BY top, min_x, line_no)),
t2 AS (SELECT *, gap IS NULL OR gap > greatest(4.0, mh * 0.8) OR (shift > greatest(10.0, mh * 1.2) AND gap > greatest(1.0, mh * 0.15)) AS starts FROM t1),
t3 AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, region_no ORDER BY top, min_x, line_no) - 1 AS paragraph_no,
  NOT starts AND regexp_matches(ptext, '[A-Z][a-z]{{0,2}}$') AND regexp_matches(text, '^[a-z]{{3,}}') AS joins,
  CASE WHEN regexp_matches(text, '^[•●○■□◆◇▪▫]\\s+') OR regexp_matches(text, '^[-–—]\\s+') THEN 'ul' WHEN regexp_matches(text, '^\\(?\\d+[.)\\]]\\s+') OR regexp_matches(text, '^\\(?[A-Za-z][.)\\]]\\s+') OR regexp_matches(text, '^\\(?[ivxIVX]+[.)\\]]\\s+') THEN 'ol' END AS kind FROM t2),
items AS (
  SELECT doc_id, page_no, top, min_x, line_no, kind, '<li>' || {_esc("CASE WHEN regexp_matches(text, '^[•●○■□◆◇▪▫]\\s+') THEN regexp_replace(text, '^[•●○■□◆◇▪▫]\\s+', '') WHEN regexp_matches(text, '^[-–—]\\s+') THEN regexp_replace(text, '^[-–—]\\s+', '') ELSE regexp_replace(text, '^\\(?(\\d+|[A-Za-z]|[ivxIVX]+)[.)\\]]\\s+', '') END")} || '</li>' AS html FROM t3 WHERE kind IS NOT NULL),
prose AS (
  SELECT doc_id, page_no, region_no, paragraph_no, min(top) AS top, min_by(min_x, top) AS min_x, min(line_no) AS line_no, count(*) AS n, max(heading) AS level,
    ltrim(string_agg(CASE WHEN coalesce(joins, false) THEN '' ELSE ' ' END || {_esc("text")}, '' ORDER BY top, min_x, line_no)) AS said FROM t3 WHERE kind IS NULL GROUP BY doc_id, page_no, region_no, paragraph_no),
both_ AS (
  SELECT * FROM items UNION ALL SELECT doc_id, page_no, top, min_x, line_no, 'block', CASE WHEN n = 1 AND level IS NOT NULL THEN '<h' || level || '>' || said || '</h' || level || '>' ELSE '<p>' || said || '</p>' END FROM prose),
o AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id, page_no ORDER BY top, min_x, line_no) AS pk FROM both_),
r AS (SELECT *, sum(CASE WHEN kind = 'block' OR pk IS NULL OR kind <> pk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY top, min_x, line_no) AS run FROM o),
g AS (SELECT doc_id, page_no, run, kind, string_agg(html, chr(10) ORDER BY top, min_x, line_no) AS html FROM r GROUP BY doc_id, page_no, run, kind),
d AS (SELECT doc_id, page_no, string_agg(CASE WHEN kind = 'block' THEN html ELSE '<' || kind || '>' || chr(10) || html || chr(10) || '</' || kind || '>' END, chr(10) || chr(10) ORDER BY run) AS html FROM g GROUP BY doc_id, page_no)
SELECT doc_id, page_no, length(html) AS n_chars, md5(html) AS html_md5 FROM d
""",
    "svg_text_layer": WORDS_SQL
    + f""",
m AS (SELECT * REPLACE (width * CASE WHEN word_no % 8 = 3 THEN 4.0 ELSE 1.0 END AS width) FROM words),
s AS (SELECT *, length(trim(text)) >= 2 AND width / (length(text) * font_size * 0.6) >= 0.3 AND width / (length(text) * font_size * 0.6) <= 3 AND font_size <= 72 AS safe FROM m)
SELECT doc_id, page_no, count(CASE WHEN NOT safe THEN 1 END) AS n_html, md5('<svg width="612" height="792">' || string_agg(CASE WHEN safe THEN '<text x="' || {_num("x")} || '" y="' || {_num("792.0 - y")} || '" textLength="' || {_num("width")} || '" lengthAdjust="spacing" style="font-size: ' || {_num("font_size")} || 'px; fill: ' || color || '">' || {_esc("text")} || '</text>' ELSE '' END, '' ORDER BY line_no, word_no) || '</svg>') AS svg_md5
FROM s GROUP BY doc_id, page_no
""",
    "flex_lines": WORDS_SQL
    + f""",
b AS (SELECT *, max(x + width) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY x, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, min(x) OVER (PARTITION BY doc_id, page_no, line_no) AS first FROM words),
g AS (SELECT *, greatest(0.0, x - coalesce(reach, first)) AS gap FROM b)
SELECT doc_id, page_no, line_no, md5('<div class="line" style="display: flex; padding-left: ' || {_num("any_value(first)")} || 'px">' || string_agg('<span' || CASE WHEN gap > font_size * 0.35 THEN ' style="margin-left: ' || {_num("gap")} || 'px"' ELSE '' END || '>' || {_esc("text")} || '</span>', ' ' ORDER BY x, word_no) || '</div>') AS html_md5
FROM g GROUP BY doc_id, page_no, line_no
""",
    "table_html": f"""
WITH i AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem),
r AS (SELECT *, '<tr><td>' || l_partkey || '</td><td>' || {_esc("l_returnflag || ' & <' || l_linestatus || '>'")} || '</td><td>' || l_suppkey || '</td></tr>' AS html FROM i)
SELECT l_orderkey AS doc_id, md5('<table>' || string_agg(html, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) || '</table>') AS html_md5 FROM r GROUP BY l_orderkey
""",
    "form_html": f"""
WITH f AS (SELECT *, CAST(p_partkey % 400 AS DOUBLE) AS x, 792.0 - (p_partkey % 400 + 20) AS y FROM part WHERE p_partkey % 9 <> 0),
s AS (SELECT p_partkey, {_FORM_NAME} AS name, {_esc("coalesce(CASE WHEN p_partkey % 8 <> 1 THEN p_type END, '')")} AS said, {_FORM_BOX} AS style FROM f)
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 IN (0, 3) THEN '<input type="text" name="' || name || '" value="' || said || '" style="' || style || '" />'
  WHEN p_partkey % 8 = 1 THEN '<input type="checkbox" name="' || name || '" style="' || style || '"' || CASE WHEN p_partkey % 16 = 1 THEN ' checked' ELSE '' END || ' />'
  WHEN p_partkey % 4 = 1 THEN '<button name="' || name || '" style="' || style || '">' || said || '</button>' ELSE '<select name="' || name || '" style="' || style || '"><option>' || said || '</option></select>' END AS html FROM s
""",
    "annotation_html": f"""
WITH s AS (SELECT c_custkey, {_NOTE} AS said, {_NOTE_BOX} AS style, CASE WHEN c_custkey % 2 = 0 THEN 'http://x/' || c_name END AS url FROM customer WHERE c_custkey % 11 <> 0)
SELECT c_custkey AS doc_id, CASE c_custkey % 6 WHEN 0 THEN CASE WHEN url IS NULL THEN '' ELSE '<a href="' || {_esc("url")} || '" style="' || style || '">' || said || '</a>' END
  WHEN 1 THEN '<div class="annotation-highlight" style="' || style || '; background: yellow; opacity: 0.3">' || said || '</div>' WHEN 2 THEN '<span class="annotation-underline" style="' || style || '; text-decoration: underline">' || said || '</span>'
  WHEN 3 THEN '<span class="annotation-strikeout" style="' || style || '; text-decoration: line-through">' || said || '</span>' ELSE '<div class="annotation-note" style="' || style || '" title="' || said || '">📝</div>' END AS html FROM s
""",
    "graphics_svg": f"""
WITH s AS (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN ' stroke="#112233"' ELSE '' END || ' fill="' || CASE WHEN s_suppkey % 3 = 0 THEN '#ffffff' ELSE 'none' END || '"' || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE ' stroke-width="' || {_num("(s_suppkey % 4) / 2.0")} || '"' END AS look,
    CAST(s_suppkey % 50 AS DOUBLE) AS x, s_suppkey % 40 + 1.0 AS w FROM supplier)
SELECT k AS id, CASE k % 6 WHEN 1 THEN '<rect x="' || {_num("x")} || '" y="7.25" width="' || {_num("w")} || '" height="3"' || look || ' />' WHEN 2 THEN '<circle cx="' || {_num("x + w / 2")} || '" cy="' || {_num("7.25 + w / 2")} || '" r="' || {_num("w / 2")} || '"' || look || ' />'
  WHEN 3 THEN '<line x1="' || {_num("x")} || '" y1="7.25" x2="' || {_num("x + w")} || '" y2="10.25"' || look || ' />' WHEN 5 THEN '' ELSE CASE WHEN k % 12 = 0 THEN '' ELSE '<path d="M 0 0 L ' || k || ' 5"' || look || ' />' END END AS svg FROM s
""",
    "image_html": f"""
SELECT s_suppkey AS id, '<img src="' || CASE WHEN s_suppkey % 3 <> 0 THEN {_esc("'data:image/png;base64,' || base64(encode(s_name))")} ELSE '#' END || '" alt="" style="' || {_box("CAST(s_suppkey AS DOUBLE)", "792.0 - s_suppkey", "s_suppkey / 4.0", "20.0")} || '" />' AS html FROM supplier
""",
}
