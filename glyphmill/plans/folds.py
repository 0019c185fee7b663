"""Queries of the folds.  Where a page has few steps SQL walks them by recursion; the others are tested by what they must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.words import frequent_words, word_set
from ..operators import folds as O
from ..operators import layout as L
from ..schema import PAGE_HEIGHT
from ..sources.typesetter import LINES_SQL, WORDS_SQL
from .layout import _REGIONS, lines_and_words, words_of


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as items whose y strays a little from their line."""
    n = F.col("line_no") + F.col("word_no")
    return words_of(spark, sf_dir).withColumn("item_no", F.col("line_no").cast("long") * 100_000 + F.col("word_no")).withColumn("y", F.col("y") + F.when(n % 5 == 1, 0.5).when(n % 5 == 3, -0.5).otherwise(0.0))


def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.per_page(_items(spark, sf_dir).select(*L.PAGE, "item_no", "text", "x", "y", "width", "height"), O.running_lines, "item_no long, line int")
    return found.groupBy(*L.PAGE, "line").agg(F.count("*").alias("n_items"), F.min("item_no").alias("first_item"))


def _strewn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items far enough off their lines to join others: anchors overlap, tie and come in another order than heights."""
    n = (F.col("line_no") * 5 + F.col("word_no") * 3) % 11
    return _items(spark, sf_dir).withColumn("y", F.col("y") + n * 1.25 - 6.0)


def anchored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.per_page(_strewn(spark, sf_dir).select(*L.PAGE, "item_no", "y"), O.anchored_lines, "item_no long, line long")
    return found.groupBy(*L.PAGE, "line").agg(F.count("*").alias("n_items"), F.min("item_no").alias("first_item"))


def row_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.per_page(_strewn(spark, sf_dir).select(*L.PAGE, "item_no", "x", "y"), O.clustered_rows, "item_no long, row long")
    return found.groupBy(*L.PAGE, "row").agg(F.count("*").alias("n_items"), F.min("item_no").alias("first_item"))


def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select(*L.LINE, "item_no", "text", "x", "width", "font_family", "font_size", "color")
    found = O.per_page(rows, O.by_line(O.merged_runs), "line_no int, run int, text string, x double, width double, n int")
    return found.select(*L.LINE, "run", F.md5("text").alias("text_md5"), "x", "width", "n")


def fragment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select(*L.PAGE, "item_no", "text", "x", "y", "width", "font_family", "font_size")
    found = O.per_page(rows, O.merged_fragments, "item int, text string, x double, y double, width double, n int")
    return found.select(*L.PAGE, "item", F.md5("text").alias("text_md5"), "x", "y", "width", "n")


def style_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select(*L.PAGE, "item_no", "x", "y", "width", "height", "font_family", "font_weight", "font_style")
    found = O.per_page_columns(rows, O.grown_cluster_columns, "item_no long, cluster int", [])
    return found.groupBy(*L.PAGE, "cluster").agg(F.count("*").alias("n_items"), F.min("item_no").alias("first_item"))


def spatial_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select(*L.PAGE, "item_no", "x", "y", "width", "height")
    found = O.per_page(rows, O.spatial_groups, "item_no long, group int, kind string")
    return found.groupBy(*L.PAGE, "group", "kind").agg(F.count("*").alias("n_items"), F.min("item_no").alias("first_item"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of a page as blocks; some are lists, some headings of notes."""
    lines, words = lines_and_words(spark, sf_dir)
    found = L.with_paragraphs(L.with_regions(lines, L.page_sizes(words)))
    rows = found.groupBy(*L.PAGE, "region_no", "paragraph_no").agg(F.min("top").alias("top"), F.max(F.col("top") + F.col("height")).alias("bottom"), F.min("min_x").alias("indent"), F.min("font_size").alias("font_size"), F.min_by("text", "line_no").alias("text"))
    n = F.col("region_no") * 1000 + F.col("paragraph_no")
    kind = F.when(n % 5 == 1, "list").when(n % 11 == 3, "heading").otherwise("paragraph")
    return rows.select(*L.PAGE, n.alias("block_no"), kind.alias("kind"), F.when(n % 2 == 0, "ul").otherwise("ol").alias("list_kind"), "top", "bottom", "indent", "font_size", F.when(n % 7 == 2, F.lit("IMPORTANT NOTES")).otherwise(F.col("text")).alias("text"))


def block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.per_page(_blocks(spark, sf_dir).drop("text"), O.merged_blocks, "block_no int, merged int")
    return found.groupBy(*L.PAGE, "merged").agg(F.count("*").alias("n_blocks"), F.min("block_no").alias("first_block"))


def notes_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.per_page(_blocks(spark, sf_dir).select(*L.PAGE, "block_no", "kind", "text", "indent"), O.rewritten_notes, "block_no int, kind string, text string")
    return found.select(*L.PAGE, "block_no", "kind", F.md5("text").alias("text_md5"))


def paragraph_chase(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = lines_and_words(spark, sf_dir)
    rows = lines.select(*L.LINE, (PAGE_HEIGHT - F.col("top")).alias("y"), F.lit(8.0).alias("height"))
    return O.per_page(rows, O.chased_paragraph, "line_no int, length int")


def line_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = lines_and_words(spark, sf_dir)
    rows = lines.select(*L.LINE, "top", (F.col("height") * 1.25).alias("height"))
    return O.per_page(rows, O.separated, "line_no int, top double")


def style_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = lines_and_words(spark, sf_dir)
    rows = lines.select(*L.LINE, F.col("min_x").alias("x"), "top", "height", F.col("font_size").cast("string").alias("style"))
    found = O.per_page(rows, O.style_paragraphs, "line_no int, group int")
    return found.groupBy(*L.PAGE, "group").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


def glyph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as glyphs of 5.5 each, with spaces between some of them."""
    words = words_of(spark, sf_dir)
    text = F.when(F.col("word_no") % 3 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    chars = words.select(*L.LINE, "word_no", "x", "y", "height", "font_family", "font_size", F.posexplode(F.split(text, "")).alias("i", "ch")).where("ch <> ''")
    left = F.col("x") + F.col("i") * 5.5
    glyphs = chars.select(
        *L.PAGE, ((F.col("line_no").cast("long") * 100_000 + F.col("word_no")) * 100_000 + F.col("i")).alias("glyph_no"), "ch", left.alias("left"), (left + F.when(F.col("ch") == " ", 2.0).otherwise(5.5)).alias("right"), F.col("y").alias("bottom"), (F.col("y") + F.col("height")).alias("top"), F.col("font_family").alias("font_name"), "font_size"
    )
    found = O.per_page_columns(glyphs, O.glyph_run_columns, "run int, text string, x double, width double, n int", "glyph_no")
    return found.select(*L.PAGE, "run", F.md5("text").alias("text_md5"), "x", F.round("width", 6).alias("width"), "n")


def ctm_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as drawing operators."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    arr = lambda *v: F.array(*[x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in v]).cast("array<double>")
    ops = F.array(
        F.struct(F.lit("save").alias("fn"), F.array().cast("array<double>").alias("args")),
        F.struct(F.lit("transform").alias("fn"), arr(1, 0, 0, 1, 10, q).alias("args")),
        F.struct(F.lit("fill_color").alias("fn"), arr(q * 5, 20, 300).alias("args")),
        F.struct(F.when(n % 3 == 0, "rectangle").when(n % 3 == 1, "move").otherwise("curve").alias("fn"), F.when(n % 3 == 0, arr(5, 5, 100, 50)).when(n % 3 == 1, arr(q, 3)).otherwise(arr(1, 2, 3, 4, q, 6)).alias("args")),
        F.struct(F.lit("line").alias("fn"), arr(q + 1, 7.25).alias("args")),
        F.struct(F.when(n % 4 == 0, "eo_fill").when(n % 4 == 1, "stroke").when(n % 4 == 2, "fill_stroke").otherwise("end_path").alias("fn"), F.array().cast("array<double>").alias("args")),
        F.struct(F.when(n % 2 == 0, "restore").otherwise("close").alias("fn"), F.array().cast("array<double>").alias("args")),
    )
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    rows = items.withColumn("k", F.row_number().over(order).cast("long")).select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), "k", F.posexplode(ops).alias("i", "op"))
    rows = rows.select("doc_id", "page_no", (F.col("k") * 10 + F.col("i")).alias("op_no"), "op.fn", "op.args")
    return O.per_page(rows, O.drawn_paths(500.0), "path_no int, path string, stroke string, fill string, fill_rule string, line_width double")


def smart_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words cut in the middle and put together again with the dictionary of the corpus (all its frequent words)."""
    words = words_of(spark, sf_dir)
    dictionary = word_set(frequent_words(words_of(spark, sf_dir), least=200))
    half = F.floor(F.length("text") / 2).cast("int")
    parts = words.where(F.length("text") >= 2).select(*L.LINE, "word_no", "x", "width", F.length("text").alias("len"), F.posexplode(F.array(F.substr("text", F.lit(1), half), F.substr("text", half + 1))).alias("i", "text"))
    rows = parts.select(*L.LINE, (F.col("word_no") * 2 + F.col("i")).alias("item_no"), "text", F.when(F.col("i") == 0, F.col("x")).otherwise(F.col("x") + F.floor(F.col("len") / 2) * 5.5).alias("x"), (F.length("text") * 5.5).alias("width"))
    found = O.per_page(rows, O.by_line(O.smart_boundaries(dictionary)), "line_no int, item_no int, space boolean, phase string")
    return found.groupBy("doc_id", "page_no", "phase", "space").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (line_grouping, anchored_lines, row_clusters, run_merge, fragment_merge, style_clusters, spatial_groups, block_merge, notes_rewrite, paragraph_chase, line_separation, style_paragraphs, glyph_runs, ctm_paths, smart_boundary)}
#: Items of ``_strewn``; then the different heights of each page, ``k`` in the order of first items or from the top.
_STREWN = """,
st AS (
  SELECT doc_id, page_no, CAST(line_no AS BIGINT) * 100000 + word_no AS item_no,
    y + CASE (line_no + word_no) % 5 WHEN 1 THEN 0.5 WHEN 3 THEN -0.5 ELSE 0.0 END + (line_no * 5 + word_no * 3) % 11 * 1.25 - 6.0 AS y FROM words),
hs AS (SELECT doc_id, page_no, {height} AS h, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY {order}) AS k FROM st GROUP BY doc_id, page_no, {height})
"""
#: Blocks of ``_blocks``.
_BLOCKS = (
    _REGIONS
    + """,
p1 AS (SELECT *, top - lag(top + height) OVER w AS gap, abs(min_x - lag(min_x) OVER w) AS shift FROM l2 WINDOW w AS (PARTITION BY doc_id, page_no, region_no ORDER BY top, min_x, line_no)),
p2 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > greatest(4.0, mh * 0.8) OR (shift > greatest(10.0, mh * 1.2) AND gap > greatest(1.0, mh * 0.15)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, region_no ORDER BY top, min_x, line_no) - 1 AS paragraph_no FROM p1),
p3 AS (
  SELECT doc_id, page_no, CAST(region_no * 1000 + paragraph_no AS INTEGER) AS block_no, min(top) AS top, max(top + height) AS bottom, min(min_x) AS indent, min(font_size) AS font_size, min_by(text, line_no) AS text
  FROM p2 GROUP BY doc_id, page_no, region_no, paragraph_no),
bk AS (
  SELECT * REPLACE (CASE WHEN block_no % 7 = 2 THEN 'IMPORTANT NOTES' ELSE text END AS text), CASE WHEN block_no % 5 = 1 THEN 'list' WHEN block_no % 11 = 3 THEN 'heading' ELSE 'paragraph' END AS kind,
    CASE WHEN block_no % 2 = 0 THEN 'ul' ELSE 'ol' END AS list_kind FROM p3)
"""
)


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


ORACLES: dict[str, str] = {
    # a step takes the next item of the list that its row carries
    "run_merge": _recursive(WORDS_SQL)
    + """,
it AS (
  SELECT doc_id, page_no, line_no, list({'t': text, 'x': x, 'w': width, 'c': color} ORDER BY x, CAST(line_no AS BIGINT) * 100000 + word_no) AS items, any_value(font_size) AS size FROM words GROUP BY doc_id, page_no, line_no),
rm AS (
  SELECT doc_id, page_no, line_no, items, size, 1 AS k, 0 AS run, items[1].t AS t, items[1].x AS x, items[1].w AS w, items[1].c AS c, CAST(1 AS BIGINT) AS n FROM it
  UNION ALL
  SELECT doc_id, page_no, line_no, items, size, k + 1, CASE WHEN joins THEN run ELSE run + 1 END, CASE WHEN joins THEN t || CASE WHEN i.x - (last.x + last.w) > 0.25 * size THEN ' ' ELSE '' END || i.t ELSE i.t END,
    CASE WHEN joins THEN x ELSE i.x END, CASE WHEN joins THEN greatest(0.0, greatest(x + w, i.x + i.w) - x) ELSE i.w END, CASE WHEN joins THEN c ELSE i.c END, CASE WHEN joins THEN n + 1 ELSE 1 END
  FROM (
    SELECT *, CASE WHEN length(trim(i.t)) <= 3 OR length(trim(t)) <= 5 THEN i.x - (x + w) < 2 * size ELSE c = i.c AND i.x - (x + w) < 10.0 END AS joins
    FROM (SELECT *, items[k + 1] AS i, items[k] AS last FROM rm WHERE k < len(items))))
SELECT doc_id, page_no, line_no, CAST(run AS INTEGER) AS run, md5(arg_max(t, k)) AS text_md5, any_value(x) AS x, arg_max(w, k) AS width, CAST(max(n) AS INTEGER) AS n FROM rm GROUP BY doc_id, page_no, line_no, run
""",
    # lines are too far apart to share a run, and rights only grow along a line, so the glyph before tells all of a run's state
    "glyph_runs": WORDS_SQL
    + """,
w AS (SELECT *, CASE WHEN word_no % 3 = 0 THEN text || ' ' ELSE text END AS said FROM words),
c AS (SELECT doc_id, page_no, line_no, word_no, x, font_size, unnest(string_split(said, '')) AS ch, unnest(range(len(string_split(said, '')))) AS i FROM w),
g AS (SELECT *, x + i * 5.5 AS l, x + i * 5.5 + CASE WHEN ch = ' ' THEN 2.0 ELSE 5.5 END AS r, regexp_matches(ch, '^\\s$') AS blank FROM c),
b AS (SELECT *, l - lag(r) OVER o AS gap, lag(blank) OVER o AS spaced, greatest(1.0, font_size) AS size FROM g WINDOW o AS (PARTITION BY doc_id, page_no, line_no ORDER BY word_no, i)),
f AS (SELECT *, CASE WHEN gap IS NULL OR gap < -size OR gap > 1.6 * size THEN 1 ELSE 0 END AS starts FROM b),
n AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, page_no ORDER BY line_no, word_no, i ROWS UNBOUNDED PRECEDING) - 1 AS run FROM f),
p AS (
  SELECT *, CASE WHEN starts = 1 THEN ch WHEN blank THEN CASE WHEN spaced OR r - l < 0.08 * size THEN '' ELSE ' ' END
    WHEN gap >= size / 3 AND NOT spaced AND NOT regexp_matches(ch, '^[,.;:!?)\\]}]') THEN ' ' || ch ELSE ch END AS piece FROM n)
SELECT doc_id, page_no, CAST(run AS INTEGER) AS run, md5(rtrim(string_agg(piece, '' ORDER BY line_no, word_no, i))) AS text_md5, min(l) AS x, round(max(r) - min(l), 6) AS width, CAST(count(*) AS INTEGER) AS n
FROM p GROUP BY doc_id, page_no, run
""",
    # each line item saves the state; one of an even number restores it, one of an odd number keeps its shift and leaves a closing mark
    "ctm_paths": """
WITH i AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS q, row_number() OVER o AS k, lag(l_linenumber % 2) OVER o AS odd,
    coalesce(sum(CASE WHEN l_linenumber % 2 = 1 THEN 10.0 END) OVER b, 0.0) + 10.0 AS e, coalesce(sum(CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS DOUBLE) END) OVER b, 0.0) + CAST(l_quantity AS DOUBLE) AS f
  FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice), b AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (
  SELECT *, CASE n % 3 WHEN 0 THEN [('M', 5.0, 5.0), ('L', 105.0, 5.0), ('L', 105.0, 55.0), ('L', 5.0, 55.0), ('Z', NULL, NULL)] WHEN 1 THEN [('M', q, 3.0)] ELSE [('C', 1.0, 2.0), (',', 3.0, 4.0), (',', q, 6.0)] END
    || [('L', q + 1.0, 7.25)] AS steps FROM i),
u AS (SELECT doc_id, k, unnest(steps) AS s, unnest(range(len(steps))) AS j, e, f FROM p),
v AS (SELECT doc_id, k, j, s[1] AS fn, floor((s[2] + e) * 1000 + 0.5) / 1000 AS x, floor((500.0 - (s[3] + f)) * 1000 + 0.5) / 1000 AS y FROM u),
t AS (
  SELECT doc_id, k, string_agg(CASE fn WHEN ',' THEN ', ' WHEN 'Z' THEN ' Z' ELSE ' ' || fn || ' ' END || CASE WHEN fn = 'Z' THEN '' ELSE
    CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END || ' ' || CASE WHEN y = floor(y) THEN CAST(CAST(y AS BIGINT) AS VARCHAR) ELSE CAST(y AS VARCHAR) END END, '' ORDER BY j) AS path FROM v GROUP BY doc_id, k)
SELECT p.doc_id, 0 AS page_no, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY p.k) - 1 AS INTEGER) AS path_no, CASE WHEN odd = 1 THEN 'Z' || path ELSE substr(path, 2) END AS path,
  CASE WHEN n % 4 IN (1, 2) THEN '#000000' END AS stroke, CASE WHEN n % 4 IN (0, 2) THEN printf('#%02x14ff', CAST(least(255, floor(q * 5 + 0.5)) AS INTEGER)) END AS fill, CASE WHEN n % 4 = 0 THEN 'evenodd' ELSE 'nonzero' END AS fill_rule,
  CASE WHEN n % 4 IN (1, 2) THEN 1.0::DOUBLE END AS line_width
FROM p JOIN t ON p.doc_id = t.doc_id AND p.k = t.k WHERE n % 4 <> 3
""",
    "fragment_merge": _recursive(WORDS_SQL)
    + """,
yi AS (
  SELECT *, CAST(line_no AS BIGINT) * 100000 + word_no AS item_no, y + CASE (line_no + word_no) % 5 WHEN 1 THEN 0.5 WHEN 3 THEN -0.5 ELSE 0.0 END AS yy, regexp_replace(lower(font_family), '[^a-z0-9]', '', 'g') AS plain FROM words),
-- no fragment spans a step of more than 2 between neighbouring heights
gp AS (SELECT *, CASE WHEN lag(yy) OVER w - yy <= 2 THEN 0 ELSE 1 END AS far FROM yi WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY yy DESC, x, item_no)),
il AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, page_no ORDER BY yy DESC, x, item_no ROWS UNBOUNDED PRECEDING) AS island FROM gp),
it AS (SELECT doc_id, page_no, island, list({'t': text, 'x': x, 'y': yy, 'w': width, 's': font_size, 'f': plain} ORDER BY yy DESC, x, item_no) AS items FROM il GROUP BY doc_id, page_no, island),
fm AS (
  SELECT doc_id, page_no, island, items, 1 AS k, 0 AS run, items[1].t AS t, items[1].x AS x, items[1].y AS y, items[1].w AS w, items[1].s AS s, items[1].f AS f, 1 AS n FROM it
  UNION ALL
  SELECT doc_id, page_no, island, items, k + 1, CASE WHEN joins THEN run ELSE run + 1 END,
    CASE WHEN joins THEN t || CASE WHEN t <> '' AND i.t <> '' AND NOT regexp_matches(t, '\\s$') AND NOT regexp_matches(i.t, '^\\s') AND NOT regexp_matches(i.t, '^[,.;:!?)\\]}]') AND NOT regexp_matches(t, '[(\\[{]$') AND gap > 0.15 * i.s THEN ' ' ELSE '' END || i.t ELSE i.t END,
    CASE WHEN joins THEN x ELSE i.x END, CASE WHEN joins THEN y ELSE i.y END, CASE WHEN joins THEN greatest(w, i.x + i.w - x) ELSE i.w END, CASE WHEN joins THEN s ELSE i.s END, CASE WHEN joins THEN f ELSE i.f END, CASE WHEN joins THEN n + 1 ELSE 1 END
  FROM (
    SELECT *, i.x - (x + w) AS gap, abs(y - i.y) <= 2 AND f = i.f AND abs(s - i.s) <= 1 AND i.x - (x + w) >= -i.s AND i.x - (x + w) <= 0.5 * i.s AS joins
    FROM (SELECT *, items[k + 1] AS i FROM fm WHERE k < len(items)))),
fr AS (SELECT doc_id, page_no, island, run, arg_max(t, k) AS t, any_value(x) AS x, any_value(y) AS y, arg_max(w, k) AS w, CAST(max(n) AS INTEGER) AS n FROM fm GROUP BY doc_id, page_no, island, run)
SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY island, run) - 1 AS INTEGER) AS item, md5(t) AS text_md5, x, y, w AS width, n FROM fr
""",
    "anchored_lines": _recursive(WORDS_SQL)
    + _STREWN.format(height="CAST(floor(y + 0.5) AS BIGINT)", order="min(item_no)")
    + """,
an AS (
  SELECT doc_id, page_no, h, k, [h] AS anchors, CAST(0 AS BIGINT) AS line FROM hs WHERE k = 1
  UNION ALL
  SELECT doc_id, page_no, h, k, CASE WHEN near IS NULL THEN list_append(anchors, h) ELSE anchors END, coalesce(near, len(anchors)) FROM (
    SELECT hs.doc_id, hs.page_no, hs.h, hs.k, anchors, list_position(list_transform(anchors, lambda a: abs(a - hs.h) < 3), true) - 1 AS near
    FROM an JOIN hs ON an.doc_id = hs.doc_id AND an.page_no = hs.page_no AND hs.k = an.k + 1))
SELECT st.doc_id, st.page_no, line, count(*) AS n_items, min(item_no) AS first_item
FROM st JOIN an ON st.doc_id = an.doc_id AND st.page_no = an.page_no AND CAST(floor(st.y + 0.5) AS BIGINT) = an.h GROUP BY st.doc_id, st.page_no, line
""",
    "row_clusters": _recursive(WORDS_SQL)
    + _STREWN.format(height="y", order="y DESC")
    + """,
rc AS (
  SELECT doc_id, page_no, h, k, h AS anchor, CAST(0 AS BIGINT) AS row FROM hs WHERE k = 1
  UNION ALL
  SELECT hs.doc_id, hs.page_no, hs.h, hs.k, CASE WHEN abs(hs.h - anchor) > 8.0 THEN hs.h ELSE anchor END, row + CASE WHEN abs(hs.h - anchor) > 8.0 THEN 1 ELSE 0 END
  FROM rc JOIN hs ON rc.doc_id = hs.doc_id AND rc.page_no = hs.page_no AND hs.k = rc.k + 1)
SELECT st.doc_id, st.page_no, row, count(*) AS n_items, min(item_no) AS first_item
FROM st JOIN rc ON st.doc_id = rc.doc_id AND st.page_no = rc.page_no AND st.y = rc.h GROUP BY st.doc_id, st.page_no, row
""",
    "block_merge": _recursive(_BLOCKS)
    + """,
ob AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY top, block_no) AS k FROM bk),
mb AS (
  SELECT doc_id, page_no, block_no, k, kind, list_kind, bottom, indent, font_size, CAST(0 AS INTEGER) AS merged FROM ob WHERE k = 1
  UNION ALL
  SELECT doc_id, page_no, block_no, k, CASE WHEN joins THEN okind ELSE kind END, CASE WHEN joins THEN olist ELSE list_kind END, CASE WHEN joins THEN greatest(obottom, bottom) ELSE bottom END,
    CASE WHEN joins THEN oindent ELSE indent END, CASE WHEN joins THEN osize ELSE font_size END, merged + CASE WHEN joins THEN 0 ELSE 1 END
  FROM (
    SELECT ob.*, mb.merged, mb.kind AS okind, mb.list_kind AS olist, mb.bottom AS obottom, mb.indent AS oindent, mb.font_size AS osize,
      ob.top - mb.bottom <= 9.0 AND abs(mb.indent - ob.indent) <= 8.0 AND mb.kind = ob.kind
        AND ((ob.kind = 'list' AND mb.list_kind = ob.list_kind) OR (ob.kind = 'paragraph' AND abs(mb.font_size - ob.font_size) <= {alike})) AS joins
    FROM mb JOIN ob ON mb.doc_id = ob.doc_id AND mb.page_no = ob.page_no AND ob.k = mb.k + 1))
SELECT doc_id, page_no, merged, count(*) AS n_blocks, min(block_no) AS first_block FROM mb GROUP BY doc_id, page_no, merged
""".replace("{alike}", "greatest(1.5, 1.8)"),
    "notes_rewrite": _BLOCKS
    + """,
n1 AS (SELECT *, regexp_matches(text, '(?i)important notes') AS note FROM bk),
n2 AS (SELECT *, sum(CASE WHEN note THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY block_no) AS part FROM n1),
n3 AS (SELECT *, first_value(indent) OVER (PARTITION BY doc_id, page_no, part ORDER BY block_no) AS edge FROM n2),
n4 AS (SELECT *, part > 0 AND (note OR (min(CASE WHEN note OR (kind = 'paragraph' AND abs(indent - edge) <= 30.0) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, part ORDER BY block_no) = 1)) AS held FROM n3),
tk AS (SELECT doc_id, page_no, part, min(block_no) AS block_no, trim(string_agg(trim(text), ' ' ORDER BY block_no)) AS t FROM n4 WHERE held AND NOT note GROUP BY doc_id, page_no, part),
cu AS (
  SELECT *, list_filter(range(2, length(t)), lambda e: substr(t, e, 1) = ' ' AND substr(t, e - 1, 1) IN ('.', '!', '?') AND regexp_matches(substr(t, e + 1, 1), '[A-Z]')) AS ends FROM tk WHERE t <> ''),
ct AS (SELECT *, CASE WHEN len(ends) = 0 THEN length(t) // 2 ELSE list_extract(list_sort(list_transform(ends, lambda e: {'d': abs(e - length(t) / 2.0), 'e': e})), 1).e END AS cut FROM cu),
al AS (
  SELECT doc_id, page_no, block_no, CASE WHEN note THEN 'heading' ELSE kind END AS kind, text FROM n4 WHERE note OR NOT held
  UNION ALL
  SELECT doc_id, page_no, block_no, 'list', array_to_string(list_filter([trim(substr(t, 1, cut)), trim(substr(t, cut + 1))], lambda x: x <> ''), chr(10)) FROM ct)
SELECT doc_id, page_no, block_no, kind, md5(text) AS text_md5 FROM al
""",
    "paragraph_chase": _recursive(LINES_SQL)
    + """,
pl AS (SELECT doc_id, page_no, line_no, 792.0 - top AS y FROM lines),
nx AS (
  SELECT a.doc_id, a.page_no, a.line_no, arg_min(b.line_no, {'y': -b.y, 'n': b.line_no}) AS after
  FROM pl a JOIN pl b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND abs(b.y - (a.y - 12.0)) < 4.0 GROUP BY a.doc_id, a.page_no, a.line_no),
ch AS (
  SELECT doc_id, page_no, line_no, line_no AS pos, 1 AS length FROM pl
  UNION ALL
  SELECT ch.doc_id, ch.page_no, ch.line_no, nx.after, length + 1 FROM ch JOIN nx ON ch.doc_id = nx.doc_id AND ch.page_no = nx.page_no AND ch.pos = nx.line_no)
SELECT doc_id, page_no, line_no, max(length) AS length FROM ch GROUP BY doc_id, page_no, line_no
""",
    "style_paragraphs": _recursive(LINES_SQL)
    + """,
sl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY top, line_no) AS k FROM lines),
sp AS (
  SELECT doc_id, page_no, line_no, k, min_x, font_size, top + height AS bottom, CAST(0 AS INTEGER) AS grp FROM sl WHERE k = 1
  UNION ALL
  SELECT doc_id, page_no, line_no, k, CASE WHEN same THEN ox ELSE min_x END, CASE WHEN same THEN os ELSE font_size END, top + height, grp + CASE WHEN same THEN 0 ELSE 1 END
  FROM (
    SELECT sl.*, sp.grp, sp.min_x AS ox, sp.font_size AS os, sl.font_size = sp.font_size AND abs(sl.min_x - sp.min_x) <= 1.5 AND sl.top - sp.bottom <= 0.6 * sl.height AS same
    FROM sp JOIN sl ON sp.doc_id = sl.doc_id AND sp.page_no = sl.page_no AND sl.k = sp.k + 1))
SELECT doc_id, page_no, grp AS "group", count(*) AS n_lines, min(line_no) AS first_line FROM sp GROUP BY doc_id, page_no, grp
""",
    "line_separation": LINES_SQL
    + """,
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY top, line_no) AS r, height * 1.25 AS h FROM lines),
s AS (SELECT *, coalesce(sum(h + 1.0) OVER (PARTITION BY doc_id, page_no ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM o)
SELECT doc_id, page_no, line_no, max(top - before) OVER (PARTITION BY doc_id, page_no ORDER BY r) + before AS top FROM s
""",
}
