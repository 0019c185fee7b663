"""Spatial queries: typeset pages with images, rules and graphics placed by document and page number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import layout as L
from ..operators import spatial as S
from ..schema import PAGE_HEIGHT, PAGE_WIDTH
from ..sources.typesetter import WORDS_SQL
from .layout import _REGIONS, lines_and_words, words_of


def _marks(words: DataFrame) -> dict[str, DataFrame]:
    pages = words.select("doc_id", "page_no").distinct()
    d = F.col("doc_id")
    at = lambda df, x, y, w, h: df.select("doc_id", "page_no", x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    return {
        "images": at(pages.where("doc_id % 3 = 0"), d % 200, 300 + d % 300, 120.0, 60.0),
        "graphics": at(pages.where("doc_id % 2 = 0"), 50 + d % 100, 100 + d % 500, 30.0, 4.0).unionByName(at(pages, d % 50, 20 + d % 700, 200.0, 1.0)),
        "annotations": at(pages.where("doc_id % 5 = 1"), 30 + d % 90, 650 - d % 400, 25.0, 10.0),
        "forms": at(pages.where("doc_id % 11 = 4"), d % 300, d % 600, 80.0, 14.0),
    }


def _region_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, words = lines_and_words(spark, sf_dir)
    return L.regions(L.with_regions(lines, L.page_sizes(words))), words


def obstacle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, words = _region_rows(spark, sf_dir)
    found = S.obstacles(**_marks(words), page_height=PAGE_HEIGHT)
    out = S.region_obstacles(regions, found)
    return out.select("doc_id", "page_no", "region_no", "hard_area", "soft_area", F.when(F.col("nearest") < 1e9, F.round("nearest", 6)).alias("nearest"), "overlaps")


def region_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which regions flow and which are placed: obstacles, borders, structured lines."""
    regions, words = _region_rows(spark, sf_dir)
    marks = _marks(words)
    over = S.region_obstacles(regions, S.obstacles(**marks, page_height=PAGE_HEIGHT)).select(*L.PAGE, "region_no", "overlaps")
    borders = S.border_counts(regions, marks["graphics"])
    lines, _ = lines_and_words(spark, sf_dir)
    placed = L.with_regions(lines, L.page_sizes(words)).select(*L.LINE, "region_no")
    flags = S.structured_lines(words, words.groupBy(*L.PAGE).agg(F.lit(PAGE_WIDTH / 4).alias("region_width")))
    structured = placed.join(flags, L.LINE).groupBy(*L.PAGE, "region_no").agg(F.bool_or("structured").alias("structured"))
    key = [*L.PAGE, "region_no"]
    return S.layout_decision(over.join(borders, key).join(structured, key))


def _rules(words: DataFrame) -> DataFrame:
    """A rule under each line: short ones under its first word, some that run on far beyond, some too thick."""
    w = words.where("word_no = 0")
    n = F.col("line_no") + F.col("word_no")
    return w.select(
        "doc_id", "page_no", (F.col("line_no").cast("long") * 100_000 + F.col("word_no")).alias("seq"), (F.col("x") - 1).alias("x"), (PAGE_HEIGHT - F.col("y") + F.when(n % 3 == 0, 9.0).otherwise(1.0)).alias("y"),
        (F.col("width") + F.when(n % 5 == 0, 320.0).when(n % 5 == 1, 30.0).otherwise(2.0)).alias("width"), F.when(n % 7 == 0, 8.0).otherwise(0.5).alias("height"), F.lit(0.5).alias("stroke_width"),
    )


def underline_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir)
    used, _ = S.underlines(words, _rules(words), PAGE_WIDTH, PAGE_HEIGHT)
    return used


def underlined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir)
    marked, left = S.with_underlines(words, _rules(words), PAGE_WIDTH, PAGE_HEIGHT)
    a = marked.groupBy("doc_id", "page_no").agg(F.count_if(F.col("text_decoration") == "underline").alias("underlined"))
    b = left.groupBy("doc_id", "page_no").agg(F.count("*").alias("rules_left"))
    return a.join(b, ["doc_id", "page_no"], "left").na.fill({"rules_left": 0})


def _items(words: DataFrame) -> DataFrame:
    n = F.col("line_no") + F.col("word_no")
    return words.select("doc_id", "page_no", (F.col("line_no").cast("long") * 100_000 + F.col("word_no")).alias("item_no"), "text", (F.col("x") - F.when(n % 6 == 0, 8.0).otherwise(0.0)).alias("x"), "y", "width", "height", "font_family")


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.overlaps(_items(words_of(spark, sf_dir)))
    return found.select("doc_id", "page_no", "first", "second", F.round("ratio", 9).alias("ratio"))


def style_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each line is a sample for the words around."""
    items = _items(words_of(spark, sf_dir))
    samples = _items(words_of(spark, sf_dir).where("word_no = 0")).select("doc_id", "page_no", F.col("item_no").alias("sample_no"), F.col("font_family").alias("style"), "text", "x", "y", "width", "height")
    found = S.style_matches(items, samples)
    return found.select("doc_id", "page_no", "item_no", "sample_no", "style", F.round("score", 9).alias("score"))


def lone_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.alone_on_line(_items(words_of(spark, sf_dir)).withColumn("y", F.col("y") + (F.col("item_no") * 7 % 31) * 0.375))


def path_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as paths: bounds from the numbers, placement of a matrix, colours, widths by character class."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    path = F.concat(F.lit("M "), (k % 97).cast("string"), F.lit(" "), (k % 89).cast("string"), F.lit(" L -"), (k % 13).cast("string"), F.lit(".5 1"), (k % 7).cast("string"), F.lit(" C 3,4 5.25,6 "), (k % 53).cast("string"), F.lit(" Z"))
    b = G.path_bounds(path)
    m = F.array((k % 5).cast("double"), (k % 3).cast("double"), F.lit(0.0), (k % 4).cast("double"), (k % 50).cast("double"), (k % 60).cast("double"))
    moved = G.transform_point(G.multiply(m, F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 2.0, 3.0, 4.0)])), F.lit(2.0), F.lit(5.0))
    p = G.placement(m)
    return o.select(
        k.alias("id"), b["min_x"].alias("min_x"), b["min_y"].alias("min_y"), b["max_x"].alias("max_x"), b["max_y"].alias("max_y"), moved["x"].alias("mx"), moved["y"].alias("my"), F.round(p["width"], 9).alias("pw"), F.round(p["height"], 9).alias("ph"),
        G.hex_color(k % 300 - 20, k % 256, F.lit(7)).alias("color"), F.round(G.estimated_width(F.concat(F.col("o_orderpriority"), F.lit("|é")), F.lit(10.0)), 6).alias("width"), G.snapped_rotation((k % 200 - 100).cast("double")).alias("turn"),
    )


QUERIES = {f.__name__: f for f in (obstacle_overlap, region_layout, underline_match, underlined_words, overlap_pairs, style_transfer, lone_items, path_boxes)}

_OBSTACLES = (
    _REGIONS
    + """,
rg AS (SELECT doc_id, page_no, region_no, any_value(mh) AS mh, min(min_x) AS x0, max(max_x) AS x1, min(top) AS y0, max(top + height) AS y1 FROM l2 GROUP BY doc_id, page_no, region_no),
pg AS (SELECT DISTINCT doc_id, page_no FROM words),
gr AS (
  SELECT doc_id, page_no, 50.0 + doc_id % 100 AS x, 100.0 + doc_id % 500 AS y, 30.0 AS w, 4.0 AS h FROM pg WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, page_no, doc_id % 50, 20.0 + doc_id % 700, 200.0, 1.0 FROM pg),
sd AS (
  SELECT doc_id, page_no, CAST(doc_id % 200 AS DOUBLE) AS x, 300.0 + doc_id % 300 AS y, 120.0 AS w, 60.0 AS h FROM pg WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, page_no, 30.0 + doc_id % 90, 650.0 - doc_id % 400, 25.0, 10.0 FROM pg WHERE doc_id % 5 = 1
  UNION ALL SELECT doc_id, page_no, doc_id % 300, doc_id % 600, 80.0, 14.0 FROM pg WHERE doc_id % 11 = 4),
ob AS (SELECT *, 'hard' AS kind FROM sd UNION ALL SELECT *, 'soft' FROM sd UNION ALL SELECT *, 'soft' FROM gr WHERE least(w, h) > 1.25),
mt AS (
  SELECT rg.*, kind, ob.x, ob.w, 792.0 - (ob.y + ob.h) AS t, ob.h FROM rg LEFT JOIN ob ON rg.doc_id = ob.doc_id AND rg.page_no = ob.page_no),
ar AS (
  SELECT *, CASE WHEN kind IS NULL THEN 0.0 ELSE greatest(0.0, least(x1, x + w) - greatest(x0, x)) * greatest(0.0, least(y1, t + h) - greatest(y0, t)) END AS area,
    CASE WHEN kind = 'soft' THEN sqrt(power(greatest(x - x1, x0 - (x + w), 0.0), 2) + power(greatest(t - y1, y0 - (t + h), 0.0), 2)) END AS dist FROM mt),
ov AS (
  SELECT doc_id, page_no, region_no, max(CASE WHEN kind = 'hard' THEN area ELSE 0.0 END) AS hard_area, sum(CASE WHEN kind = 'soft' THEN area ELSE 0.0 END) AS soft_area, min(dist) AS nearest, any_value(mh) AS mh FROM ar GROUP BY doc_id, page_no, region_no)
"""
)
_RULES = """,
ru AS (
  SELECT doc_id, page_no, CAST(line_no AS BIGINT) * 100000 + word_no AS seq, x - 1 AS r0, 792.0 - y + CASE WHEN (line_no + word_no) % 3 = 0 THEN 9.0 ELSE 1.0 END AS y,
    width + CASE (line_no + word_no) % 5 WHEN 0 THEN 320.0 WHEN 1 THEN 30.0 ELSE 2.0 END AS rw, CASE WHEN (line_no + word_no) % 7 = 0 THEN 8.0 ELSE 0.5 END AS h FROM words WHERE word_no = 0),
rk AS (SELECT *, r0 + rw AS r1, y + h / 2 AS ry FROM ru WHERE rw >= 2.0 AND greatest(h, 0.5) <= 6.5 AND rw / greatest(0.35, greatest(h, 0.5)) >= 8),
mt AS (
  SELECT rk.doc_id, rk.page_no, seq, rw, line_no, word_no, x AS t0, x + width AS t1, greatest(r0, x) AS s0, least(r1, x + width) AS s1
  FROM rk JOIN words ON rk.doc_id = words.doc_id AND rk.page_no = words.page_no AND r0 < x + width AND x < r1
  WHERE (least(r1, x + width) - greatest(r0, x)) / greatest(1.0, least(rw, greatest(1.0, width))) >= 0.2 AND ry - (792.0 - words.y) >= -greatest(0.8, height * 0.12) AND ry - (792.0 - words.y) <= greatest(1.5, height * 0.65)),
un AS (
  SELECT doc_id, page_no, seq, sum(greatest(0.0, s1 - greatest(s0, coalesce(reach, s0)))) AS covered FROM (
    SELECT *, max(s1) OVER (PARTITION BY doc_id, page_no, seq ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mt) GROUP BY doc_id, page_no, seq),
sp AS (SELECT doc_id, page_no, seq, rw, greatest(1.0, max(t1) - min(t0)) AS span, count(*) AS n_words FROM mt GROUP BY doc_id, page_no, seq, rw),
us AS (
  SELECT sp.doc_id, sp.page_no, sp.seq, n_words, covered FROM sp JOIN un ON sp.doc_id = un.doc_id AND sp.page_no = un.page_no AND sp.seq = un.seq
  WHERE NOT (rw >= 612.0 * 0.25 AND rw / span >= 1.8) AND NOT (rw >= 612.0 * 0.45 AND covered / greatest(1.0, rw) < 0.5 AND covered / span < 0.65))
"""
_ITEMS = """,
it AS (SELECT doc_id, page_no, word_no, CAST(line_no AS BIGINT) * 100000 + word_no AS item_no, text, x - CASE WHEN (line_no + word_no) % 6 = 0 THEN 8.0 ELSE 0.0 END AS x, y, width, height, font_family FROM words)
"""
ORACLES = {
    "obstacle_overlap": _OBSTACLES
    + "SELECT doc_id, page_no, region_no, hard_area, soft_area, round(nearest, 6) AS nearest, hard_area > 0 OR soft_area > greatest(2.0, mh * mh * 0.2) AS overlaps FROM ov",
    "region_layout": _OBSTACLES
    + """,
bd AS (
  SELECT rg.doc_id, rg.page_no, rg.region_no, count(CASE WHEN gr.x <= x1 AND gr.x + gr.w >= x0 AND gr.y <= y1 AND gr.y + gr.h >= y0 THEN 1 END) AS borders
  FROM rg LEFT JOIN gr ON rg.doc_id = gr.doc_id AND rg.page_no = gr.page_no AND least(gr.w, gr.h) <= 2 AND greatest(gr.w, gr.h) >= 10 GROUP BY rg.doc_id, rg.page_no, rg.region_no),
gp AS (SELECT doc_id, page_no, line_no, font_size, lead(x) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY x, word_no) - (x + width) AS gap FROM words),
st AS (SELECT doc_id, page_no, line_no, coalesce(bool_or(gap >= greatest(22.0, font_size * 2.6, 153.0 * 0.08)), false) AS structured FROM gp GROUP BY doc_id, page_no, line_no),
sr AS (SELECT l2.doc_id, l2.page_no, region_no, bool_or(structured) AS structured FROM l2 JOIN st ON l2.doc_id = st.doc_id AND l2.line_no = st.line_no GROUP BY l2.doc_id, l2.page_no, region_no)
SELECT ov.doc_id, ov.page_no, ov.region_no, hard_area > 0 OR soft_area > greatest(2.0, mh * mh * 0.2) AS overlaps, borders, structured, (hard_area > 0 OR soft_area > greatest(2.0, mh * mh * 0.2)) OR borders >= 2 OR structured AS absolute
FROM ov JOIN bd ON ov.doc_id = bd.doc_id AND ov.page_no = bd.page_no AND ov.region_no = bd.region_no JOIN sr ON ov.doc_id = sr.doc_id AND ov.page_no = sr.page_no AND ov.region_no = sr.region_no
""",
    "underline_match": WORDS_SQL + _RULES + "SELECT * FROM us",
    "underlined_words": WORDS_SQL
    + _RULES
    + """,
mk AS (SELECT mt.doc_id, mt.page_no, count(DISTINCT CAST(line_no AS BIGINT) * 100000 + word_no) AS underlined FROM mt JOIN us ON mt.doc_id = us.doc_id AND mt.page_no = us.page_no AND mt.seq = us.seq GROUP BY mt.doc_id, mt.page_no),
lf AS (SELECT ru.doc_id, ru.page_no, count(CASE WHEN us.seq IS NULL THEN 1 END) AS rules_left FROM ru LEFT JOIN us ON ru.doc_id = us.doc_id AND ru.page_no = us.page_no AND ru.seq = us.seq GROUP BY ru.doc_id, ru.page_no),
pg AS (SELECT DISTINCT doc_id, page_no FROM words)
SELECT pg.doc_id, pg.page_no, coalesce(underlined, 0) AS underlined, coalesce(rules_left, 0) AS rules_left FROM pg LEFT JOIN mk ON pg.doc_id = mk.doc_id AND pg.page_no = mk.page_no LEFT JOIN lf ON pg.doc_id = lf.doc_id AND pg.page_no = lf.page_no
""",
    "overlap_pairs": WORDS_SQL
    + _ITEMS
    + """,
bn AS (SELECT *, unnest(range(CAST(floor(y / 50) AS BIGINT), CAST(floor((y + height) / 50) AS BIGINT) + 1)) AS band FROM it),
cl AS (SELECT *, unnest(range(CAST(floor(x / 50) AS BIGINT), CAST(floor((x + width) / 50) AS BIGINT) + 1)) AS cell FROM bn),
pr AS (
  SELECT DISTINCT a.doc_id, a.page_no, a.item_no AS first, b.item_no AS second,
    greatest(0.0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) / least(a.width * a.height, b.width * b.height) AS ratio
  FROM cl a JOIN cl b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.band = b.band AND a.cell = b.cell AND a.item_no < b.item_no AND a.y + a.height > b.y AND b.y + b.height > a.y AND a.x + a.width > b.x AND b.x + b.width > a.x)
SELECT doc_id, page_no, first, second, round(ratio, 9) AS ratio FROM pr WHERE ratio >= 0.1
""",
    "style_transfer": WORDS_SQL
    + _ITEMS
    + """,
sc AS (
  SELECT a.doc_id, a.page_no, a.item_no, b.item_no AS sample_no, b.font_family AS style,
    greatest(0.0, 1 - sqrt(power(a.x + a.width / 2 - (b.x + b.width / 2), 2) + power(a.y + a.height / 2 - (b.y + b.height / 2), 2)) / 50.0) * 0.8 + CAST(least(length(a.text), length(b.text)) AS DOUBLE) / greatest(length(a.text), length(b.text), 1) * 0.2 AS score
  FROM it a JOIN it b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND b.word_no = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, item_no ORDER BY score DESC, sample_no) AS r FROM sc WHERE score > 0.5)
SELECT doc_id, page_no, item_no, sample_no, style, round(score, 9) AS score FROM rk WHERE r = 1
""",
    "lone_items": WORDS_SQL
    + _ITEMS
    + """,
i2 AS (SELECT * REPLACE (y + (item_no * 7 % 31) * 0.375 AS y) FROM it),
ys AS (SELECT doc_id, page_no, y, count(*) AS n, lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY y) AS below, lead(y) OVER (PARTITION BY doc_id, page_no ORDER BY y) AS above FROM i2 GROUP BY doc_id, page_no, y)
SELECT i2.doc_id, i2.page_no, item_no FROM i2 JOIN ys ON i2.doc_id = ys.doc_id AND i2.page_no = ys.page_no AND i2.y = ys.y
WHERE n = 1 AND NOT coalesce(i2.y - below < height * 0.5, false) AND NOT coalesce(above - i2.y < height * 0.5, false)
""",
    "path_boxes": """
WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS pr, CAST(o_orderkey % 97 AS DOUBLE) AS x1, CAST(o_orderkey % 89 AS DOUBLE) AS y1, -(o_orderkey % 13 + 0.5) AS x2, 10.0 + o_orderkey % 7 AS y2, CAST(o_orderkey % 53 AS DOUBLE) AS last FROM orders),
m AS (SELECT *, CAST(k % 5 AS DOUBLE) AS a, CAST(k % 3 AS DOUBLE) AS b, CAST(k % 4 AS DOUBLE) AS d, CAST(k % 50 AS DOUBLE) AS e, CAST(k % 60 AS DOUBLE) AS f, pr || '|é' AS t FROM o)
SELECT k AS id, CAST(least(x1, x2, 3.0, 5.25) AS DOUBLE) AS min_x, CAST(least(y1, y2, 4.0, 6.0) AS DOUBLE) AS min_y, CAST(greatest(x1, x2, 3.0, 5.25) AS DOUBLE) AS max_x, CAST(greatest(y1, y2, 4.0, 6.0) AS DOUBLE) AS max_y,
  a * 2 + (a * 3 + e) AS mx, b * 2 + (d * 2) * 5 + (b * 3 + d * 4 + f) AS my, round(CASE WHEN a = 0 AND b = 0 THEN 1.0 ELSE sqrt(a * a + b * b) END, 9) AS pw, CASE WHEN d = 0 THEN 1.0 ELSE d END AS ph,
  printf('#%02x%02x07', CAST(greatest(0, least(255, k % 300 - 20)) AS INTEGER), CAST(k % 256 AS INTEGER)) AS color,
  round((length(regexp_replace(t, '[^0-9]', '', 'g')) * 0.52 + length(regexp_replace(t, '[^A-Z]', '', 'g')) * 0.58 + length(regexp_replace(t, '[^a-z]', '', 'g')) * 0.55 + length(regexp_replace(t, '[^,.;:!?''"() ]', '', 'g')) * 0.3 + 0.25
    + length(regexp_replace(t, '[0-9A-Za-z,.;:!?''"() |]', '', 'g')) * 0.55) * 10.0, 6) AS width,
  CAST(CASE WHEN abs(k % 200 - 100) < 1 THEN 0 WHEN abs(abs(k % 200 - 100) - 90) <= 1 THEN sign(k % 200 - 100) * 90 ELSE 0 END AS DOUBLE) AS turn FROM m
""",
}
