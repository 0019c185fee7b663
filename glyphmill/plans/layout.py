"""Layout queries over typeset documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as L
from ..sources.typesetter import LINES_SQL, WORDS_SQL, text_lines, typeset


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typeset(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def lines_and_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = words_of(spark, sf_dir)
    return text_lines(words), words


def typeset_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of typeset words: boxes, number of words, text."""
    lines, _ = lines_and_words(spark, sf_dir)
    return lines.select("doc_id", "page_no", "line_no", "min_x", "max_x", "top", "height", "n_words", F.md5("text").alias("text_md5"))


def layout_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, words = lines_and_words(spark, sf_dir)
    return L.page_statistics(words, lines).withColumns({c: F.round(c, 9) for c in ("size_variance", "text_density", "words_per_line")})


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, words = lines_and_words(spark, sf_dir)
    return L.with_regions(lines, L.page_sizes(words))


def regions_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.stable_flags(L.regions(_regions(spark, sf_dir)))
    return found.select("doc_id", "page_no", "region_no", "n_lines", "min_x", "max_x", "top", "bottom", "stable_height", "stable_indent")


def paragraphs_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.paragraphs(L.with_paragraphs(_regions(spark, sf_dir)))
    return found.select("doc_id", "page_no", "region_no", "paragraph_no", "n_lines", "top", "gap_before", "n_joined", F.md5("text").alias("text_md5"))


def x_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir).select("doc_id", "page_no", F.floor(F.col("x") + 0.5).cast("double").alias("v"))
    return L.clusters(words, L.PAGE, "v", 5).select("doc_id", "page_no", "centre", "n")


def page_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, words = lines_and_words(spark, sf_dir)
    found = L.margins(words, lines)
    joined = lambda c: F.array_join(F.transform(c, lambda v: F.format_string("%.3f", v)), ";")
    return found.select("doc_id", "page_no", "left_margin", "right_margin", joined("indents").alias("indents"), joined("columns").alias("columns"))


def column_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns: words of odd places move to the right half."""
    words = words_of(spark, sf_dir).withColumn("width", F.least("width", F.lit(60.0))).withColumn("x", F.col("x") % 140 + F.when(F.col("word_no") % 2 == 1, 340.0).otherwise(0.0))
    return L.column_gaps(words)


def nearest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir).withColumn("x", F.floor(F.col("x") / 90) * 90.0)
    centres = L.clusters(words.select("doc_id", "page_no", F.floor(F.col("x") + 0.5).cast("double").alias("v")), L.PAGE, "v", 5)
    return L.nearest_columns(words, centres)


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.blocks(words_of(spark, sf_dir))


def cursor_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir).withColumn("width", F.col("width") * F.when(F.col("word_no") % 4 == 1, 2.0).otherwise(1.0))
    rows = L.cursor_gaps(words)
    return rows.groupBy(*L.LINE).agg(F.sum("cursor_gap").alias("sum_gap"), F.min("cursor_gap").alias("min_gap"), F.count_if(F.col("cursor_gap") < 0).alias("n_overlaps"))


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir)
    spans = words.select(*L.LINE, F.col("x").alias("start"), (F.col("x") + F.col("width") * F.when(F.col("word_no") % 3 == 0, 1.5).otherwise(1.0)).alias("end"))
    return L.covered_length(spans, L.LINE)


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reading_order(words_of(spark, sf_dir))


def table_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cells: a page for each supplier and part group, a row for each item with two to four cells."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = items.select(
        F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 5).cast("int").alias("page_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"), (2 + F.col("l_linenumber") % 3).alias("cells"), (F.col("l_quantity") % 3).alias("jitter")
    )
    cells = rows.select("doc_id", "page_no", "row_no", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell_no"), "jitter")
    cells = cells.withColumn("x", 50.0 + F.col("cell_no") * 100 + F.when(F.col("page_no") % 2 == 0, F.col("jitter")).otherwise(F.col("jitter") * 0.25))
    return L.table_rows(cells).withColumn("alignment", F.round("alignment", 9))


QUERIES = {f.__name__: f for f in (typeset_words, layout_statistics, regions_islands, paragraphs_islands, x_clusters, page_margins, column_gaps, nearest_columns, text_blocks, cursor_gaps, interval_union, reading_order, table_detect)}

_REGIONS = (
    LINES_SQL
    + """,
sizes AS (SELECT doc_id, page_no, quantile_cont(height, 0.5) AS mh, quantile_cont(font_size, 0.5) AS mf FROM words GROUP BY doc_id, page_no),
l1 AS (
  SELECT lines.*, mh, mf, lag(top) OVER w AS ptop, lag(top + lines.height) OVER w AS pbottom, lag(min_x) OVER w AS pmin
  FROM lines JOIN sizes USING (doc_id, page_no) WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY top, min_x, line_no)),
l2 AS (
  SELECT *, sum(CASE WHEN ptop IS NULL OR top - pbottom > greatest(6.0, mh * 1.8)
      OR (abs(min_x - pmin) > greatest(8.0, mf * 2) AND top - ptop > greatest(2.0, mh * 0.6)) THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id, page_no ORDER BY top, min_x, line_no) - 1 AS region_no FROM l1)
"""
)
ORACLES = {
    "typeset_words": LINES_SQL + "SELECT doc_id, page_no, line_no, min_x, max_x, top, height, n_words, md5(text) AS text_md5 FROM lines",
    "layout_statistics": LINES_SQL
    + """,
wg AS (
  SELECT doc_id, page_no, gap, gap / greatest(1.0, size) AS norm FROM (
    SELECT doc_id, page_no, lead(x) OVER w - (x + width) AS gap, (font_size + lead(font_size) OVER w) / 2 AS size
    FROM words WINDOW w AS (PARTITION BY doc_id, page_no, line_no ORDER BY x, word_no)) WHERE gap >= 0),
w1 AS (
  SELECT doc_id, page_no, quantile_cont(CASE WHEN norm < 0.8 THEN gap END, 0.5) AS char_gap, quantile_cont(CASE WHEN norm > 0.25 THEN gap END, 0.5) AS word_gap,
    list_sort(list(gap) FILTER (WHERE norm > 0.25)) AS gs FROM wg GROUP BY doc_id, page_no),
lg AS (
  SELECT doc_id, page_no, gap, gap > height * 1.5 AS para FROM (
    SELECT doc_id, page_no, height, lead(top) OVER (PARTITION BY doc_id, page_no ORDER BY top, line_no) - (top + height) AS gap FROM lines) WHERE gap >= 0),
l1 AS (SELECT doc_id, page_no, quantile_cont(gap, 0.5) AS line_gap, quantile_cont(CASE WHEN para THEN gap END, 0.5) AS paragraph_gap FROM lg GROUP BY doc_id, page_no),
f AS (
  SELECT doc_id, page_no, var_pop(font_size) AS size_variance, sum(length(text)) / (612.0 * 792.0) AS text_density, count(*) AS n_words, count(DISTINCT line_no) AS n_lines,
    quantile_cont(height, 0.5) AS median_height, quantile_cont(font_size, 0.5) AS median_font_size FROM words GROUP BY doc_id, page_no),
ds AS (SELECT doc_id, page_no, font_size AS v, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY count(*) DESC, min(line_no * 100000 + word_no)) AS r FROM words GROUP BY doc_id, page_no, font_size),
df AS (SELECT doc_id, page_no, font_family AS v, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY count(*) DESC, min(line_no * 100000 + word_no)) AS r FROM words GROUP BY doc_id, page_no, font_family)
SELECT f.doc_id, f.page_no, round(size_variance, 9) AS size_variance, n_words, n_lines, median_height, median_font_size, round(text_density, 9) AS text_density, round(CAST(n_words AS DOUBLE) / n_lines, 9) AS words_per_line,
  coalesce(nullif(char_gap, 0.0), 0.0) AS char_gap, coalesce(nullif(word_gap, 0.0), 3.0) AS word_gap, coalesce(nullif(line_gap, 0.0), 12.0) AS line_gap,
  coalesce(nullif(paragraph_gap, 0.0), 20.0) AS paragraph_gap, coalesce(nullif(gs[1 + CAST(floor(len(gs) * 0.25) AS BIGINT)], 0.0), 2.0) AS p25_word_gap,
  coalesce(nullif(gs[1 + CAST(floor(len(gs) * 0.75) AS BIGINT)], 0.0), 5.0) AS p75_word_gap, ds.v AS dominant_size, df.v AS dominant_family
FROM f LEFT JOIN w1 ON f.doc_id = w1.doc_id AND f.page_no = w1.page_no LEFT JOIN l1 ON f.doc_id = l1.doc_id AND f.page_no = l1.page_no
JOIN ds ON f.doc_id = ds.doc_id AND f.page_no = ds.page_no AND ds.r = 1 JOIN df ON f.doc_id = df.doc_id AND f.page_no = df.page_no AND df.r = 1
""",
    "regions_islands": _REGIONS
    + """
SELECT doc_id, page_no, region_no, count(*) AS n_lines, min(min_x) AS min_x, max(max_x) AS max_x, min(top) AS top, max(top + height) AS bottom,
  count(*) <= 1 OR max(height) <= greatest(min(height) + 4, any_value(mh) * 1.4) AS stable_height,
  count(*) <= 2 OR list_sort(list(min_x))[1 + CAST(floor(count(*) * 0.9) AS BIGINT)] - list_sort(list(min_x))[1 + CAST(floor(count(*) * 0.1) AS BIGINT)] <= greatest(18.0, any_value(mf) * 2.5) AS stable_indent
FROM l2 GROUP BY doc_id, page_no, region_no
""",
    "paragraphs_islands": _REGIONS
    + """,
p1 AS (
  SELECT *, top - lag(top + height) OVER w AS gap, abs(min_x - lag(min_x) OVER w) AS shift, lag(text) OVER w AS ptext
  FROM l2 WINDOW w AS (PARTITION BY doc_id, page_no, region_no ORDER BY top, min_x, line_no)),
p2 AS (SELECT *, gap IS NULL OR gap > greatest(4.0, mh * 0.8) OR (shift > greatest(10.0, mh * 1.2) AND gap > greatest(1.0, mh * 0.15)) AS starts FROM p1),
p3 AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, region_no ORDER BY top, min_x, line_no) - 1 AS paragraph_no FROM p2)
SELECT doc_id, page_no, region_no, paragraph_no, count(*) AS n_lines, min(top) AS top, max(CASE WHEN starts THEN greatest(0.0, coalesce(gap, 0.0)) END) AS gap_before,
  count(CASE WHEN NOT starts AND regexp_matches(ptext, '[A-Z][a-z]{0,2}$') AND regexp_matches(text, '^[a-z]{3,}') THEN 1 END) AS n_joined,
  md5(string_agg(text, ' ' ORDER BY top, min_x, line_no)) AS text_md5
FROM p3 GROUP BY doc_id, page_no, region_no, paragraph_no
""",
    "x_clusters": WORDS_SQL
    + """,
v AS (SELECT doc_id, page_no, floor(x + 0.5) AS v FROM words),
b AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY doc_id, page_no ORDER BY v) > 5 THEN 1 ELSE 0 END AS brk FROM v),
g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_no ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM b)
SELECT doc_id, page_no, avg(v) AS centre, count(*) AS n FROM g GROUP BY doc_id, page_no, c HAVING count(*) >= 2
""",
    "page_margins": LINES_SQL
    + """,
base AS (SELECT doc_id, page_no, quantile_cont(min_x, 0.5) AS left_margin, quantile_cont(612.0 - max_x, 0.5) AS right_margin FROM lines GROUP BY doc_id, page_no),
v AS (
  SELECT doc_id, page_no, 'c' AS kind, floor(x + 0.5) AS v, 5.0 AS tol FROM words
  UNION ALL SELECT doc_id, page_no, 'i', min_x, 3.0 FROM lines JOIN base USING (doc_id, page_no) WHERE min_x > left_margin),
b AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY doc_id, page_no, kind ORDER BY v) > tol THEN 1 ELSE 0 END AS brk FROM v),
g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_no, kind ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM b),
m AS (SELECT doc_id, page_no, kind, floor(avg(v) * 1000 + 0.5) / 1000.0 AS centre FROM g GROUP BY doc_id, page_no, kind, c HAVING count(*) >= 2),
s AS (SELECT doc_id, page_no, kind, string_agg(printf('%.3f', centre), ';' ORDER BY centre) AS said FROM m GROUP BY doc_id, page_no, kind)
SELECT doc_id, page_no, left_margin, right_margin,
  coalesce((SELECT said FROM s WHERE s.doc_id = base.doc_id AND s.page_no = base.page_no AND kind = 'i'), '') AS indents,
  coalesce((SELECT said FROM s WHERE s.doc_id = base.doc_id AND s.page_no = base.page_no AND kind = 'c'), '') AS columns
FROM base
""",
    "column_gaps": WORDS_SQL
    + """,
m AS (SELECT doc_id, page_no, x % 140 + CASE WHEN word_no % 2 = 1 THEN 340.0 ELSE 0.0 END AS x, least(width, 60.0) AS width FROM words),
e AS (SELECT DISTINCT doc_id, page_no, floor(x + 0.5) AS edge FROM m UNION SELECT doc_id, page_no, floor(x + width + 0.5) FROM m),
p AS (SELECT doc_id, page_no, max(x + width) AS pw FROM m GROUP BY doc_id, page_no),
g AS (SELECT *, lead(edge) OVER (PARTITION BY doc_id, page_no ORDER BY edge) AS nxt FROM e),
s AS (SELECT doc_id, page_no, 0.0 AS start FROM p UNION ALL SELECT g.doc_id, g.page_no, nxt FROM g JOIN p USING (doc_id, page_no) WHERE nxt - edge > pw * 0.1),
c AS (SELECT s.doc_id, s.page_no, start, coalesce(lead(start) OVER (PARTITION BY s.doc_id, s.page_no ORDER BY start), pw) AS stop FROM s JOIN p USING (doc_id, page_no))
SELECT c.doc_id, c.page_no, CAST(start AS DOUBLE) AS start, CAST(stop AS DOUBLE) AS "end", count(*) AS n_items
FROM m JOIN c ON m.doc_id = c.doc_id AND m.page_no = c.page_no AND m.x >= start AND m.x < stop GROUP BY c.doc_id, c.page_no, start, stop
""",
    "nearest_columns": WORDS_SQL
    + """,
m AS (SELECT doc_id, page_no, floor(x / 90) * 90 AS x, width FROM words),
b AS (SELECT doc_id, page_no, x AS v, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id, page_no ORDER BY x) > 5 THEN 1 ELSE 0 END AS brk FROM m),
g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_no ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM b),
k AS (SELECT DISTINCT doc_id, page_no, floor(avg(v) + 0.5) AS centre FROM g GROUP BY doc_id, page_no, c HAVING count(*) >= 2),
ok AS (SELECT doc_id, page_no FROM k GROUP BY doc_id, page_no HAVING count(*) >= 2),
r AS (SELECT m.doc_id, m.page_no, x, width, (SELECT min_by(centre, abs(m.x - centre) * 1000000 + centre) FROM k WHERE k.doc_id = m.doc_id AND k.page_no = m.page_no) AS centre FROM m JOIN ok USING (doc_id, page_no))
SELECT doc_id, page_no, CAST(centre AS DOUBLE) AS centre, count(*) AS n_items, CAST(min(x) AS DOUBLE) AS x, CAST(max(x + width) AS DOUBLE) AS "right" FROM r GROUP BY doc_id, page_no, centre
""",
    "text_blocks": WORDS_SQL
    + """,
a AS (SELECT *, first_value(height) OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, x, word_no) * 1.5 AS lh, lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, x, word_no) AS py FROM words),
b AS (SELECT *, sum(CASE WHEN py IS NULL OR abs(y - py) > lh / 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, x, word_no) - 1 AS block_no FROM a)
SELECT doc_id, page_no, block_no, count(*) AS n_items, min(x) AS x, max(x + width) - min(x) AS width, avg(font_size) AS font_size, CASE WHEN avg(font_size) > 14 THEN 'h3' ELSE 'p' END AS tag
FROM b GROUP BY doc_id, page_no, block_no
""",
    "cursor_gaps": WORDS_SQL
    + """,
m AS (SELECT *, width * CASE WHEN word_no % 4 = 1 THEN 2.0 ELSE 1.0 END AS w2 FROM words),
g AS (SELECT doc_id, page_no, line_no, x - coalesce(max(x + w2) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY x, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS gap FROM m)
SELECT doc_id, page_no, line_no, sum(gap) AS sum_gap, min(gap) AS min_gap, count(CASE WHEN gap < 0 THEN 1 END) AS n_overlaps FROM g GROUP BY doc_id, page_no, line_no
""",
    "interval_union": WORDS_SQL
    + """,
s AS (SELECT doc_id, page_no, line_no, x AS a, x + width * CASE WHEN word_no % 3 = 0 THEN 1.5 ELSE 1.0 END AS b FROM words),
r AS (SELECT *, max(b) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT doc_id, page_no, line_no, sum(greatest(0.0, b - greatest(a, coalesce(reach, a)))) AS covered FROM r GROUP BY doc_id, page_no, line_no
""",
    "reading_order": WORDS_SQL
    + """,
m AS (SELECT doc_id, page_no, x - lag(x) OVER w AS dx, lag(y) OVER w - y AS dy FROM words WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y DESC, x, word_no))
SELECT doc_id, page_no, coalesce(avg(CASE WHEN abs(dy) < 5 THEN dx END), 0.0) AS x_move, coalesce(avg(CASE WHEN dy > 0 THEN dy END), 0.0) AS y_step,
  CASE WHEN coalesce(avg(CASE WHEN abs(dy) < 5 THEN dx END), 0.0) < 0 THEN 'rtl' ELSE 'ltr' END AS direction
FROM m GROUP BY doc_id, page_no
""",
    "table_detect": """
WITH c AS (
  SELECT l_suppkey AS doc_id, CAST(l_partkey % 5 AS INTEGER) AS page_no, l_orderkey * 10 + l_linenumber AS row_no, l_quantity % 3 AS jitter,
    unnest(range(2 + l_linenumber % 3)) AS cell_no FROM lineitem),
x AS (SELECT *, 50.0 + cell_no * 100 + CASE WHEN page_no % 2 = 0 THEN jitter ELSE jitter * 0.25 END AS x FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, row_no ORDER BY x, cell_no) - 1 AS col, count(*) OVER (PARTITION BY doc_id, page_no, row_no) AS n_cells FROM x),
k AS (SELECT doc_id, page_no, n_cells, count(*) AS n_rows, min(row_no) AS first FROM r WHERE col = 0 GROUP BY doc_id, page_no, n_cells),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n_rows DESC, first) AS pick FROM k),
s AS (
  SELECT r.doc_id, r.page_no, r.n_cells, m.n_rows, col, 1 / (1 + var_pop(x)) AS score FROM r JOIN m ON r.doc_id = m.doc_id AND r.page_no = m.page_no AND r.n_cells = m.n_cells
  WHERE pick = 1 AND m.n_rows >= 2 GROUP BY r.doc_id, r.page_no, r.n_cells, m.n_rows, col)
SELECT doc_id, page_no, n_cells, n_rows, round(avg(score), 9) AS alignment, avg(score) > 0.5 AS is_table FROM s GROUP BY doc_id, page_no, n_cells, n_rows
""",
}
