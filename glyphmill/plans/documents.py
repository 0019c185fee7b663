"""Document queries: scans, presets, reports, headings, annotations, forms, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..schema import PAGE_HEIGHT, PAGE_WIDTH
from ..sources import marks as S
from ..sources.typesetter import LINES_SQL, WORDS_SQL
from .layout import lines_and_words, words_of


def _pages_and_images(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of the typeset documents, and images on some of them by page and document number; every tenth document has images as large as its pages, as scans have."""
    pages = words.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"))
    n = F.when(F.col("doc_id") % 5 == 0, 1).when(F.col("doc_id") % 7 == 0, 7).when((F.col("doc_id") + F.col("page_no")) % 3 == 0, 2).otherwise(0)
    images = pages.withColumn("n", n).where("n > 0").select("doc_id", "page_no", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("seq"))
    full = F.col("doc_id") % 10 == 0
    return pages, images.select("doc_id", "page_no", "seq", F.when(full, 0.0).otherwise(F.col("seq") * 20.0).alias("x"), F.when(full, 0.0).otherwise(30.0).alias("y"), F.when(full, 600.0).otherwise(100.0).alias("width"), F.when(full, 780.0).otherwise(80.0).alias("height"))


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir)
    pages, images = _pages_and_images(words)
    return D.page_figures(pages, words, images)


def scan_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.scan_analysis(D.document_figures(_figures(spark, sf_dir)))
    r = lambda c: F.round(c, 9).alias(c)
    return found.select("doc_id", "is_scanned", r("confidence"), r("text_ratio"), r("image_ratio"), "text_length", "images", "pages_with_text", "pages_with_images")


def preset_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.presets(D.scan_analysis(D.document_figures(_figures(spark, sf_dir))))


def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, images = _pages_and_images(words_of(spark, sf_dir))
    return D.image_statistics(images, pages)


def document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir)
    found = D.report(_figures(spark, sf_dir), words.select("doc_id", "font_family"))
    r = lambda p: F.get_json_object("report", p)
    return found.select("doc_id", r("$.pages").cast("long").alias("pages"), r("$.items").cast("long").alias("items"), r("$.images").cast("long").alias("images"), r("$.fonts").alias("fonts"), r("$.issues").alias("issues"), r("$.page_list[0].orientation").alias("orientation"))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = lines_and_words(spark, sf_dir)
    short = F.when(F.col("line_no") % 14 == 0, F.upper(F.substring("text", 1, 40))).otherwise(F.col("text"))
    return D.heading_lines(lines.withColumn("text", short)).select("doc_id", "page_no", "line_no", "heading")


def semantic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = D.content_style(D.semantic_tag(words_of(spark, sf_dir)))
    deco = D.decoration(F.when(F.col("word_no") % 19 == 3, "overline").when(F.col("word_no") % 19 == 5, "none"), F.concat("font_family", F.when(F.col("word_no") % 7 == 2, "-Underline").when(F.col("word_no") % 7 == 4, "StrikeOut").otherwise("")))
    return words.withColumn("deco", deco).groupBy("doc_id", "page_no", "tag", "styled_weight", "styled_style", "deco").agg(F.count("*").alias("n"))


def better_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of each document: the first falls apart into letters for every third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    letters = F.regexp_replace("text", "(.)", "$1 ")
    a = docs.select("doc_id", F.lit(0).alias("page_no"), F.when(F.col("doc_id") % 3 == 0, letters).otherwise(F.col("text")).alias("text"))
    items = lambda df: df.select("doc_id", F.lit(0).alias("line_no"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_no", "text"))
    score = lambda df: D.text_quality(items(df)).select("doc_id", "score")
    b = docs.select("doc_id", F.lit(0).alias("page_no"), "text")
    found = D.better_text(a.join(score(a), "doc_id"), b.join(score(b), "doc_id"))
    return found.select("doc_id", "page_no", F.md5("text").alias("text_md5"), "replaced")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as link, note and mark annotations."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kinds = F.array(*map(F.lit, ("Link", "Highlight", "Underline", "StrikeOut", "Text", "Popup")))
    base = F.col("c_custkey").cast("double") % 500
    rect = F.when(F.col("c_custkey") % 11 == 0, F.array(base, base)).otherwise(F.array(base, base + 10, base + 40, base + 30))
    raw = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page_no"), F.get(kinds, (F.col("c_custkey") % 6).cast("int")).alias("subtype"), rect.alias("rect"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("http://x/"), "c_name")).alias("url"), F.col("c_mktsegment").alias("contents"))
    return S.annotations(raw, PAGE_HEIGHT)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as form widgets."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    base = k.cast("double") % 400
    raw = p.select(
        k.alias("doc_id"), F.lit(0).alias("page_no"), F.when(k % 9 == 0, "Link").otherwise("Widget").alias("subtype"), F.array(base, base, base + 50, base + 20).alias("rect"),
        F.when(k % 4 == 0, "Tx").when(k % 4 == 1, "Btn").when(k % 4 == 2, "Ch").otherwise("Sig").alias("field_type"), F.col("p_name").alias("field_name"),
        F.when(k % 8 != 1, F.col("p_type")).alias("value_str"), F.when(k % 8 == 1, k % 16 == 1).alias("value_bool"),
    )
    return S.forms(raw, PAGE_HEIGHT).withColumn("value_bool", F.col("value_bool").cast("string"))


def image_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by first bytes, by hint and by filter; data URLs."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    head = F.when(k % 5 == 0, "FFD8FFE0").when(k % 5 == 1, "89504E47").when(k % 5 == 2, "47494638").otherwise("00010203")
    data = F.concat(F.unhex(head), F.col("p_name").cast("binary"))
    filters = F.when(k % 3 == 0, F.array(F.lit("DCTDecode"))).when(k % 3 == 1, F.array(F.lit("FlateDecode"))).otherwise(F.array().cast("array<string>"))
    rows = p.select(k.alias("id"), data.alias("data"), F.when(k % 7 == 0, "gif").alias("hint"), filters.alias("filters"))
    fmt = S.image_format(F.col("data"), F.col("hint"))
    return rows.select("id", fmt.alias("format"), S.format_of_filters(F.col("filters")).alias("by_filter"), F.md5(S.data_url(F.col("data"), fmt)).alias("url_md5"))


QUERIES = {f.__name__: f for f in (scan_detect, preset_suggest, image_stats, document_report, heading_levels, semantic_tags, better_text, annotations, forms, image_formats)}

_FIGURES = (
    WORDS_SQL
    + """,
pg AS (SELECT DISTINCT doc_id, page_no FROM words),
im0 AS (SELECT doc_id, page_no, CASE WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 7 = 0 THEN 7 WHEN (doc_id + page_no) % 3 = 0 THEN 2 ELSE 0 END AS n FROM pg),
im AS (
  SELECT doc_id, page_no, seq, CASE WHEN doc_id % 10 = 0 THEN 0.0 ELSE seq * 20.0 END AS x, CASE WHEN doc_id % 10 = 0 THEN 0.0 ELSE 30.0 END AS y, CASE WHEN doc_id % 10 = 0 THEN 600.0 ELSE 100.0 END AS width, CASE WHEN doc_id % 10 = 0 THEN 780.0 ELSE 80.0 END AS height
  FROM (SELECT doc_id, page_no, unnest(range(1, n + 1)) AS seq FROM im0)),
tx AS (SELECT doc_id, page_no, sum(length(text)) AS text_length, count(*) AS items FROM words GROUP BY doc_id, page_no),
ia AS (SELECT doc_id, page_no, count(*) AS images, sum(width * height) AS image_area FROM im GROUP BY doc_id, page_no),
fg AS (
  SELECT pg.doc_id, pg.page_no, coalesce(text_length, 0) AS text_length, coalesce(items, 0) AS items, coalesce(images, 0) AS images, coalesce(image_area, 0.0) AS image_area
  FROM pg LEFT JOIN tx ON pg.doc_id = tx.doc_id AND pg.page_no = tx.page_no LEFT JOIN ia ON pg.doc_id = ia.doc_id AND pg.page_no = ia.page_no),
dc AS (
  SELECT doc_id, count(*) AS pages, CAST(sum(text_length) AS BIGINT) AS text_length, CAST(sum(items) AS BIGINT) AS items, CAST(sum(images) AS BIGINT) AS images, count(CASE WHEN text_length > 0 THEN 1 END) AS pages_with_text,
    count(CASE WHEN images > 0 THEN 1 END) AS pages_with_images, sum(image_area) / (count(*) * 612.0 * 792.0) AS coverage, count(CASE WHEN items > 50 AND images > 0 THEN 1 END) AS complex_pages FROM fg GROUP BY doc_id),
r AS (SELECT *, CAST(text_length AS DOUBLE) / pages AS tp, CAST(images AS DOUBLE) / pages AS ip, CAST(pages_with_images AS DOUBLE) / pages AS wi, CAST(pages_with_text AS DOUBLE) / pages AS wt FROM dc),
sc AS (SELECT *, (tp < 50 AND (ip >= 0.8 OR coverage > 0.3)) OR (wi > 0.7 AND wt < 0.3 AND ip >= 0.8) AS is_scanned FROM r)
"""
)
ORACLES = {
    "better_text": r"""
WITH v AS (
  SELECT doc_id, 1 AS side, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '(.)', '\1 ', 'g') ELSE text END AS text FROM documents
  UNION ALL SELECT doc_id, 2, text FROM documents),
i AS (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM v),
d AS (
  SELECT doc_id, side, text, array_to_string(ws, ' ') AS joined, len(ws) AS n_items, len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z]'))) AS alpha_items,
    len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Za-z]{1,2}$'))) AS short_items, list_filter(ws, lambda w: regexp_matches(w, '^[A-Za-z]+$')) AS alpha FROM i),
t AS (
  SELECT *, len(regexp_extract_all(joined, '(?:\b[A-Za-z]\b\s+){4,}\b[A-Za-z]\b')) AS singles, len(regexp_extract_all(joined, '\b[A-Za-z]{1,2}(?:\s+[A-Za-z]{1,2}){4,}\b')) AS fragments FROM d),
r AS (
  SELECT *, len(list_filter(alpha, lambda w: length(w) >= 3)) / CAST(greatest(1, len(alpha)) AS DOUBLE) - len(list_filter(alpha, lambda w: length(w) <= 2)) / CAST(greatest(1, len(alpha)) AS DOUBLE) * 0.6
    - least(1.0, singles * 0.25 + fragments * 0.15 + short_items / CAST(greatest(1, alpha_items) AS DOUBLE) * 0.9 + least(1.0, n_items / CAST(greatest(1, length(replace(joined, ' ', ''))) AS DOUBLE)) * 0.75) AS raw FROM t),
s AS (SELECT doc_id, side, text, CASE WHEN length(joined) < 80 THEN 1.0 ELSE greatest(0.0, least(1.0, raw)) END AS score FROM r WHERE n_items > 0),
p AS (SELECT a.doc_id, a.text AS t1, b.text AS t2, coalesce(a.score < 0.32 AND b.score > a.score + 0.08 AND b.text <> '', false) AS replaced FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND b.side = 2 WHERE a.side = 1)
SELECT doc_id, 0 AS page_no, md5(CASE WHEN replaced THEN t2 ELSE t1 END) AS text_md5, replaced FROM p
""".replace("\\\\", "\\"),
    "scan_detect": _FIGURES
    + """
SELECT doc_id, is_scanned, round(CAST(CASE WHEN is_scanned THEN least(1.0, 0.5 + CASE WHEN tp < 20 THEN 0.2 ELSE 0.0 END + CASE WHEN ip >= 1 THEN 0.2 ELSE 0.0 END + CASE WHEN coverage > 0.5 THEN 0.15 ELSE 0.0 END + CASE WHEN wi > 0.9 AND wt < 0.2 THEN 0.15 ELSE 0.0 END)
  WHEN tp > 200 THEN 0.9 ELSE 0.5 END AS DOUBLE), 9) AS confidence, round(tp / 1000, 9) AS text_ratio, round(ip, 9) AS image_ratio, text_length, images, pages_with_text, pages_with_images FROM sc
""",
    "preset_suggest": _FIGURES
    + """
SELECT doc_id, CASE WHEN is_scanned THEN 'editing' WHEN pages = 1 AND images > 5 THEN 'fidelity' WHEN complex_pages > 0 OR pages > 10 THEN 'web' WHEN items > 1000 THEN 'editing' ELSE 'web' END AS preset,
  CASE WHEN is_scanned THEN 'scanned' WHEN pages = 1 AND images > 5 THEN 'single page with many images' WHEN complex_pages > 0 OR pages > 10 THEN 'complex layout' WHEN items > 1000 THEN 'text-heavy' ELSE 'general' END AS reason FROM sc
""",
    "image_stats": _FIGURES
    + """
SELECT doc_id, count(*) AS images, count(CASE WHEN width >= 612 * 0.9 AND height >= 792 * 0.9 THEN 1 END) AS full_page,
  count(CASE WHEN NOT (width >= 612 * 0.9 AND height >= 792 * 0.9) AND (x <> 0 OR y <> 0) THEN 1 END) AS positioned FROM im GROUP BY doc_id
""",
    "document_report": _FIGURES
    + """,
f AS (SELECT doc_id, '["' || string_agg(DISTINCT font_family, '","' ORDER BY font_family) || '"]' AS fonts, count(DISTINCT font_family) AS n FROM words GROUP BY doc_id)
SELECT dc.doc_id, pages, items, images, fonts, CASE WHEN items = 0 AND n > 2 THEN '["no text","many fonts"]' WHEN items = 0 THEN '["no text"]' WHEN n > 2 THEN '["many fonts"]' ELSE '[]' END AS issues, 'portrait' AS orientation
FROM dc JOIN f ON dc.doc_id = f.doc_id
""",
    "heading_levels": LINES_SQL
    + """,
t AS (SELECT *, CASE WHEN line_no % 14 = 0 THEN upper(substr(text, 1, 40)) ELSE text END AS said FROM lines),
m AS (SELECT t.*, ms FROM t JOIN (SELECT doc_id, page_no, quantile_cont(font_size, 0.5) AS ms FROM lines GROUP BY doc_id, page_no) q ON t.doc_id = q.doc_id AND t.page_no = q.page_no),
r AS (SELECT *, font_size / ms AS ratio FROM m)
SELECT doc_id, page_no, line_no, CASE WHEN trim(said) <> '' AND length(trim(said)) <= 100 AND ratio >= 1.2 AND (font_weight > 450 OR (trim(said) = upper(trim(said)) AND regexp_matches(said, '[A-Z]')))
  THEN CASE WHEN ratio >= 2.0 THEN 1 WHEN ratio >= 1.8 THEN 2 WHEN ratio >= 1.5 THEN 3 WHEN ratio >= 1.3 THEN 4 WHEN ratio >= 1.2 THEN 5 ELSE 6 END END AS heading FROM r
""",
    "semantic_tags": WORDS_SQL
    + """,
r AS (SELECT *, font_size / avg(font_size) OVER (PARTITION BY doc_id, page_no) AS ratio, trim(text) AS t FROM words),
k AS (SELECT *, length(t) <= 50 AND (regexp_matches(t, '^[A-Z][a-z]+( [A-Z][a-z]+)*$') OR (t = upper(t) AND regexp_matches(t, '[A-Z]'))) AS title, regexp_matches(t, '^[A-Za-z]{2,20}$') AS emph,
  lower(font_family || CASE WHEN word_no % 7 = 2 THEN '-Underline' WHEN word_no % 7 = 4 THEN 'StrikeOut' ELSE '' END) AS fname FROM r),
s AS (
  SELECT doc_id, page_no, CASE WHEN ratio >= 2.0 THEN 'h1' WHEN ratio >= 1.75 THEN 'h2' WHEN ratio >= 1.5 THEN 'h3' WHEN ratio >= 1.25 THEN 'h4' WHEN ratio >= 1.1 THEN 'h5' WHEN ratio >= 1.05 THEN 'h6' WHEN font_style = 'italic' THEN 'em' WHEN font_weight >= 600 THEN 'strong' ELSE 'span' END AS tag,
    CASE WHEN title THEN greatest(font_weight, 700) WHEN emph THEN greatest(font_weight, 600) ELSE font_weight END AS styled_weight, CASE WHEN NOT title AND emph THEN 'italic' ELSE font_style END AS styled_style,
    CASE WHEN word_no % 19 = 3 THEN 'overline' WHEN contains(fname, 'underline') THEN 'underline' WHEN contains(fname, 'strike') THEN 'line-through' WHEN contains(fname, 'overline') THEN 'overline' ELSE 'none' END AS deco FROM k)
SELECT doc_id, page_no, tag, styled_weight, styled_style, deco, count(*) AS n FROM s GROUP BY ALL
""",
    "annotations": """
SELECT c_custkey AS doc_id, 0 AS page_no, CASE c_custkey % 6 WHEN 0 THEN 'link' WHEN 1 THEN 'highlight' WHEN 2 THEN 'underline' WHEN 3 THEN 'strikeout' ELSE 'note' END AS type, CAST(c_custkey % 500 AS DOUBLE) AS x,
  792.0 - (c_custkey % 500 + 30) AS y, 40.0 AS width, 20.0 AS height, c_mktsegment AS content, CASE WHEN c_custkey % 2 = 0 THEN 'http://x/' || c_name END AS url FROM customer WHERE c_custkey % 11 <> 0
""",
    "forms": """
SELECT p_partkey AS doc_id, 0 AS page_no, CASE WHEN p_partkey % 4 = 0 THEN 'text' WHEN p_partkey % 4 = 1 THEN CASE WHEN p_partkey % 8 = 1 THEN 'checkbox' ELSE 'button' END WHEN p_partkey % 4 = 2 THEN 'dropdown' ELSE 'text' END AS type,
  p_name AS name, CASE WHEN p_partkey % 8 <> 1 THEN p_type END AS value_str, CASE WHEN p_partkey % 8 = 1 THEN CAST(p_partkey % 16 = 1 AS VARCHAR) END AS value_bool, CAST(p_partkey % 400 AS DOUBLE) AS x, 792.0 - (p_partkey % 400 + 20) AS y, 50.0 AS width, 20.0 AS height
FROM part WHERE p_partkey % 9 <> 0
""",
    "image_formats": """
WITH f AS (
  SELECT p_partkey AS id, p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN 'gif' WHEN p_partkey % 5 = 0 THEN 'jpeg' WHEN p_partkey % 5 = 1 THEN 'png' WHEN p_partkey % 5 = 2 THEN 'gif' ELSE 'jpeg' END AS format,
    CASE WHEN p_partkey % 5 = 0 THEN 'FFD8FFE0' WHEN p_partkey % 5 = 1 THEN '89504E47' WHEN p_partkey % 5 = 2 THEN '47494638' ELSE '00010203' END AS head FROM part)
SELECT id, format, CASE p_partkey % 3 WHEN 1 THEN 'png' ELSE 'jpeg' END AS by_filter, md5('data:image/' || format || ';base64,' || base64(unhex(head || hex(encode(p_name))))) AS url_md5 FROM f
""",
}
