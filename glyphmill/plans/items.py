"""Item queries: reader output, repaired sizes, padding, widths, glue, lexical lines, blocks, structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fonts as N
from ..functions import text as X
from ..functions.words import frequent_words, word_set
from ..operators import documents as D
from ..operators import items as I
from ..operators import layout as L
from ..sources.typesetter import LINES_SQL, WORDS_SQL
from .layout import _REGIONS, lines_and_words, words_of


def reader_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a reader's text items: quarter turns, missing boxes, absurd sizes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    a, b = F.when(k % 3 == 1, 0.0).otherwise(2.0), F.when(k % 3 == 1, 3.0).when(k % 3 == 2, 2.0).otherwise(0.0)
    matrix = F.array(a, b, -b, a, (k % 500).cast("double"), (k % 700).cast("double"))
    size = F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 0.0).otherwise((k % 20 + 3).cast("double"))
    item = I.reader_item(F.col("o_orderpriority"), matrix, F.get(F.array(*map(F.lit, ("Arial-BoldMT", "Times-Italic", "X-300"))), (k % 3).cast("int")), size, F.when(k % 5 != 0, (k % 90).cast("double")), F.when(k % 7 != 0, (k % 11).cast("double")))
    rows = o.select(k.alias("id"), item.alias("t"), I.rgba(k % 256, k % 100, k % 7, (k % 256).cast("double")).alias("color"), I.glyph_rotation(F.radians((k % 1000).cast("double"))).alias("turn"))
    return rows.select("id", "t.x", "t.y", F.round("t.width", 6).alias("width"), F.round("t.height", 6).alias("height"), "t.font_size", F.round("t.rotation", 6).alias("rotation"), "t.font_weight", "t.font_style", "color", "turn")


def repaired_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as glyphs: sizes, junk, scale of their fonts."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.col("l_quantity")
    size = F.when(q % 4 == 0, 1.0).otherwise(q)
    height = F.when(q % 3 == 0, 1.0).otherwise(q * 0.5)
    family = F.when(q % 5 == 0, "Unknown").otherwise("Arial")
    fixed = I.repaired_size(size, height, q % 6, F.lit(0.875))
    rows = items.select(F.col("l_suppkey").alias("id"), fixed.alias("size"), I.is_junk(F.when(q % 7 != 0, "x"), size, height, family).alias("junk"))
    return rows.groupBy("id", "junk").agg(F.count("*").alias("n"), F.round(F.sum("size"), 6).alias("sizes"))


def font_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words' letters as glyphs that stand lower than their size says."""
    words = words_of(spark, sf_dir)
    chars = words.select("doc_id", "page_no", "line_no", "word_no", "font_size", F.col("font_family").alias("font_name"), F.posexplode(F.split("text", "")).alias("i", "ch")).where("ch <> ''")
    glyphs = chars.select("doc_id", "page_no", ((F.col("line_no").cast("long") * 100_000 + F.col("word_no")) * 100_000 + F.col("i")).alias("glyph_no"), "ch", (F.col("font_size") * F.when(F.col("line_no") % 2 == 0, 0.5).otherwise(0.375)).alias("height"), "font_size", "font_name")
    records = spark.createDataFrame([("Helvetica", 718.0), ("TimesNewRomanPS-BoldMT", 662.0), ("ABCDEF+CourierNewPSMT", 660.0)], "font_name string, cap_height double")
    found = I.font_scales(glyphs, F.broadcast(records))  # three fonts
    return found.select("doc_id", "page_no", "font_name", "n", F.round("scale", 9).alias("scale"))


def run_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir)
    n = F.col("line_no") + F.col("word_no")
    words = words.withColumn("x", F.col("x") + F.when(n % 4 == 1, 1.25).when(n % 4 == 2, -2.0).otherwise(0.0)).withColumn("width", F.when(n % 9 == 4, F.col("width") * 0.5).otherwise(F.col("width")))
    words = words.withColumn("text", F.when(n % 10 == 3, F.concat(F.lit("("), "text")).when(n % 10 == 6, F.lit(",")).otherwise(F.col("text")))
    out = I.with_budget(I.with_padding(words), 36.0, 540.0)
    return out.groupBy(*L.LINE).agg(*[F.round(F.sum(c), 6).alias(c) for c in ("padding_left", "padding_right", "width_adjustment", "final_width")])


def paragraph_glue(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir)
    n = F.col("line_no") + F.col("word_no")
    words = words.withColumn("text", F.when(n % 7 == 2, F.concat("text", F.lit("-"))).when(n % 7 == 4, F.concat(F.lit("("), "text")).when(n % 7 == 5, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    found = I.merged_paragraph(words.select("doc_id", "page_no", "line_no", "word_no", "text", "x", "width", "font_size"), L.LINE, ["word_no"])
    return found.select(*L.LINE, F.md5("text").alias("text_md5"))


def lexical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, words = lines_and_words(spark, sf_dir)
    return I.lexical_lines(lines.select(*L.LINE, "text"), frequent_words(words))


def lexical_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three neighbouring words of a line glued together, cut again by a dictionary of the corpus and letter pairs."""
    words = words_of(spark, sf_dir)
    dictionary = word_set(frequent_words(words, least=100))
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line"))
    tokens = lines.select(F.split("line", " ").alias("w")).where("size(w) >= 3")
    runs = tokens.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.concat(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("text"))
    out = I.lexical_split(runs.groupBy("text").agg(F.count("*").alias("n")), dictionary)
    return out


def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, words = lines_and_words(spark, sf_dir)
    marked = lines.withColumn("text", F.when(F.col("line_no") % 7 > 1, F.concat(F.lit("• "), "text")).otherwise(F.col("text")))
    rows = L.with_paragraphs(L.with_regions(D.heading_lines(marked), L.page_sizes(words))).withColumn("kind", X.list_marker(F.col("text")))
    keys = [*L.PAGE, "region_no", "paragraph_no"]
    return I.split_blocks(rows, keys).groupBy(*keys, "part").agg(F.count("*").alias("n_lines"), F.count("kind").alias("n_markers"))


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = lines_and_words(spark, sf_dir)
    marked = lines.withColumn("text", F.when(F.col("line_no") % 5 == 1, F.concat(F.lit("2) "), "text")).otherwise(F.col("text"))).withColumn("font_size", F.when(F.col("line_no") % 9 == 4, 30.0).otherwise(F.col("font_size")))
    return I.structures(marked).groupBy("doc_id", "page_no", "structure", "level").agg(F.count("*").alias("n"))


def web_font_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' first words as queries of the catalogue of web fonts."""
    fonts = N.web_fonts(spark)
    found = [I.search_web_fonts(fonts, q).withColumn("query", F.lit(q)) for q in ("mono", "SANS", "serif", "ora", "zzz")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


QUERIES = {f.__name__: f for f in (reader_items, repaired_sizes, font_scales, run_padding, paragraph_glue, lexical_lines, lexical_split, split_blocks, structures, web_font_search)}
_WEB = "VALUES " + ", ".join(sorted({f"('{b}', '{c}')" for _, b, c, *_ in N.web_font_rows()}))
_OPEN, _CLOSE, _TIGHT, _WORDY = "[(\\[{\"''‘“]", "[)\\]}\"''’”]", "[,.;:!?]", "[\\p{L}\\p{N}]"


def _padding(gap: str, size: str, left: str, right: str, breaks: str) -> str:
    """SQL of the padding between two runs; null without a neighbour."""
    closes = f"(regexp_matches({right}, '^{_CLOSE}') OR regexp_matches({right}, '^{_TIGHT}'))"
    opens, wordy = f"regexp_matches({left}, '{_OPEN}$')", f"regexp_matches({right}, '^{_WORDY}')"
    sticks = f"(({opens} AND {wordy}) OR (regexp_matches({left}, '-$') AND {wordy}) OR (regexp_matches({left}, '{_WORDY}$') AND {closes}) OR ({opens} AND {closes}))"
    ratio, camel = f"{gap} / greatest(0.01, {size} * 0.55)", f"(regexp_matches({left}, '[A-Za-z]$') AND regexp_matches({right}, '^[A-Z]'))"
    share = f"CASE WHEN {gap} < {size} * 0.25 THEN least({gap} * 0.6, {size} * 0.12) WHEN {gap} < {size} * 0.5 AND {ratio} < 0.5 THEN least({gap} * 0.4, {size} * 0.08) WHEN {gap} < {size} * 0.7 AND {ratio} < 0.7 AND NOT {camel} AND NOT {breaks} THEN least({gap} * 0.2, {size} * 0.05) ELSE 0.0 END"
    return f"coalesce(CASE WHEN {gap} > 0 AND NOT {sticks} THEN floor(CAST({share} AS DOUBLE) * 1000 + 0.5) / 1000.0 ELSE 0.0 END, 0.0)"


ORACLES = {
    "run_padding": WORDS_SQL
    + f""",
r AS (
  SELECT doc_id, page_no, line_no, word_no, font_size, x + CASE (line_no + word_no) % 4 WHEN 1 THEN 1.25 WHEN 2 THEN -2.0 ELSE 0.0 END AS x, CASE WHEN (line_no + word_no) % 9 = 4 THEN width * 0.5 ELSE width END AS width,
    CASE (line_no + word_no) % 10 WHEN 3 THEN '(' || text WHEN 6 THEN ',' ELSE text END AS t FROM words),
n AS (
  SELECT *, lag(x) OVER w AS px, lag(width) OVER w AS pw, lag(font_size) OVER w AS ps, lag(t) OVER w AS pt, lead(x) OVER w AS nx, lead(font_size) OVER w AS ns, lead(t) OVER w AS nt FROM r
  WINDOW w AS (PARTITION BY doc_id, page_no, line_no ORDER BY x, word_no)),
g AS (SELECT *, x - (px + pw) AS lgap, greatest(1.0, (ps + font_size) / 2) AS lsize, nx - (x + width) AS rgap, greatest(1.0, (ns + font_size) / 2) AS rsize, length(t) * font_size * 0.45 AS least_ FROM n),
p AS (
  SELECT *, {_padding("lgap", "lsize", "pt", "t", "false")} AS padding_left, {_padding("rgap", "rsize", "t", "nt", "regexp_matches(nt, '^[,.;:!?)]')")} AS padding_right,
    floor(CAST(CASE WHEN width <= 0 THEN least(font_size * 0.08, 2.0) WHEN width < least_ * 0.9 THEN least((least_ - width) * 0.3, font_size * 0.15) ELSE 0.0 END AS DOUBLE) * 1000 + 0.5) / 1000.0 AS width_adjustment FROM g),
q AS (
  SELECT *, greatest(0.0, floor(coalesce(nx - 36.0 - (x - 36.0) - (padding_left + padding_right) - 1.0, 540.0 - (x - 36.0) - (padding_left + padding_right)) * 1000 + 0.5) / 1000.0) AS budget,
    greatest(0.0, floor((width + width_adjustment) * 1000 + 0.5) / 1000.0) AS own, CASE WHEN length(t) > 1 THEN font_size * 0.1 * length(t) ELSE font_size * 0.05 END AS lowest FROM p),
f AS (SELECT *, CASE WHEN own > 0 AND own >= lowest THEN own ELSE floor(length(t) * font_size * 0.5 * 1000 + 0.5) / 1000.0 END AS wanted FROM q)
SELECT doc_id, page_no, line_no, round(sum(padding_left), 6) AS padding_left, round(sum(padding_right), 6) AS padding_right, round(sum(width_adjustment), 6) AS width_adjustment,
  round(sum(CASE WHEN budget > 0 THEN least(wanted, budget) ELSE wanted END), 6) AS final_width
FROM f GROUP BY doc_id, page_no, line_no
""",
    "paragraph_glue": WORDS_SQL
    + f""",
r AS (SELECT doc_id, page_no, line_no, word_no, x, width, font_size, CASE (line_no + word_no) % 7 WHEN 2 THEN text || '-' WHEN 4 THEN '(' || text WHEN 5 THEN text || ' ' ELSE text END AS t FROM words),
b AS (SELECT *, lag(t) OVER w AS pt, x - (lag(x) OVER w + lag(width) OVER w) AS gap, (font_size + lag(font_size) OVER w) / 2 AS size, lead(t) OVER w AS nt FROM r WINDOW w AS (PARTITION BY doc_id, page_no, line_no ORDER BY word_no)),
g AS (
  SELECT *, CASE WHEN pt IS NULL THEN ''
    WHEN rtrim(pt) = '' OR ltrim(t) = '' OR regexp_matches(rtrim(pt), '-$') OR regexp_matches(rtrim(pt), '{_OPEN}$') OR regexp_matches(ltrim(t), '^(?:{_CLOSE}|{_TIGHT})') OR gap <= size * 0.12 THEN ''
    WHEN regexp_matches(pt, '\\s$') OR regexp_matches(t, '^\\s') OR gap >= greatest(0.6, size * 0.28) OR (regexp_matches(rtrim(pt), '{_WORDY}$') AND regexp_matches(ltrim(t), '^{_WORDY}')) THEN ' ' ELSE '' END AS between_ FROM b)
SELECT doc_id, page_no, line_no, md5(string_agg(between_ || CASE WHEN nt IS NOT NULL THEN regexp_replace(trim(t), '-$', '') ELSE trim(t) END, '' ORDER BY word_no)) AS text_md5
FROM g GROUP BY doc_id, page_no, line_no
""",
    "reader_items": """
WITH o AS (
  SELECT o_orderkey AS k, o_orderpriority AS t, CASE WHEN o_orderkey % 3 = 1 THEN 0.0 ELSE 2.0 END AS a, CASE o_orderkey % 3 WHEN 1 THEN 3.0 WHEN 2 THEN 2.0 ELSE 0.0 END AS b,
    CASE WHEN o_orderkey % 4 = 0 THEN 1.0 WHEN o_orderkey % 4 = 1 THEN 12.0 ELSE o_orderkey % 20 + 3.0 END AS raw, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 90 AS DOUBLE) END AS w, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 11 AS DOUBLE) END AS h FROM orders),
s AS (SELECT *, CASE WHEN raw <= 2 AND coalesce(h, 0) >= 4 THEN h ELSE raw END AS size, sqrt(a * a + b * b) AS sc FROM o),
b AS (SELECT *, coalesce(w, length(t) * size * 0.6 * sc) AS bw, coalesce(h, size * sc) AS bh, degrees(atan2(b, a)) AS turn FROM s)
SELECT k AS id, CAST(k % 500 AS DOUBLE) AS x, CAST(k % 700 AS DOUBLE) AS y, round(CASE WHEN k % 3 = 1 THEN bh ELSE bw END, 6) AS width, round(CASE WHEN k % 3 = 1 THEN bw ELSE bh END, 6) AS height, CAST(size AS DOUBLE) AS font_size, round(turn, 6) AS rotation,
  CASE k % 3 WHEN 0 THEN 700 WHEN 1 THEN 400 ELSE 300 END AS font_weight, CASE WHEN k % 3 = 1 THEN 'italic' ELSE 'normal' END AS font_style,
  'rgba(' || (k % 256) || ', ' || (k % 100) || ', ' || (k % 7) || ', ' || printf('%.3f', (k % 256) / 255.0) || ')' AS color,
  CAST(CASE WHEN abs(d) < 1 THEN 0 WHEN abs(abs(d) - 90) <= 1 THEN sign(d) * 90 ELSE 0 END AS DOUBLE) AS turn
FROM (SELECT *, k % 1000 - 360 * floor((k % 1000 + 180) / 360.0) AS d FROM b)
""",
    "repaired_sizes": """
WITH g AS (SELECT l_suppkey AS id, l_quantity AS q, CASE WHEN l_quantity % 4 = 0 THEN 1.0 ELSE l_quantity END AS size, CASE WHEN l_quantity % 3 = 0 THEN 1.0 ELSE l_quantity * 0.5 END AS h FROM lineitem),
r AS (SELECT *, CASE WHEN size > 2 THEN size WHEN h >= 4 THEN h WHEN q % 6 >= 3 THEN (q % 6) * 1.8 ELSE 10.0 END AS raw FROM g),
s AS (SELECT id, greatest(1.0, floor(greatest(1.0, raw) * 0.875 * 1000 + 0.5) / 1000.0) AS size, q % 7 = 0 OR (size <= 1.25 AND h <= 1.25) OR (q % 5 = 0 AND size <= 2) AS junk FROM r)
SELECT id, junk, count(*) AS n, round(sum(size), 6) AS sizes FROM s GROUP BY id, junk
""",
    "font_scales": WORDS_SQL
    + """,
c AS (SELECT doc_id, page_no, line_no, word_no, font_size, font_family, unnest(string_split(text, '')) AS ch, unnest(range(len(string_split(text, '')))) AS i FROM words),
g AS (SELECT *, font_size * CASE WHEN line_no % 2 = 0 THEN 0.5 ELSE 0.375 END AS h, CASE font_family WHEN 'Helvetica' THEN 0.718 WHEN 'TimesNewRomanPS-BoldMT' THEN 0.662 ELSE 0.66 END AS cap FROM c WHERE trim(ch) <> ''),
r AS (SELECT doc_id, page_no, font_family, greatest(0.1, least(1.0, h / (font_size * cap))) AS ratio, row_number() OVER (PARTITION BY doc_id, page_no, font_family ORDER BY line_no, word_no, i) AS nth FROM g),
m AS (SELECT doc_id, page_no, font_family, quantile_cont(ratio, 0.5) AS med, count(*) AS n FROM r WHERE nth <= 256 GROUP BY doc_id, page_no, font_family)
SELECT doc_id, page_no, font_family AS font_name, n, round(CAST(greatest(CASE WHEN n >= 30 AND med < 0.75 THEN 0.6 ELSE 0.75 END, least(1.0, med)) AS DOUBLE), 9) AS scale FROM m
""",
    "lexical_lines": LINES_SQL
    + """,
dict AS (SELECT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM words) GROUP BY w HAVING count(*) >= 20),
st AS (SELECT DISTINCT substr(word, 1, i) AS start FROM (SELECT word, unnest(range(3, length(word) + 1)) AS i FROM dict)),
tk AS (SELECT doc_id, page_no, line_no, unnest(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' '), lambda t: length(t) >= 3 AND length(t) <= 24)) AS token FROM lines),
c AS (SELECT doc_id, page_no, line_no, count(*) AS n, count(start) AS good FROM tk LEFT JOIN st ON token = start GROUP BY doc_id, page_no, line_no)
SELECT lines.doc_id, lines.page_no, lines.line_no, coalesce(n, 0) AS n, coalesce(good, 0) AS good, coalesce(n, 0) >= 3 AND coalesce(good, 0) >= coalesce(n, 0) * 0.45 AS lexical
FROM lines LEFT JOIN c ON lines.doc_id = c.doc_id AND lines.page_no = c.page_no AND lines.line_no = c.line_no
""",
    "structures": LINES_SQL
    + """,
m AS (SELECT doc_id, page_no, CASE WHEN line_no % 5 = 1 THEN '2) ' || text ELSE text END AS text, CASE WHEN line_no % 9 = 4 THEN 30.0 ELSE font_size END AS fs FROM lines),
r AS (SELECT *, fs / avg(fs) OVER (PARTITION BY doc_id, page_no) AS ratio FROM m)
SELECT doc_id, page_no, CASE WHEN ratio >= 1.5 THEN 'header' WHEN regexp_matches(trim(text), '^[-•·]\\s|^\\d+[.)]\\s|^[a-z][.)]\\s|^[ivxIVX]+[.)]\\s') THEN 'list' ELSE 'paragraph' END AS structure, CASE WHEN ratio >= 2.0 THEN 1 WHEN ratio >= 1.75 THEN 2 WHEN ratio >= 1.5 THEN 3 END AS level, count(*) AS n
FROM r GROUP BY 1, 2, 3, 4
""",
    "web_font_search": f"""
WITH w AS (SELECT * FROM ({_WEB}) t(family, category)), q AS (SELECT unnest(['mono', 'SANS', 'serif', 'ora', 'zzz']) AS query)
SELECT family, category, query FROM w, q WHERE contains(lower(family), lower(query)) OR contains(lower(category), lower(query))
""",
    "split_blocks": _REGIONS.replace("\nsizes AS", "\nhm AS (SELECT doc_id, page_no, quantile_cont(font_size, 0.5) AS ms FROM lines GROUP BY doc_id, page_no),\nsizes AS")
    + """,
t0 AS (SELECT l2.* REPLACE (CASE WHEN line_no % 7 > 1 THEN '• ' || text ELSE text END AS text), font_size / ms AS ratio FROM l2 JOIN hm ON l2.doc_id = hm.doc_id AND l2.page_no = hm.page_no),
t1 AS (SELECT *, trim(text) <> '' AND length(trim(text)) <= 100 AND ratio >= 1.2 AND (font_weight > 450 OR (trim(text) = upper(trim(text)) AND regexp_matches(text, '[A-Z]'))) AS heading,
  regexp_matches(text, '^[•●○■□◆◇▪▫]\\s+|^[-–—]\\s+|^\\(?\\d+[.)\\]]\\s+|^\\(?[A-Za-z][.)\\]]\\s+|^\\(?[ivxIVX]+[.)\\]]\\s+') AS mark, top - lag(top + height) OVER w AS gap, abs(min_x - lag(min_x) OVER w) AS shift
  FROM t0 WINDOW w AS (PARTITION BY doc_id, page_no, region_no ORDER BY top, min_x, line_no)),
t2 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > greatest(4.0, mh * 0.8) OR (shift > greatest(10.0, mh * 1.2) AND gap > greatest(1.0, mh * 0.15)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, region_no ORDER BY top, min_x, line_no) - 1 AS paragraph_no FROM t1),
t3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, region_no, paragraph_no ORDER BY line_no) AS nth, count(*) OVER (PARTITION BY doc_id, page_no, region_no, paragraph_no) AS n, count(CASE WHEN mark THEN 1 END) OVER (PARTITION BY doc_id, page_no, region_no, paragraph_no) AS marks FROM t2),
t4 AS (SELECT *, max(CASE WHEN nth = 1 AND heading THEN 1 ELSE 0 END) OVER p AS headed, min(CASE WHEN mark THEN nth END) OVER p AS first_mark FROM t3 WINDOW p AS (PARTITION BY doc_id, page_no, region_no, paragraph_no))
SELECT doc_id, page_no, region_no, paragraph_no, CASE WHEN n >= 2 AND (headed = 1 OR (first_mark = 2 AND marks >= 2)) AND nth > 1 THEN 1 ELSE 0 END AS part, count(*) AS n_lines, count(CASE WHEN mark THEN 1 END) AS n_markers
FROM t4 GROUP BY 1, 2, 3, 4, 5
""",
}
