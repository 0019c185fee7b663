"""Boundary queries: neighbouring words with their gaps, under each decider."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boundary as B
from ..operators import layout as L
from ..sources.typesetter import WORDS_SQL
from .layout import words_of


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with gaps from overlap to wide, and every so often a text that a decider treats in its own way."""
    i, n = F.col("word_no"), F.col("line_no") + F.col("word_no")
    special = {3: "www.a.org/x", 7: "12:", 11: "30", 15: "me@x.org", 19: "(", 21: ",", 23: "B", 25: "c", 27: "AB12", 29: "CD34", 31: "to", 33: "x."}
    text = F.col("text")
    for k, v in special.items():
        text = F.when((n % 41 == k) & (i % 2 == 1), F.lit(v)).otherwise(text)
    shift = F.when(n % 11 == 0, -4.0).when(n % 11 == 3, -1.5).when(n % 11 == 5, -2.75).when(n % 11 == 7, 6.0).otherwise(0.0)
    return words_of(spark, sf_dir).withColumn("text", text).withColumn("x", F.col("x") + shift)


def pairs_of(words: DataFrame) -> DataFrame:
    w = Window.partitionBy(*L.LINE).orderBy("word_no")
    nxt = lambda c: F.lead(c).over(w)
    rows = words.select(
        *L.LINE, "word_no", F.trim("text").alias("a"), F.trim(nxt("text")).alias("b"), (nxt("x") - (F.col("x") + F.col("width"))).alias("gap"), F.greatest(F.lit(1.0), (F.col("font_size") + nxt("font_size")) / 2).alias("size")
    )
    return rows.where("b is not null")


#: The line model that these queries share: a character is 5.5 wide, words part at 0.6 characters.
CHAR, WORD_BREAK = 5.5, 0.6


def _decided(spark: SparkSession, sf_dir: str, decide) -> DataFrame:
    rows = pairs_of(_words(spark, sf_dir))
    rows = rows.select(*L.LINE, decide(F.col("a"), F.col("b"), F.col("gap"), F.col("size")).alias("d"))
    return rows.select(*L.LINE, "d.*")


def boundary_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decided(spark, sf_dir, lambda a, b, g, s: B.basic(a, b, g, s, F.lit(CHAR), F.lit(WORD_BREAK)))
    return rows.groupBy(*L.LINE, "type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"), F.round(F.sum("threshold"), 6).alias("threshold"))


def boundary_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the profile that splits at case, capitals and digits."""
    rows = _decided(spark, sf_dir, lambda a, b, g, s: B.rule(a, b, g, s, F.lit(CHAR), F.lit(WORD_BREAK), "latin-words"))
    return rows.groupBy(*L.LINE, "type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"), F.round(F.sum("threshold"), 6).alias("threshold"))


def boundary_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair joins if it forms a word of the dictionary, here the words of five letters that contain ``an``."""
    word = lambda c: F.lower(c).rlike("^[a-z]{5}$") & F.lower(c).contains("an")
    rows = _decided(spark, sf_dir, lambda a, b, g, s: B.unified(a, b, g, s, F.lit(CHAR), F.lower(F.concat(a, b)).rlike("^[a-z]{6,9}$") & F.lower(a).contains("an"), word(a) & word(b)))
    return rows.groupBy("doc_id", "page_no", "reason", "space").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"), F.round(F.sum("threshold"), 6).alias("threshold"))


def space_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decided(spark, sf_dir, lambda a, b, g, s: B.statistical(a, b, g, s, F.lit(CHAR), F.lit(WORD_BREAK)))
    return rows.groupBy(*L.LINE, "space").agg(F.count("*").alias("n"), F.round(F.sum("threshold"), 6).alias("threshold"))


def line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put together again: a space where the rule decider says so."""
    words = _words(spark, sf_dir)
    w = Window.partitionBy(*L.LINE).orderBy("word_no")
    before = lambda c: F.lag(c).over(w)
    gap = F.col("x") - (before("x") + before("width"))
    size = F.greatest(F.lit(1.0), (F.col("font_size") + before("font_size")) / 2)
    rows = words.select(*L.LINE, "word_no", "text", F.trim(before("text")).alias("a"), gap.alias("gap"), size.alias("size"))
    kind = B.rule(F.col("a"), F.trim("text"), F.col("gap"), F.col("size"), F.lit(CHAR), F.lit(WORD_BREAK))["type"]
    rows = rows.withColumn("piece", F.when(F.col("a").isNotNull() & (kind == "space"), F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy(*L.LINE).agg(F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


def char_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character width of a line: the upper median of the clamped widths per character and one width per style."""
    words = words_of(spark, sf_dir)
    mean = F.avg("font_size").over(Window.partitionBy(*L.LINE))
    own = F.greatest(mean * 0.25, F.least(mean * 1.2, F.col("width") / F.length("text") * F.when(F.col("word_no") % 3 == 0, 1.25).otherwise(0.9)))
    rows = words.select(*L.LINE, own.alias("own"), F.struct("font_family", "font_size").alias("style"), (F.col("font_size") * 0.55).alias("styled"))
    found = rows.groupBy(*L.LINE).agg(F.collect_list("own").alias("own"), F.collect_set(F.struct("style", "styled")).alias("styles"))
    v = F.array_sort(F.concat("own", F.transform("styles", lambda s: s["styled"])))
    return found.select(*L.LINE, F.round(F.get(v, F.floor(F.size(v) / 2).cast("int")), 9).alias("char_width"))


def kmeans_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of each line in character widths: two centres and both thresholds."""
    pairs = pairs_of(_words(spark, sf_dir)).where("gap >= 0")
    rows = pairs.groupBy(*L.LINE).agg(F.array_sort(F.collect_list(F.col("gap") / CHAR)).alias("gaps"))
    rows = rows.withColumn("c", B.two_means(F.col("gaps")))
    c = F.col("c")
    return rows.select(
        *L.LINE, F.size("gaps").cast("long").alias("n"), F.round(F.least(c["c0"], c["c1"]), 9).alias("small"), F.round(F.greatest(c["c0"], c["c1"]), 9).alias("large"),
        F.round(B.word_break_threshold(F.col("gaps")), 9).alias("geometry"), F.round(B.word_break_threshold(F.col("gaps"), "statistical"), 9).alias("statistical"),
    )


QUERIES = {f.__name__: f for f in (boundary_basic, boundary_rule, boundary_unified, space_detector, line_text, char_widths, kmeans_thresholds)}

_TEXT = "CASE " + " ".join(f"WHEN (line_no + word_no) % 41 = {k} AND word_no % 2 = 1 THEN '{v}'" for k, v in ((3, "www.a.org/x"), (7, "12:"), (11, "30"), (15, "me@x.org"), (19, "("), (21, ","), (23, "B"), (25, "c"), (27, "AB12"), (29, "CD34"), (31, "to"), (33, "x."))) + " ELSE text END"
_PAIRS = (
    WORDS_SQL
    + f""",
m AS (
  SELECT doc_id, page_no, line_no, word_no, width, font_size, {_TEXT} AS text,
    x + CASE (line_no + word_no) % 11 WHEN 0 THEN -4.0 WHEN 3 THEN -1.5 WHEN 5 THEN -2.75 WHEN 7 THEN 6.0 ELSE 0.0 END AS x FROM words),
p0 AS (
  SELECT doc_id, page_no, line_no, word_no, trim(text) AS a, trim(lead(text) OVER w) AS b, lead(x) OVER w - (x + width) AS gap, greatest(1.0, (font_size + lead(font_size) OVER w) / 2) AS size
  FROM m WINDOW w AS (PARTITION BY doc_id, page_no, line_no ORDER BY word_no)),
p1 AS (SELECT *, CASE WHEN gap < 0 AND gap >= -0.25 * size THEN 0.0 ELSE gap END AS px FROM p0 WHERE b IS NOT NULL),
p AS (
  SELECT *, px / 5.5 AS ratio, regexp_matches(a, '[A-Za-z]$') AND regexp_matches(b, '^[A-Za-z]') AS alpha, regexp_matches(a, '[0-9]$') AND regexp_matches(b, '^[0-9]') AS digits,
    regexp_matches(a, '[0-9]:$') AND regexp_matches(b, '^[0-9]') AS clock, regexp_matches(a, '[a-z]$') AND regexp_matches(b, '^[A-Z]') AS cased,
    regexp_matches(a, '[:;,]$') AND regexp_matches(b, '^[A-Za-z0-9]') AS sep, regexp_matches(a, ':$') AND regexp_matches(b, '^[0-9]') AS colon, regexp_matches(b, '^[,.;:!?)]') AS punct,
    regexp_matches(lower(a), 'https?://|www\\.|://|/') OR regexp_matches(lower(b), 'https?://|www\\.|://|^/') OR (regexp_matches(a, '\\.$') AND regexp_matches(b, '^[A-Za-z0-9-]{{2,}}$'))
      OR regexp_matches(a, '\\.[A-Za-z]{{2,4}}$') OR (regexp_matches(b, '^[A-Za-z]{{2,4}}$') AND regexp_matches(a, '\\.$') AND length(a) >= 4) AS url,
    regexp_matches(a, '^[A-Za-z0-9._%+-]+$') AND regexp_matches(b, '^[A-Za-z0-9._%+-]+$') AND (contains(a, '.') OR contains(b, '.')) AS dotted, contains(a, '@') OR contains(b, '@') AS mail
  FROM p1)
"""
)
_SUMS = "count(*) AS n, round(sum(confidence), 6) AS confidence, round(sum(threshold), 6) AS threshold"
ORACLES = {
    "boundary_basic": _PAIRS
    + f""",
t0 AS (SELECT *, CASE WHEN digits THEN 1.35 ELSE 0.6 END AS t FROM p),
t1 AS (SELECT * REPLACE (CASE WHEN sep AND NOT colon THEN least(t, 0.28) ELSE t END AS t) FROM t0),
t2 AS (SELECT * REPLACE (CASE WHEN length(a) >= 2 AND length(b) >= 2 AND alpha THEN least(t, 0.32) ELSE t END AS t) FROM t1),
d AS (
  SELECT doc_id, page_no, line_no, CASE WHEN px < 0 OR clock OR url OR punct OR ratio < t THEN 'join' ELSE 'space' END AS type,
    CAST(CASE WHEN px < 0 THEN 0.9 WHEN clock OR url OR punct THEN 0.95 ELSE greatest(0.0, least(1.0, 0.55 + least(1.5, abs(ratio - t)) / 1.5)) END AS DOUBLE) AS confidence,
    CAST(CASE WHEN px < 0 OR clock OR url OR punct THEN 0.6 ELSE t END AS DOUBLE) AS threshold FROM t2)
SELECT doc_id, page_no, line_no, type, {_SUMS} FROM d GROUP BY doc_id, page_no, line_no, type
""",
    "boundary_rule": _PAIRS
    + f""",
t0 AS (SELECT *, CASE WHEN digits THEN 1.35 ELSE 0.6 END AS t, alpha AND (regexp_matches(a, '^[A-Za-z]$') OR regexp_matches(b, '^[A-Za-z]$')) AND ratio < 1.25 AS single,
  cased AND NOT regexp_matches(a, '^[ei]$') AND ratio >= 0.33 AS split_case, regexp_matches(a, '^[A-Z0-9]{{3,}}$') AND regexp_matches(b, '^[A-Z0-9]{{3,}}$') AND ratio >= 0.36 AS split_caps FROM p),
t1 AS (SELECT *, ((regexp_matches(a, '[0-9]$') AND regexp_matches(b, '^[A-Za-z]')) OR (regexp_matches(a, '[A-Za-z]$') AND regexp_matches(b, '^[0-9]'))) AND ratio >= 0.33 AS split_mixed,
  CASE WHEN sep AND NOT colon THEN least(t, 0.28) ELSE t END AS u FROM t0),
t2 AS (SELECT * REPLACE (CASE WHEN length(a) >= 3 AND length(b) >= 3 AND alpha THEN least(u, 0.32) ELSE u END AS u) FROM t1),
k AS (SELECT *, CASE WHEN px < 0 THEN 1 WHEN clock OR url THEN 2 WHEN single THEN 3 WHEN punct THEN 2 WHEN split_case THEN 4 WHEN split_caps THEN 5 WHEN split_mixed THEN 6 ELSE 7 END AS w FROM t2),
d AS (
  SELECT doc_id, page_no, line_no, CASE WHEN w IN (4, 5, 6) OR (w = 7 AND ratio >= u) THEN 'space' ELSE 'join' END AS type,
    CAST(CASE w WHEN 1 THEN 0.9 WHEN 2 THEN 0.95 WHEN 3 THEN 0.9 WHEN 4 THEN 0.7 WHEN 5 THEN 0.75 WHEN 6 THEN 0.7 ELSE greatest(0.0, least(1.0, 0.55 + least(1.5, abs(ratio - u)) / 1.5)) END AS DOUBLE) AS confidence,
    CAST(CASE w WHEN 3 THEN 1.25 WHEN 4 THEN 0.33 WHEN 5 THEN 0.36 WHEN 6 THEN 0.33 WHEN 7 THEN u ELSE 0.6 END AS DOUBLE) AS threshold FROM k)
SELECT doc_id, page_no, line_no, type, {_SUMS} FROM d GROUP BY doc_id, page_no, line_no, type
""",
    "boundary_unified": _PAIRS
    + f""",
f AS (
  SELECT *, regexp_matches(lower(a), 'https?://|www\\.|://') OR regexp_matches(lower(b), 'https?://|www\\.|://') OR (contains(lower(a), '/') AND regexp_matches(lower(b), '^[a-z0-9-]')) OR (regexp_matches(a, '\\.[A-Za-z]{{2,4}}$') AND regexp_matches(b, '^[A-Za-z0-9/]')) AS url2,
    regexp_matches(a, '^[A-Za-z0-9]$') AND regexp_matches(b, '^[A-Za-z0-9]$') AS single, length(a) >= 3 AND length(b) >= 3 AND alpha AS multi,
    regexp_matches(lower(a || b), '^[a-z]{{6,9}}$') AND contains(lower(a), 'an') AS joined,
    regexp_matches(lower(a), '^[a-z]{{5}}$') AND contains(lower(a), 'an') AND regexp_matches(lower(b), '^[a-z]{{5}}$') AND contains(lower(b), 'an') AS words2, CASE WHEN cased THEN 0.08 ELSE 0.15 END AS ct FROM p),
g AS (SELECT *, CASE WHEN words2 THEN least(ct, 0.1) ELSE ct END AS wt,
  CASE WHEN px < 0 THEN 'negative_gap' WHEN ratio >= 2.0 THEN 'large_gap' WHEN url2 THEN 'url_context' WHEN mail OR dotted THEN 'email_context' WHEN regexp_matches(b, '^[,.;:!?)\\]}}"'']+$') THEN 'punctuation_attach'
    WHEN regexp_matches(a, '^[(\\[{{"'']+$') THEN 'opening_punct' WHEN clock THEN 'time_pattern' WHEN single THEN 'single_char' WHEN digits THEN 'digit_sequence' WHEN multi AND joined THEN 'valid_word' WHEN multi THEN 'multi_token_alpha'
    WHEN length(a) <= 3 AND length(b) <= 3 AND alpha THEN 'short_alpha_pair' WHEN sep THEN 'after_separator' ELSE 'default' END AS reason FROM f),
d AS (
  SELECT doc_id, page_no, reason, CAST(CASE reason WHEN 'negative_gap' THEN 0.0 WHEN 'single_char' THEN 2.2 WHEN 'digit_sequence' THEN 1.35 WHEN 'valid_word' THEN ct WHEN 'multi_token_alpha' THEN wt WHEN 'short_alpha_pair' THEN 1.85 WHEN 'after_separator' THEN 0.28 WHEN 'default' THEN 0.85 ELSE 2.0 END AS DOUBLE) AS threshold,
    CAST(CASE reason WHEN 'negative_gap' THEN 0.95 WHEN 'large_gap' THEN 0.95 WHEN 'url_context' THEN 0.9 WHEN 'email_context' THEN 0.9 WHEN 'punctuation_attach' THEN 0.95 WHEN 'opening_punct' THEN 0.9 WHEN 'time_pattern' THEN 0.95 WHEN 'single_char' THEN 0.8
      WHEN 'digit_sequence' THEN 0.85 WHEN 'valid_word' THEN 0.9 WHEN 'multi_token_alpha' THEN 0.85 WHEN 'short_alpha_pair' THEN 0.75 WHEN 'after_separator' THEN 0.8 ELSE 0.7 END AS DOUBLE) AS confidence, ratio FROM g),
s AS (SELECT *, CASE WHEN reason = 'large_gap' THEN true WHEN reason IN ('single_char', 'digit_sequence', 'multi_token_alpha', 'short_alpha_pair', 'after_separator', 'default') THEN ratio >= threshold ELSE false END AS space FROM d)
SELECT doc_id, page_no, reason, space, {_SUMS} FROM s GROUP BY doc_id, page_no, reason, space
""",
    "space_detector": _PAIRS
    + """,
e AS (
  SELECT *, mail OR dotted OR (ends_with(a, '.') AND regexp_matches(b, '^[A-Za-z]{2,6}$')) AS email, length(a) >= 3 AND length(b) >= 3 AND alpha AS multi,
    regexp_matches(a, '^[A-Za-z0-9]$') AND regexp_matches(b, '^[A-Za-z0-9]$') AS single, regexp_matches(a, '^[A-Za-z]{1,3}$') AND regexp_matches(b, '^[A-Za-z]{1,3}$') AS tiny,
    regexp_matches(lower(b), '^(https?://|https?:|www\\.)') AND regexp_matches(a, '[A-Za-z0-9)]$') AS starts FROM p),
t1 AS (SELECT *, greatest(0.6, CASE WHEN digits THEN 1.35 ELSE 0.0 END, CASE WHEN email OR single THEN 2.2 ELSE 0.0 END) AS t FROM e),
t2 AS (SELECT * REPLACE (CASE WHEN multi THEN least(t, 0.15) WHEN tiny THEN greatest(t, 1.85) ELSE t END AS t) FROM t1),
t3 AS (SELECT * REPLACE (CASE WHEN sep THEN least(t, 0.28) ELSE t END AS t) FROM t2),
t4 AS (SELECT * REPLACE (CASE WHEN cased AND length(a) >= 2 AND length(b) >= 2 THEN least(t, 0.08) ELSE t END AS t) FROM t3),
t5 AS (SELECT * REPLACE (CASE WHEN alpha AND (lower(b) IN ('to','of','in','on','at','by','or','an','as','if','is') OR lower(a) IN ('to','of','in','on','at','by','or','an','as','if','is')) THEN least(t, 0.18) ELSE t END AS t) FROM t4),
d AS (
  SELECT doc_id, page_no, line_no, CASE WHEN px < 0 THEN false WHEN url THEN starts AND ratio >= 0.65 WHEN punct THEN false ELSE ratio >= t END AS space,
    CAST(CASE WHEN px < 0 THEN 0.6 WHEN url THEN CASE WHEN starts THEN 0.65 ELSE 0.6 END WHEN punct THEN 0.6 ELSE t END AS DOUBLE) AS threshold FROM t5)
SELECT doc_id, page_no, line_no, space, count(*) AS n, round(sum(threshold), 6) AS threshold FROM d GROUP BY doc_id, page_no, line_no, space
""",
    "line_text": _PAIRS
    + """,
t AS (
  SELECT doc_id, page_no, line_no, word_no + 1 AS word_no, CASE WHEN px < 0 OR clock OR url OR (alpha AND (regexp_matches(a, '^[A-Za-z]$') OR regexp_matches(b, '^[A-Za-z]$')) AND ratio < 1.25) OR punct THEN false
    ELSE ratio >= CASE WHEN length(a) >= 3 AND length(b) >= 3 AND alpha THEN 0.32 WHEN sep AND NOT colon THEN 0.28 WHEN digits THEN 1.35 ELSE 0.6 END END AS space FROM p),
l AS (SELECT m.doc_id, m.page_no, m.line_no, string_agg(CASE WHEN coalesce(space, false) THEN ' ' || text ELSE text END, '' ORDER BY m.word_no) AS text
  FROM m LEFT JOIN t ON m.doc_id = t.doc_id AND m.line_no = t.line_no AND m.word_no = t.word_no GROUP BY m.doc_id, m.page_no, m.line_no)
SELECT doc_id, page_no, line_no, md5(text) AS text_md5, length(text) AS n_chars FROM l
""",
    "char_widths": WORDS_SQL
    + """,
o AS (
  SELECT doc_id, page_no, line_no, font_family, font_size, greatest(mean * 0.25, least(mean * 1.2, width / length(text) * CASE WHEN word_no % 3 = 0 THEN 1.25 ELSE 0.9 END)) AS v
  FROM (SELECT *, avg(font_size) OVER (PARTITION BY doc_id, page_no, line_no) AS mean FROM words)),
a AS (SELECT doc_id, page_no, line_no, v FROM o UNION ALL SELECT doc_id, page_no, line_no, font_size * 0.55 FROM (SELECT DISTINCT doc_id, page_no, line_no, font_family, font_size FROM o)),
g AS (SELECT doc_id, page_no, line_no, list_sort(list(v)) AS vs FROM a GROUP BY doc_id, page_no, line_no)
SELECT doc_id, page_no, line_no, round(vs[1 + CAST(floor(len(vs) / 2.0) AS BIGINT)], 9) AS char_width FROM g
""",
}


def two_means_of(values: list[float]) -> tuple[float, float]:
    """The loop that ``kmeans_thresholds`` is tested against."""
    v = sorted(values)
    c0, c1 = v[0], v[-1]
    for _ in range(12):
        low, high = [x for x in v if abs(x - c0) <= abs(x - c1)], [x for x in v if abs(x - c0) > abs(x - c1)]
        n0, n1 = sum(low) / len(low) if low else c0, sum(high) / len(high) if high else c1
        if abs(n0 - c0) < 1e-3 and abs(n1 - c1) < 1e-3:
            break
        c0, c1 = n0, n1
    return c0, c1
