"""Text queries: cleaning, respacing, lists, scripts, quality, dictionary evidence.

The raw texts hold few of the cases, so each query decorates its rows by line or word number, and its SQL does the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..operators import documents as D
from ..sources.typesetter import LINES_SQL, WORDS_SQL
from .layout import lines_and_words, words_of


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where("line <> ''")


def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("   "), "line", F.lit("\t \x07"))).when(F.col("line_no") % 5 == 1, F.concat("line", F.lit(" (   note   ) ;"))).when(F.col("line_no") % 5 == 2, F.concat("line", F.lit("   . www.x.org   ,"))).otherwise(F.concat("line", F.lit("   ,")))
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.md5(X.sanitize(raw)).alias("clean_md5"))


def respace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines, with words run together, torn apart and mixed with numbers before and after them."""
    line = F.split("line", " ")
    a, b, n = F.coalesce(F.get(line, F.lit(0)), F.lit("")), F.coalesce(F.get(line, F.lit(1)), F.lit("")), F.col("line_no") % 4
    raw = F.when(n == 0, F.concat(F.lower(a), F.initcap(b), F.lit(" AB123 "), "line")).when(n == 1, F.concat(F.lit("Number ab c def of "), "line")).when(n == 2, F.concat(F.lit("toParis "), "line", F.lit(" ZRH 815"))).otherwise(F.col("line"))
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.md5(X.respace(raw)).alias("spaced_md5"))


def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    escaped = X.escape_html(F.col("html"))
    return pages.select("page_id", F.length(escaped).cast("long").alias("n_chars"), F.md5(escaped).alias("escaped_md5"))


def glyph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" ​"), "line", F.lit("  ﻿x "))
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.md5(X.normalize_glyphs(raw)).alias("text_md5"))


def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines behind markers of all kinds; items run on while they are indented, lines before the first marker drop out."""
    n = F.col("line_no")
    mark = F.when(n % 8 == 0, "• ").when(n % 8 == 2, "- ").when(n % 8 == 3, "  (12) ").when(n % 8 == 5, "iv. ").when(n % 8 == 6, "b) ").otherwise("")
    rows = _lines(spark, sf_dir).withColumn("marked", F.concat(mark, "line")).withColumn("indent", F.when(n % 8 == 4, 10.0).otherwise(0.0))
    kind = X.list_marker(F.col("marked"))
    return D.list_items(rows.select("doc_id", "line_no", "indent", kind.alias("kind"), X.strip_marker(F.col("marked")).alias("text"), X.is_list_item(F.col("marked")).alias("plain")))


def script_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 7 == 1, F.translate("text", "aeionrst", "αειονρστ")).when(F.col("doc_id") % 7 == 3, F.translate("text", "aeionrst", "аеионрст")).when(F.col("doc_id") % 7 == 5, F.translate("text", "aeionrst ", "漢字東京大学日本 ")).otherwise(F.col("text"))
    counts = X.script_counts(F.col("t"))
    rows = _documents(spark, sf_dir).select("doc_id", text.alias("t")).select("doc_id", *[c.cast("long").alias(k) for k, c in counts.items()])
    return rows.withColumn("script", X.dominant_script({k: F.col(k) for k in counts}))


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = words_of(spark, sf_dir).withColumn("text", F.when((F.col("doc_id") % 3 == 0) & (F.col("word_no") % 2 == 0), F.substring("text", 1, 1)).otherwise(F.col("text")))
    return D.text_quality(items).withColumn("score", F.round("score", 9))


def pair_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir).where(F.col("text").rlike("^[A-Za-z]{2,20}$"))
    rows = words.groupBy("text").agg(F.count("*").alias("n"))
    return rows.select("text", "n", F.round(W.word_likelihood(F.col("text")), 9).alias("likelihood"), W.ends_with_suffix(F.col("text")).alias("suffix"), W.has_valid_pattern(F.col("text")).alias("valid"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of neighbouring words of all lines with their number in the line."""
    lines = _lines(spark, sf_dir).select(F.split("line", " ").alias("w"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b"), i.alias("i")))
    return lines.where("size(w) >= 2").select(F.explode(pairs).alias("p")).select("p.*").where("a <> '' and b <> ''")


def predicted_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a word ends between neighbours, for gaps that follow from their place in the line; equal cases are judged once."""
    rows = _neighbours(spark, sf_dir).groupBy("a", "b", (F.col("i") % 9).alias("step")).agg(F.count("*").alias("n"))
    a, b = F.col("a"), F.col("b")
    p = W.predict_break(a, F.substring(b, 1, 1), F.col("step") / 5.0 - 0.2)
    rows = rows.select("a", "b", "step", "n", p.alias("p"), (F.round(W.join_gain(F.substring(a, 1, 12), F.substring(b, 1, 12)), 9) + 0.0).alias("gain"))
    return rows.groupBy("a", "b", "gain", "p.breaks", F.round("p.confidence", 9).alias("confidence"), "p.reason").agg(F.sum("n").alias("n"))


def split_merged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbouring words glued together and cut again by a dictionary of the corpus."""
    dictionary = W.frequent_words(words_of(spark, sf_dir))
    tokens = _neighbours(spark, sf_dir).groupBy(F.concat("a", "b").alias("token")).agg(F.count("*").alias("n"))
    return W.split_merged(tokens, dictionary).select("token", "fixed", "n")


def join_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbouring words of letters only."""
    dictionary = W.frequent_words(words_of(spark, sf_dir))
    pairs = _neighbours(spark, sf_dir).select(F.lower("a").alias("l"), F.lower("b").alias("r")).where("l rlike '^[a-z]+$' and r rlike '^[a-z]+$'").groupBy("l", "r").agg(F.count("*").alias("n"))
    return W.join_score(pairs, dictionary)


def line_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft hyphens at line ends: which lines go on in the next, and the text without the hyphen."""
    lines, _ = lines_and_words(spark, sf_dir)
    text = F.when(F.col("line_no") % 3 == 1, F.concat("text", F.lit("a­"))).when(F.col("line_no") % 3 == 2, F.concat(F.lit("lower"), "text", F.lit(" Re"))).otherwise(F.concat(F.lit("then "), "text"))
    rows = lines.select("doc_id", "line_no", text.alias("text"))
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("line_no"))
    join = F.when(X.hyphen_joins(before, F.col("text")), "hyphenation").when(X.continues(before, F.col("text")), "continuation").otherwise("none")
    return rows.select("doc_id", "line_no", join.alias("join"), F.md5(X.without_soft_hyphen(F.col("text"))).alias("text_md5"))


QUERIES = {f.__name__: f for f in (sanitize, respace, escape_html, glyph_text, list_markers, script_vote, text_quality, pair_likelihood, predicted_breaks, split_merged_words, join_scores, line_joins)}

_LINES = """
WITH l AS (
  SELECT * FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no FROM documents) WHERE line <> '')
"""
_PAIRS = "CASE lower({p}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in W.PAIR_SCORES.items()) + " ELSE 0.4 END"
_SUFFIX = ".(" + "|".join(W.SUFFIXES) + ")$"


def _likelihood(c: str) -> str:
    return f"CASE WHEN length({c}) < 2 THEN 0.5 ELSE list_sum(list_transform(range(1, length({c})), lambda i: CAST({_PAIRS.format(p=f'substr({c}, i, 2)')} AS DOUBLE))) / (length({c}) - 1) END"


def _escape(c: str) -> str:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        c = f"replace({c}, '{raw}', '{name}')"
    return c


def _replace(c: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return c


_TIDY = _replace("edged", ("([(\\[{‘“\"'])\\s{2,}", "\\1"), ("\\s{2,}([)\\]}’”\"'])", "\\1"), (r"\s{2,}([,.;:!?])", "\\1"))
_NEIGHBOURS = """,
ws AS (SELECT string_split(line, ' ') AS w FROM l WHERE len(string_split(line, ' ')) >= 2),
ix AS (SELECT w, unnest(range(1, len(w))) AS i FROM ws),
nb AS (SELECT w[i] AS a, w[i + 1] AS b, i - 1 AS i FROM ix WHERE w[i] <> '' AND w[i + 1] <> '')
"""
_DICTIONARY = """,
dict AS (SELECT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM words) GROUP BY w HAVING count(*) >= 20)
"""

ORACLES = {
    "sanitize": _LINES
    + rf""",
r AS (SELECT doc_id, line_no, CASE line_no % 5 WHEN 0 THEN '   ' || line || chr(9) || ' ' || chr(7) WHEN 1 THEN line || ' (   note   ) ;' WHEN 2 THEN line || '   . www.x.org   ,' ELSE line || '   ,' END AS raw FROM l),
o AS (SELECT doc_id, line_no, regexp_replace(raw, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g') AS o FROM r),
e AS (SELECT *, CASE WHEN regexp_matches(o, '^[ \t]{{2,}}|[ \t]{{2,}}$') AND regexp_replace(regexp_replace(o, '^[ \t]+', ''), '[ \t]+$', '') <> ''
  THEN regexp_replace(regexp_replace(o, '^[ \t]+', ''), '[ \t]+$', '') ELSE o END AS edged FROM o)
SELECT doc_id, line_no, md5(CASE WHEN regexp_matches(lower(o), 'https?://|www\.') THEN o ELSE {_TIDY} END) AS clean_md5 FROM e
""",
    "escape_html": f"SELECT page_id, length({_escape('html')}) AS n_chars, md5({_escape('html')}) AS escaped_md5 FROM pages",
    "glyph_text": _LINES + "SELECT doc_id, line_no, md5(trim(regexp_replace(replace(replace(' ' || chr(8203) || line || '  ' || chr(65279) || 'x ', chr(8203), ''), chr(65279), ''), '\\s+', ' ', 'g'))) AS text_md5 FROM l",
    "list_markers": _LINES
    + r""",
m AS (
  SELECT doc_id, line_no, CASE line_no % 8 WHEN 0 THEN '• ' WHEN 2 THEN '- ' WHEN 3 THEN '  (12) ' WHEN 5 THEN 'iv. ' WHEN 6 THEN 'b) ' ELSE '' END || line AS marked, CASE WHEN line_no % 8 = 4 THEN 10.0 ELSE 0.0 END AS indent FROM l),
k AS (
  SELECT *, CASE WHEN regexp_matches(ltrim(marked), '^[•●○■□◆◇▪▫]\s+') OR regexp_matches(ltrim(marked), '^[-–—]\s+') THEN 'ul'
    WHEN regexp_matches(ltrim(marked), '^\(?\d+[.)\]]\s+') OR regexp_matches(ltrim(marked), '^\(?[A-Za-z][.)\]]\s+') OR regexp_matches(ltrim(marked), '^\(?[ivxIVX]+[.)\]]\s+') THEN 'ol' END AS kind,
    regexp_matches(trim(marked), '^[-•·]\s|^\d+[.)]\s|^[a-z][.)]\s|^[ivxIVX]+[.)]\s') AS plain,
    repeat(' ', length(marked) - length(ltrim(marked))) ||
    CASE WHEN regexp_matches(ltrim(marked), '^[•●○■□◆◇▪▫]\s+') THEN regexp_replace(ltrim(marked), '^[•●○■□◆◇▪▫]\s+', '')
      WHEN regexp_matches(ltrim(marked), '^[-–—]\s+') THEN regexp_replace(ltrim(marked), '^[-–—]\s+', '')
      WHEN regexp_matches(ltrim(marked), '^\(?\d+[.)\]]\s+') THEN regexp_replace(ltrim(marked), '^\(?\d+[.)\]]\s+', '')
      WHEN regexp_matches(ltrim(marked), '^\(?[A-Za-z][.)\]]\s+') THEN regexp_replace(ltrim(marked), '^\(?[A-Za-z][.)\]]\s+', '')
      WHEN regexp_matches(ltrim(marked), '^\(?[ivxIVX]+[.)\]]\s+') THEN regexp_replace(ltrim(marked), '^\(?[ivxIVX]+[.)\]]\s+', '') ELSE ltrim(marked) END AS text FROM m),
b AS (SELECT *, min(indent) OVER (PARTITION BY doc_id) AS base, count(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS seen FROM k),
s AS (SELECT *, sum(CASE WHEN kind IS NOT NULL OR indent - base < 6.0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS item FROM b WHERE seen > 0)
SELECT doc_id, item - min(item) OVER (PARTITION BY doc_id) AS item_no, max(kind) AS kind, count(*) AS n_lines, count(CASE WHEN plain THEN 1 END) AS n_plain, md5(trim(string_agg(text, ' ' ORDER BY line_no))) AS text_md5
FROM s GROUP BY doc_id, item
""",
    "script_vote": """
WITH t AS (
  SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN translate(text, 'aeionrst', 'αειονρστ') WHEN 3 THEN translate(text, 'aeionrst', 'аеионрст') WHEN 5 THEN translate(text, 'aeionrst ', '漢字東京大学日本 ') ELSE text END AS t FROM documents),
c AS (
  SELECT doc_id, length(t) AS n, length(regexp_replace(t, '[^\\x{41}-\\x{7A}\\x{C0}-\\x{24F}]', '', 'g')) AS latin, length(regexp_replace(t, '[^\\x{400}-\\x{52F}]', '', 'g')) AS cyrillic,
    length(regexp_replace(t, '[^\\x{370}-\\x{3FF}]', '', 'g')) AS greek, length(regexp_replace(t, '[^\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3040}-\\x{30FF}\\x{31F0}-\\x{31FF}\\x{AC00}-\\x{D7AF}]', '', 'g')) AS cjk,
    0 AS arabic, 0 AS hebrew, 0 AS devanagari FROM t),
o AS (SELECT *, n - latin - cyrillic - greek - cjk AS other FROM c)
SELECT doc_id, latin, cyrillic, greek, cjk, CAST(arabic AS BIGINT) AS arabic, CAST(hebrew AS BIGINT) AS hebrew, CAST(devanagari AS BIGINT) AS devanagari, other,
  CASE greatest(latin, cyrillic, greek, cjk, other) WHEN 0 THEN 'latin' WHEN latin THEN 'latin' WHEN cyrillic THEN 'cyrillic' WHEN greek THEN 'greek' WHEN cjk THEN 'cjk' ELSE 'other' END AS script
FROM o
""",
    "text_quality": WORDS_SQL
    + r""",
i AS (SELECT doc_id, line_no, word_no, CASE WHEN doc_id % 3 = 0 AND word_no % 2 = 0 THEN substr(text, 1, 1) ELSE text END AS t FROM words),
d AS (
  SELECT doc_id, trim(regexp_replace(string_agg(t, ' ' ORDER BY line_no, word_no), '\s+', ' ', 'g')) AS joined, count(*) AS n_items,
    count(CASE WHEN regexp_matches(t, '[A-Za-z]') THEN 1 END) AS alpha_items, count(CASE WHEN regexp_matches(t, '^[A-Za-z]{1,2}$') THEN 1 END) AS short_items FROM i GROUP BY doc_id),
t AS (
  SELECT *, list_filter(string_split(joined, ' '), lambda w: regexp_matches(w, '^[A-Za-z]+$')) AS alpha,
    len(regexp_extract_all(joined, '(?:\b[A-Za-z]\b\s+){4,}\b[A-Za-z]\b')) AS singles, len(regexp_extract_all(joined, '\b[A-Za-z]{1,2}(?:\s+[A-Za-z]{1,2}){4,}\b')) AS fragments FROM d),
r AS (
  SELECT *, len(list_filter(alpha, lambda w: length(w) >= 3)) / CAST(greatest(1, len(alpha)) AS DOUBLE) AS long_ratio, len(list_filter(alpha, lambda w: length(w) <= 2)) / CAST(greatest(1, len(alpha)) AS DOUBLE) AS short_ratio,
    least(1.0, singles * 0.25 + fragments * 0.15 + short_items / CAST(greatest(1, alpha_items) AS DOUBLE) * 0.9 + least(1.0, n_items / CAST(greatest(1, length(replace(joined, ' ', ''))) AS DOUBLE)) * 0.75) AS penalty FROM t)
SELECT doc_id, n_items, round(CAST(CASE WHEN length(joined) < 80 THEN 1.0 ELSE greatest(0.0, least(1.0, long_ratio - short_ratio * 0.6 - penalty)) END AS DOUBLE), 9) AS score FROM r
""",
    "pair_likelihood": WORDS_SQL
    + f""",
w AS (SELECT text, count(*) AS n FROM words WHERE regexp_matches(text, '^[A-Za-z]{{2,20}}$') GROUP BY text)
SELECT text, n, round({_likelihood("text")}, 9) AS likelihood, regexp_matches(lower(text), '{_SUFFIX}') AS suffix,
  length(text) < 2 OR NOT (regexp_matches(lower(text), '^[bcdfghjklmnpqrstvwxyz]{{4,}}') OR regexp_matches(lower(text), '[aeiou]{{4,}}') OR regexp_matches(lower(text), '[bcdfghjklmnpqrstvwxyz]{{5,}}')) AS valid
FROM w
""",
    "predicted_breaks": _LINES
    + _NEIGHBOURS
    + f""",
p AS (SELECT a, b, i % 9 AS step, (i % 9) / 5.0 - 0.2 AS gap, count(*) AS n FROM nb GROUP BY a, b, i % 9),
c AS (SELECT *, right(a, 1) AS x, left(b, 1) AS y, left(a, 12) AS la, left(b, 12) AS rb FROM p),
s AS (SELECT *, regexp_matches(x, '[a-z]') AND regexp_matches(y, '[A-Z]') AS cs, {_PAIRS.format(p="x || y")} AS pair FROM c),
k AS (SELECT *, gap * 0.6 + (1 - pair) * 0.4 AS score FROM s),
f AS (
  SELECT *, CASE WHEN regexp_matches(x, '\\s') OR regexp_matches(y, '\\s') THEN 0 WHEN gap >= 1.5 THEN 1 WHEN gap <= 0 THEN 2
    WHEN cs AND NOT regexp_matches(lower(a), '^({"|".join(W.PREFIXES)})') AND lower(a) NOT IN ('i', 'e') THEN 3
    WHEN length(a) >= 2 AND cs AND (regexp_matches(lower(a), '(son|ton|man|ley|ell|ard|old|ohn|ick|ert|ark|ane|ine|ice|ace)$') OR length(a) >= 3) THEN 4
    WHEN length(a) >= 4 AND regexp_matches(lower(a), '{_SUFFIX}') AND gap >= 0.3 THEN 5 ELSE 6 END AS w,
    regexp_matches(right(la, 1), '[a-z]') AND regexp_matches(left(rb, 1), '[A-Z]') AS cs2 FROM k),
j AS (SELECT a, b, n, CASE w WHEN 0 THEN false WHEN 2 THEN false WHEN 6 THEN score >= 0.45 ELSE true END AS breaks,
  round(CAST(CASE w WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.95 WHEN 3 THEN 0.85 WHEN 4 THEN 0.8 WHEN 5 THEN 0.75 ELSE least(0.9, 0.5 + (CASE WHEN score >= 0.45 THEN score ELSE 1 - score END) * 0.4) END AS DOUBLE), 9) AS confidence,
  CASE w WHEN 0 THEN 'geometric' WHEN 1 THEN 'geometric' WHEN 2 THEN 'geometric' WHEN 3 THEN 'capitalization' WHEN 4 THEN 'pattern' WHEN 5 THEN 'linguistic'
    ELSE CASE WHEN (score >= 0.45 AND pair < 0.5) OR (score < 0.45 AND pair >= 0.5) THEN 'linguistic' ELSE 'geometric' END END AS reason,
  round({_likelihood("(la || rb)")} + CASE WHEN regexp_matches(lower(la || rb), '{_SUFFIX}') THEN 0.1 ELSE 0.0 END - CASE WHEN cs2 THEN 0.3 ELSE 0.0 END - ({_likelihood("la")} + {_likelihood("rb")}) / 2, 9) + 0.0 AS gain
FROM f)
SELECT a, b, gain, breaks, confidence, reason, CAST(sum(n) AS BIGINT) AS n FROM j GROUP BY a, b, gain, breaks, confidence, reason
""",
    "split_merged_words": WORDS_SQL
    + _DICTIONARY
    + """,
l AS (SELECT line FROM raw_lines WHERE line <> '')
"""
    + _NEIGHBOURS
    + """,
t AS (SELECT a || b AS token, count(*) AS n FROM nb GROUP BY a || b),
u AS (SELECT token FROM t WHERE regexp_matches(token, '^[A-Za-z]{6,}$') AND lower(token) NOT IN (SELECT word FROM dict)),
c AS (SELECT token, unnest(range(3, length(token) - 2)) AS cut FROM u),
b AS (SELECT token, max(cut) AS cut FROM c JOIN dict x ON lower(substr(token, 1, cut)) = x.word JOIN dict y ON lower(substr(token, cut + 1)) = y.word GROUP BY token)
SELECT t.token, CASE WHEN cut IS NULL THEN t.token ELSE substr(t.token, 1, cut) || ' ' || substr(t.token, cut + 1) END AS fixed, n FROM t LEFT JOIN b ON t.token = b.token
""",
    "join_scores": WORDS_SQL
    + _DICTIONARY
    + """,
s AS (SELECT DISTINCT substr(word, 1, i) AS p FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM dict)),
l AS (SELECT line FROM raw_lines WHERE line <> '')
"""
    + _NEIGHBOURS
    + """,
q AS (SELECT lower(a) AS l, lower(b) AS r, count(*) AS n FROM nb GROUP BY 1, 2),
k AS (SELECT * FROM q WHERE regexp_matches(l, '^[a-z]+$') AND regexp_matches(r, '^[a-z]+$'))
SELECT l, r, n, CAST(CASE WHEN l || r IN (SELECT word FROM dict) THEN 0.95 WHEN l || r IN (SELECT p FROM s) THEN 0.7 WHEN l IN (SELECT word FROM dict) AND r IN (SELECT p FROM s) THEN 0.3
  WHEN length(l || r) >= 2 AND (regexp_matches(l || r, '^[bcdfghjklmnpqrstvwxyz]{4,}') OR regexp_matches(l || r, '[aeiou]{4,}') OR regexp_matches(l || r, '[bcdfghjklmnpqrstvwxyz]{5,}')) THEN 0.2 ELSE 0.4 END AS DOUBLE) AS score
FROM k
""",
    "line_joins": LINES_SQL
    + """,
t AS (SELECT doc_id, line_no, CASE line_no % 3 WHEN 1 THEN text || 'a' || chr(173) WHEN 2 THEN 'lower' || text || ' Re' ELSE 'then ' || text END AS text FROM lines),
p AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM t)
SELECT doc_id, line_no, CASE WHEN regexp_matches(prev, '[A-Za-z]' || chr(173) || '$') AND regexp_matches(text, '^[a-z]') THEN 'hyphenation'
  WHEN regexp_matches(prev, '[A-Z][a-z]{0,2}$') AND regexp_matches(text, '^[a-z]{3,}') THEN 'continuation' ELSE 'none' END AS join, md5(regexp_replace(text, chr(173) || '$', '')) AS text_md5
FROM p
""",
}
