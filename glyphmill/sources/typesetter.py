"""Positioned words from plain text: the fallback source when only text is known.

A line of text is a line of the page, 60 to a page; a word is what stands between spaces.  Widths follow the number of
characters, x runs along the line with a gap after each word, y goes down with extra space after every fifth line; style
follows line and word numbers.  All coordinates are multiples of one half, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PAGE_HEIGHT

LINES_PER_PAGE = 60
CHAR, MARGIN, LEADING, EXTRA = 5.5, 36.0, 12.0, 6.0


def gap_after(word_no: Column) -> Column:
    return F.when(word_no % 9 == 4, 0.5).when(word_no % 17 == 8, 14.0).otherwise(3.0)


def typeset(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word with its box in PDF space and its style; one shuffle, by page."""
    lines = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("page_no", F.floor(F.col("line_no") / LINES_PER_PAGE).cast("int"))
    words = lines.select("doc_id", "page_no", "line_no", F.posexplode(F.filter(F.split("line", " "), lambda w: w != "")).alias("word_no", "text"))
    words = words.withColumn("width", F.length("text") * CHAR)
    before = Window.partitionBy("doc_id", "page_no", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    # clustered by page once; windows and groups by line, page or both need no other exchange
    words = words.repartition("doc_id", "page_no").withColumn("shift", F.coalesce(F.sum(F.col("width") + gap_after(F.col("word_no"))).over(before), F.lit(0.0)))
    i, line = F.col("word_no"), F.col("line_no")
    on_page = line % LINES_PER_PAGE
    size = F.when(line % 7 == 0, 16.0).when(line % 7 == 3, 9.0).otherwise(10.0)
    return words.select(
        "doc_id",
        "page_no",
        "line_no",
        "word_no",
        "text",
        (MARGIN + F.when(line % 10 == 3, 18.0).otherwise(0.0) + F.col("shift")).alias("x"),
        (PAGE_HEIGHT - MARGIN - on_page * LEADING - F.floor(on_page / 5) * EXTRA).alias("y"),
        "width",
        size.alias("height"),
        size.alias("font_size"),
        F.when(line % 3 == 0, "Helvetica").when(line % 3 == 1, "TimesNewRomanPS-BoldMT").otherwise("ABCDEF+CourierNewPSMT").alias("font_family"),
        F.when((line % 7 == 0) | (i % 11 == 5), 700).otherwise(400).alias("font_weight"),
        F.when(i % 13 == 6, "italic").otherwise("normal").alias("font_style"),
        F.when(i % 10 == 9, "#cc0000").otherwise("#000000").alias("color"),
    )


def plain_layout(documents: DataFrame, font_size: float = 12.0) -> DataFrame:
    """The reader's own fallback: one item per non-empty line, 1.2 line heights apart, 0.6 em for each character."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).where(F.trim("text") != "")
    return lines.select(
        "doc_id",
        "line_no",
        "text",
        F.lit(0.0).alias("x"),
        (F.col("line_no") * font_size * 1.2).alias("y"),
        (F.length("text") * font_size * 0.6).alias("width"),
        F.lit(font_size).alias("height"),
    )


def text_lines(words: DataFrame) -> DataFrame:
    """Words joined to lines: box in page space (top is the distance from the upper edge), sizes, text."""
    top = PAGE_HEIGHT - (F.col("y") + F.col("height"))
    return (
        words.groupBy("doc_id", "page_no", "line_no")
        .agg(
            F.min("x").alias("min_x"),
            F.max(F.col("x") + F.col("width")).alias("max_x"),
            F.min(top).alias("top"),
            F.max("height").alias("height"),
            F.avg("font_size").alias("font_size"),
            F.max("font_weight").alias("font_weight"),
            F.count("*").alias("n_words"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ").alias("text"),
        )
    )


#: DuckDB: the same words and lines, as common table expressions to begin a query with.
WORDS_SQL = """
WITH raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
raw_words AS (
  SELECT doc_id, line_no, unnest(list_filter(string_split(line, ' '), lambda w: w <> '')) AS text,
    unnest(range(len(list_filter(string_split(line, ' '), lambda w: w <> '')))) AS word_no FROM raw_lines),
set_words AS (
  SELECT doc_id, line_no, word_no, text, length(text) * 5.5 AS width,
    CASE WHEN word_no % 9 = 4 THEN 0.5 WHEN word_no % 17 = 8 THEN 14.0 ELSE 3.0 END AS gap FROM raw_words),
words AS (
  SELECT doc_id, CAST(line_no // 60 AS INTEGER) AS page_no, CAST(line_no AS INTEGER) AS line_no, CAST(word_no AS INTEGER) AS word_no, text,
    CAST(36.0 + CASE WHEN line_no % 10 = 3 THEN 18.0 ELSE 0.0 END
      + coalesce(sum(width + gap) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS DOUBLE) AS x,
    CAST(792.0 - 36.0 - (line_no % 60) * 12.0 - ((line_no % 60) // 5) * 6.0 AS DOUBLE) AS y,
    CAST(width AS DOUBLE) AS width,
    CAST(CASE WHEN line_no % 7 = 0 THEN 16.0 WHEN line_no % 7 = 3 THEN 9.0 ELSE 10.0 END AS DOUBLE) AS height,
    CAST(CASE WHEN line_no % 7 = 0 THEN 16.0 WHEN line_no % 7 = 3 THEN 9.0 ELSE 10.0 END AS DOUBLE) AS font_size,
    CASE line_no % 3 WHEN 0 THEN 'Helvetica' WHEN 1 THEN 'TimesNewRomanPS-BoldMT' ELSE 'ABCDEF+CourierNewPSMT' END AS font_family,
    CASE WHEN line_no % 7 = 0 OR word_no % 11 = 5 THEN 700 ELSE 400 END AS font_weight,
    CASE WHEN word_no % 13 = 6 THEN 'italic' ELSE 'normal' END AS font_style,
    CASE WHEN word_no % 10 = 9 THEN '#cc0000' ELSE '#000000' END AS color
  FROM set_words)
"""
LINES_SQL = (
    WORDS_SQL
    + """,
lines AS (
  SELECT doc_id, page_no, line_no, min(x) AS min_x, max(x + width) AS max_x, min(792.0 - (y + height)) AS top, max(height) AS height,
    avg(font_size) AS font_size, max(font_weight) AS font_weight, count(*) AS n_words, string_agg(text, ' ' ORDER BY word_no) AS text
  FROM words GROUP BY doc_id, page_no, line_no)
"""
)
