"""Recognition queries: embeddings stand in for a recogniser's scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ocr import decode as O
from ..ocr import prepare as R
from ..schema import PAGE_HEIGHT, PAGE_WIDTH
from ..sources.typesetter import WORDS_SQL
from .layout import words_of

CLASSES = 8
SIDE = 8


def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight scores a step; class 0 is the blank, the others are letters."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.transform("embedding", lambda x: F.round(x.cast("double"), 4))
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / CLASSES).cast("int") - 1), lambda i: F.slice(v, i * CLASSES + 1, CLASSES))
    rows = e.select("vec_id", steps.alias("steps")).select("vec_id", O.ctc_greedy(F.col("steps"), F.array(*map(F.lit, "abcdefg"))).alias("d"))
    return rows.select("vec_id", "d.text", F.round("d.confidence", 9).alias("confidence"))


def ocr_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as recognised words, some of them doubtful."""
    words = words_of(spark, sf_dir)
    seen = words.select("doc_id", "page_no", "text", "x", ((F.col("line_no") % 60) * 14.0 + F.col("word_no") % 3).alias("y"), "width", F.lit(10.0).alias("height"), ((F.col("word_no") % 10) / 10.0).alias("confidence"))
    found = O.words_as_items(seen)
    return found.groupBy("doc_id", "page_no").agg(F.count("*").alias("n_items"), F.max("item_no").cast("long").alias("last"), F.sum("font_size").alias("sizes"))


def detector_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as gray images of SIDE by SIDE pixels, black up to the next 32."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    gray = F.transform(F.slice("embedding", 1, SIDE * SIDE), lambda v: F.pmod(F.floor(v.cast("double") * 1000), F.lit(256)).cast("int"))
    rows = e.select("vec_id", R.detector_figures(gray, SIDE).alias("d"))
    return rows.select("vec_id", F.col("d.width").cast("long").alias("width"), F.col("d.height").cast("long").alias("height"), "d.ratio", F.round("d.total", 2).alias("total"))


def text_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of words with a margin, cut off at the page's edges."""
    words = words_of(spark, sf_dir)
    box = R.crop_box(F.col("x") - 34.0, PAGE_HEIGHT - F.col("y"), F.col("width"), F.col("height"), F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT))
    return words.select("doc_id", "page_no", box.alias("b")).groupBy("doc_id", "page_no").agg(*[F.sum(F.col("b")[c]).alias(c) for c in ("x", "y", "width", "height")])


QUERIES = {f.__name__: f for f in (ctc_decode, ocr_items, detector_inputs, text_crops)}
_INPUT = " + ".join(f"(v / 255.0 - {m}) / {d}" for m, d in zip(R.MEAN, R.DEVIATION, strict=True))
ORACLES = {
    "detector_inputs": f"""
WITH v AS (SELECT vec_id, unnest(list_transform(embedding[1:{SIDE * SIDE}], lambda x: (CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT) % 256 + 256) % 256)) AS v FROM embeddings),
t AS (SELECT vec_id, sum({_INPUT}) AS total, max((SELECT {_INPUT} FROM (SELECT 0 AS v))) AS black FROM v GROUP BY vec_id)
SELECT vec_id, CAST(32 AS BIGINT) AS width, CAST(32 AS BIGINT) AS height, CAST(1.0 AS DOUBLE) AS ratio, round(total + (32 * 32 - {SIDE * SIDE}) * black, 2) AS total FROM t
""",
    "text_crops": WORDS_SQL
    + """,
b AS (SELECT doc_id, page_no, width AS w, height AS h, greatest(0.0, x - 34.0 - 5) AS x, greatest(0.0, 792.0 - y - 5) AS y FROM words)
SELECT doc_id, page_no, sum(x) AS x, sum(y) AS y, sum(least(612.0 - x, w + 10)) AS width, sum(least(792.0 - y, h + 10)) AS height FROM b GROUP BY doc_id, page_no
""",
    "ocr_items": WORDS_SQL
    + """,
c AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY x) AS item_no FROM words WHERE word_no % 10 / 10.0 >= 0.5)
SELECT doc_id, page_no, count(*) AS n_items, max(item_no) AS last, CAST(sum(10.0 * 0.8) AS DOUBLE) AS sizes FROM c GROUP BY doc_id, page_no
""",
    "ctc_decode": """
WITH s AS (SELECT vec_id, unnest(range(len(embedding) // 8)) AS i, embedding FROM embeddings),
c AS (SELECT vec_id, i, list_transform(range(1, 9), lambda k: round(CAST(embedding[i * 8 + k] AS DOUBLE), 4)) AS v FROM s),
b AS (SELECT vec_id, i, list_position(v, list_max(v)) - 1 AS k, list_max(v) AS p FROM c),
l AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY i) AS pk FROM b),
g AS (SELECT vec_id, string_agg(substr('abcdefg', k, 1), '' ORDER BY i) AS text, avg(p) AS confidence FROM l WHERE k <> 0 AND (pk IS NULL OR pk <> k) GROUP BY vec_id)
SELECT e.vec_id, coalesce(text, '') AS text, round(coalesce(confidence, 0.0), 9) AS confidence FROM embeddings e LEFT JOIN g ON e.vec_id = g.vec_id
""",
}
