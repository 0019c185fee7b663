"""Font queries: parts and customers lend their names to fonts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fonts as N

#: Names that the queries give to fonts, by number.
NAMES = (
    "ABCDEF+Helvetica-Bold", "TimesNewRomanPS-BoldItalicMT", "CourierNewPSMT", "OpenSans-Light", "Roboto-Medium", "Source Sans Pro", "Merriweather-Black", "Lora-SemiBoldItalic",
    "Calibri,Italic", "SomeSerif-Regular", "GaramondPro", "Montserrat-ExtraBold", "XYZABC+DejaVuSansMono-Oblique", "Lato-100", "Arial Narrow Bd", "Unknown_Face/Demi",
)


def _fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A font for each part: a name, flags and metrics that stray around a family's."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    name = F.get(F.array(*map(F.lit, NAMES)), (k % len(NAMES)).cast("int"))
    wide = F.when(k % len(NAMES) == 2, 600.0).when(k % len(NAMES) == 12, 602.0).otherwise(900.0 + k % 200)
    return p.select(
        k.alias("font_no"), name.alias("name"), F.when(k % 3 == 0, 64).when(k % 3 == 1, 262144).otherwise(0).alias("flags"),
        (700.0 + k % 300).alias("ascent"), (200.0 + k % 100).alias("descent"), (640.0 + k % 90).alias("cap_height"), F.when(k % 17 == 0, 0.0).otherwise(450.0 + k % 80).alias("x_height"),
        F.when(k % len(NAMES) == 2, 598.0).otherwise(500.0 + k % 90).alias("average_width"), wide.alias("max_width"),
    )


def font_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a name says: family, weight, style, slug, quoting."""
    f = _fonts(spark, sf_dir)
    n = F.col("name")
    ws = N.weight_and_style(n, N.family_of(n), F.col("flags"))
    return f.groupBy("name", "flags").agg(F.count("*").alias("n")).select(
        "name", "flags", "n", N.normalized_family(n).alias("family"), N.weight_hint(n).alias("hint"), N.style_hint(n).alias("style_hint"), ws["weight"].cast("int").alias("weight"), ws["style"].alias("style"), N.class_suffix(n).alias("slug"), N.quoted(n).alias("quoted"), N.family_of(n).alias("plain_family"),
    )


def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' and nations' names against web fonts: by edits and by words."""
    fonts = spark.createDataFrame([(r[0], r[1]) for r in {(i, f): (i, f) for i, f, *_ in N.web_font_rows()}.values()], "pos int, family string")
    n = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("name")).distinct()
    rows = n.join(F.broadcast(fonts), F.lit(True))  # eight web fonts
    return rows.select("name", "family", F.round(N.name_similarity(F.col("name"), F.col("family")), 9).alias("by_edits"), F.round(N.word_similarity(F.col("name"), F.concat(F.col("family"), F.lit(" "), F.substring_index("name", " ", 1))), 9).alias("by_words"))


def font_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue records by metrics."""
    f = _fonts(spark, sf_dir).withColumn("real", N.are_real_units([F.col(m) for m in N.METRICS]))
    out = N.resolve_metrics(f, N.catalogue(spark), ["font_no", "real"])
    return out.select("font_no", "real", "record_id", F.round("score", 9).alias("score"), "reason")


def font_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue records by name, with the stack that CSS gets."""
    f = _fonts(spark, sf_dir).select("font_no", F.col("name").alias("font_family"))
    out = N.resolve_names(f, N.aliases(spark)).join(F.broadcast(N.catalogue(spark).select(F.col("id").alias("record_id"), "family", "category")), "record_id")
    return out.groupBy("font_family", "record_id", "reason", N.css_stack(F.col("family"), F.col("category")).alias("stack")).agg(F.count("*").alias("n"))


def font_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fonts(spark, sf_dir)
    f = f.select("font_no", "name", N.family_of(F.col("name")).alias("family"), N.weight_of(F.col("name")).cast("int").alias("weight"), N.style_of(F.col("name")).alias("style"), *N.METRICS)
    out = N.map_to_web_fonts(f, N.web_fonts(spark), 0.55)
    return out.select("font_no", "web_family", "web_weight", F.round("similarity", 9).alias("similarity"), "fallback_chain")


def char_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of customers' names in the units of the default sans record."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    chars = c.select("c_custkey", F.explode(F.split(F.concat("c_name", F.lit(", "), "c_mktsegment"), "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("c_custkey").agg(F.round(F.sum(N.char_units(F.col("ch"), F.lit(520.0), F.lit(270.0))), 6).alias("units"))


def detected_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different fonts by name, ascent and descent (the first item of each), with what their figures say."""
    f = _fonts(spark, sf_dir).withColumn("ascent", F.col("ascent") - F.col("ascent") % 100).withColumn("descent", F.col("descent") - F.col("descent") % 50)
    first = f.groupBy("name", "ascent", "descent").agg(F.min_by(F.struct("font_no", "average_width", "max_width"), "font_no").alias("f"))
    c = N.characteristics(F.col("name"), F.col("f.average_width"), F.col("f.max_width"), N.weight_of(F.col("name")))
    return first.select("name", "ascent", "descent", "f.font_no", c["is_serif"].alias("is_serif"), c["is_monospace"].alias("is_monospace"), c["weight_category"].alias("weight_category"))


QUERIES = {f.__name__: f for f in (font_names, name_similarity, font_resolve, font_aliases, font_map, char_units, detected_fonts)}

_NAME = "CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
_FONTS = f"""
WITH f AS (
  SELECT p_partkey AS font_no, {_NAME} AS name, CASE p_partkey % 3 WHEN 0 THEN 64 WHEN 1 THEN 262144 ELSE 0 END AS flags, 700.0 + p_partkey % 300 AS ascent, 200.0 + p_partkey % 100 AS descent, 640.0 + p_partkey % 90 AS cap_height,
    CASE WHEN p_partkey % 17 = 0 THEN 0.0 ELSE 450.0 + p_partkey % 80 END AS x_height, CASE WHEN p_partkey % 16 = 2 THEN 598.0 ELSE 500.0 + p_partkey % 90 END AS average_width,
    CASE WHEN p_partkey % 16 = 2 THEN 600.0 WHEN p_partkey % 16 = 12 THEN 602.0 ELSE 900.0 + p_partkey % 200 END AS max_width FROM part)
"""
_RECORDS = "VALUES " + ", ".join(f"({r[0]}, '{r[1]}', '{r[2]}', '{r[3]}', {r[4]}, {r[5]}, {r[6]}, {r[7]}, {r[8]}, {r[9]})" for r in N.catalogue_rows())
_ALIAS_NAMES = "VALUES " + ", ".join("({}, '{}', '{}')".format(*(str(x).replace("'", "''") for x in r)) for r in N.alias_rows())
_WEB = "VALUES " + ", ".join(f"({a}, '{b}', '{c}', {d}, {e})" for a, b, c, d, e in N.web_font_rows())


def _clean(c: str) -> str:
    """A DuckDB expression for the normalised family."""
    steps = ((r"^[A-Z]{6}\+", ""), (r"([a-z])([A-Z])", r"\1 \2"), (r"([A-Za-z])([0-9])", r"\1 \2"), (r"([0-9])([A-Za-z])", r"\1 \2"), (r"([A-Za-z])([Pp][Ss][Mm][Tt]|[Mm][Tt]|[Pp][Ss])\b", r"\1 \2"), (r"[_/]", " "), (r"-+", " "), (r"\s*,\s*", " "), (r"\b(psmt|ps|mt|std|otf|ttf)\b", ""))
    for pattern, by in steps:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    c = f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    c = f"regexp_replace({c}, '\\b(bold|black|heavy|semibold|demibold|medium|light|thin|italic|oblique|regular|reg|regu|bd|it|bi)\\b', '', 'g')"
    c = f"regexp_replace({c}, '\\b(condensed|narrow|expanded)\\b', '', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _weight(c: str) -> str:
    s = f"lower({c})"
    return f"""CASE WHEN regexp_matches({s}, '(^|[^0-9])[1-9]00([^0-9]|$)') THEN CAST(regexp_extract({s}, '(^|[^0-9])([1-9]00)([^0-9]|$)', 2) AS INTEGER) WHEN contains({s}, 'thin') THEN 100 WHEN regexp_matches({s}, 'extralight|ultralight|extra light|ultra light') THEN 200
    WHEN contains({s}, 'light') THEN 300 WHEN regexp_matches({s}, 'medium|(^|[^a-z0-9])md([^a-z0-9]|$)') THEN 500 WHEN regexp_matches({s}, 'semibold|demibold|demi bold|(^|[^a-z0-9])demi([^a-z0-9]|$)') THEN 600
    WHEN regexp_matches({s}, 'extrabold|ultrabold|extra bold|ultra bold') THEN 800 WHEN regexp_matches({s}, 'black|heavy') THEN 900 WHEN regexp_matches({s}, 'bold|(^|[^a-z0-9])bd([^a-z0-9]|$)') THEN 700 ELSE 400 END"""


def _style(c: str) -> str:
    s = f"lower({c})"
    return f"CASE WHEN regexp_matches({s}, 'italic|(^|[^a-z0-9])it([^a-z0-9]|$)|(^|[^a-z0-9])ital([^a-z0-9]|$)') THEN 'italic' WHEN regexp_matches({s}, 'oblique|(^|[^a-z0-9])obl([^a-z0-9]|$)') THEN 'oblique' ELSE 'normal' END"


_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '-Bold$', ''), '-Italic$', ''), '-Regular$', ''), '-Oblique$', ''))"
_SIM = "(1 - least(abs({a} - {b}) / greatest(abs({a}), abs({b}), 1e-6), 1.0))"
_SCORE = " + ".join(f"{_SIM.format(a=f'f.{m}', b=f'r.{m}')} * {w}" for m, w in N.CATALOGUE_WEIGHTS.items())
_HAS = "(f.{m} <> 0 AND w.{m} <> 0)"
_COMPARE = " + ".join(f"CASE WHEN {_HAS.format(m=m)} THEN (1 - least(abs(f.{m} - w.{m}) / greatest(f.{m}, w.{m}), 1.0)) * {v} ELSE 0.0 END" for m, v in N.COMPARE_WEIGHTS.items())
_COMPARED = " + ".join(f"CASE WHEN {_HAS.format(m=m)} THEN {v} ELSE 0.0 END" for m, v in N.COMPARE_WEIGHTS.items())
_WORDS = "list_filter(regexp_split_to_array({a}, '[\\s-]+'), lambda x: list_contains(regexp_split_to_array({b}, '[\\s-]+'), x))"


def _by_words(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.8 ELSE CAST(len({_WORDS.format(a=a, b=b)}) AS DOUBLE) / greatest(len(regexp_split_to_array({a}, '[\\s-]+')), len(regexp_split_to_array({b}, '[\\s-]+'))) END"


def _by_edits(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.8 ELSE 1 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END"


_CLEAN_NAME = "regexp_replace(lower(regexp_replace(name, '^[A-Z]{6}\\+', '')), '^$', '')"
ORACLES = {
    "font_names": _FONTS
    + f""",
g AS (SELECT name, flags, count(*) AS n FROM f GROUP BY name, flags),
s AS (SELECT *, {_CLEAN_NAME} AS s, {_PLAIN} AS plain_family FROM g)
SELECT name, flags, n, {_clean("name")} AS family,
  CASE WHEN regexp_matches(s, '\\bthin\\b|\\b100\\b') THEN 100 WHEN regexp_matches(s, '\\bextralight\\b|\\bultralight\\b|\\b200\\b') THEN 200 WHEN regexp_matches(s, '\\blight\\b|\\b300\\b') THEN 300 WHEN regexp_matches(s, '\\bregular\\b|\\bnormal\\b|\\b400\\b') THEN 400
    WHEN regexp_matches(s, '\\bmedium\\b|\\b500\\b') THEN 500 WHEN regexp_matches(s, '\\bsemibold\\b|\\bdemibold\\b|\\b600\\b') THEN 600 WHEN regexp_matches(s, '\\bbold\\b|\\b700\\b') THEN 700 WHEN regexp_matches(s, '\\bextrabold\\b|\\bultrabold\\b|\\b800\\b') THEN 800 WHEN regexp_matches(s, '\\bblack\\b|\\bheavy\\b|\\b900\\b') THEN 900 END AS hint,
  CASE WHEN regexp_matches(s, '(italic|it)\\b') THEN 'italic' WHEN regexp_matches(s, 'oblique\\b') THEN 'oblique' ELSE 'normal' END AS style_hint,
  greatest({_weight("name")}, {_weight("plain_family")}, CASE WHEN flags = 262144 THEN 700 ELSE 0 END) AS weight,
  CASE WHEN flags = 64 THEN 'italic' WHEN {_style("name")} <> 'normal' THEN {_style("name")} ELSE {_style("plain_family")} END AS style,
  regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+', ''), '-+$', '') AS slug, CASE WHEN contains(name, ' ') THEN '''' || name || '''' ELSE name END AS quoted, plain_family
FROM s
""",
    "name_similarity": f"""
WITH w AS (SELECT DISTINCT column1 AS family FROM ({_WEB}) t(column0, column1, column2, column3, column4)),
n AS (SELECT DISTINCT p_type AS name FROM part)
SELECT name, family, round({_by_edits("lower(name)", "lower(family)")}, 9) AS by_edits, round({_by_words("lower(name)", "lower(family || ' ' || string_split(name, ' ')[1])")}, 9) AS by_words FROM n, w
""",
    "font_aliases": _FONTS
    + f""",
nm AS (SELECT * FROM ({_ALIAS_NAMES}) t(pos, id, name)),
al AS (SELECT alias, arg_min(id, pos) AS id FROM (SELECT pos, id, {_clean("trim(name)")} AS alias FROM nm) WHERE alias <> '' GROUP BY alias),
k AS (SELECT name, {_clean("name")} AS key FROM f),
r AS (
  SELECT name AS font_family, CASE WHEN al.id IS NOT NULL THEN al.id WHEN regexp_matches(key, 'mono|courier') THEN 'default_mono' WHEN regexp_matches(key, 'serif|times|roman') THEN 'default_serif' ELSE 'default_sans' END AS record_id,
    CASE WHEN al.id IS NOT NULL THEN 'alias' ELSE 'fallback' END AS reason FROM k LEFT JOIN al ON key = alias),
c AS (SELECT * FROM ({_RECORDS}) t(pos, id, family, category, ascent, descent, cap_height, x_height, average_width, max_width))
SELECT font_family, record_id, reason, CASE WHEN contains(family, ' ') THEN '''' || family || '''' ELSE family END
  || CASE category WHEN 'serif' THEN ', ''Times New Roman'', Times, serif' WHEN 'monospace' THEN ', ''Courier New'', Courier, monospace' ELSE ', Arial, Helvetica, sans-serif' END AS stack, count(*) AS n
FROM r JOIN c ON record_id = c.id GROUP BY 1, 2, 3, 4
""",
    "font_resolve": _FONTS
    + f""",
r AS (SELECT * FROM ({_RECORDS}) t(pos, id, family, category, ascent, descent, cap_height, x_height, average_width, max_width)),
s AS (SELECT f.*, r.id, row_number() OVER (PARTITION BY font_no ORDER BY {_SCORE} DESC, pos) AS k, {_SCORE} AS score FROM f, r)
SELECT font_no, true AS real, CASE WHEN score < 0.55 THEN CASE WHEN average_width / max_width > 0.88 THEN 'default_mono' ELSE 'default_sans' END ELSE id END AS record_id, round(CASE WHEN score < 0.55 THEN 0.5 ELSE score END, 9) AS score, CASE WHEN score < 0.55 THEN 'fallback' ELSE 'metrics' END AS reason
FROM s WHERE k = 1
""",
    "font_map": _FONTS
    + f""",
g AS (SELECT *, {_PLAIN} AS plain, regexp_matches(lower(name), 'serif|times|georgia|garamond') AS serif, average_width / max_width > 0.9 AS mono FROM f),
w0 AS (SELECT * FROM ({_WEB}) t(pos, family, category, wpos, weight)),
w AS (
  SELECT *, CASE category WHEN 'serif' THEN 750.0 ELSE 800.0 END AS ascent, CASE category WHEN 'serif' THEN 250.0 ELSE 200.0 END AS descent, CASE category WHEN 'serif' THEN 650.0 ELSE 700.0 END AS cap_height, CASE category WHEN 'serif' THEN 450.0 ELSE 500.0 END AS x_height,
    CASE category WHEN 'monospace' THEN 600.0 ELSE 500.0 END * fac AS average_width, CASE category WHEN 'monospace' THEN 600.0 ELSE 800.0 END * fac AS max_width FROM (SELECT *, CASE WHEN weight >= 700 THEN 1.1 WHEN weight <= 300 THEN 0.9 ELSE 1.0 END AS fac FROM w0)),
c AS (
  SELECT f.font_no, w.family, w.weight, pos, wpos, {_by_words("lower(plain)", "lower(w.family)")} * 0.3 + CASE WHEN {_COMPARED} > 0 THEN ({_COMPARE}) / ({_COMPARED}) ELSE 0.0 END * 0.7 AS sim, {_by_edits("lower(plain)", "lower(w.family)")} AS near
  FROM g f, w WHERE NOT (mono AND category <> 'monospace') AND NOT (serif AND category <> 'serif') AND NOT (NOT serif AND NOT mono AND category = 'serif')),
b AS (SELECT *, row_number() OVER (PARTITION BY font_no ORDER BY sim DESC, pos, wpos) AS k FROM c WHERE near > 0.3 AND sim >= 0.55)
SELECT g.font_no, coalesce(b.family, CASE WHEN mono THEN 'Roboto Mono' WHEN serif THEN 'Merriweather' ELSE 'Roboto' END) AS web_family, coalesce(b.weight, 400) AS web_weight, round(CAST(coalesce(sim, 0.5) AS DOUBLE), 9) AS similarity,
  coalesce(b.family, CASE WHEN mono THEN 'Roboto Mono' WHEN serif THEN 'Merriweather' ELSE 'Roboto' END) || ', ' || CASE WHEN b.family IS NOT NULL AND mono THEN 'Courier New, monospace' WHEN b.family IS NOT NULL AND serif THEN 'Times New Roman, serif' ELSE 'Arial, sans-serif' END AS fallback_chain
FROM g LEFT JOIN b ON g.font_no = b.font_no AND k = 1
""",
    "char_units": """
WITH c AS (SELECT c_custkey, unnest(string_split(c_name || ', ' || c_mktsegment, '')) AS ch FROM customer)
SELECT c_custkey, round(sum(CASE WHEN ch = ' ' THEN 270.0 WHEN regexp_matches(ch, '[0-9]') THEN 520 * 0.95 WHEN regexp_matches(ch, '[A-Z]') THEN 520 * 1.05 WHEN regexp_matches(ch, '[a-z]') THEN 520 * 0.98 WHEN regexp_matches(ch, '[,.;:!?]') THEN 520 * 0.55 ELSE 520.0 END), 6) AS units FROM c WHERE ch <> '' GROUP BY c_custkey
""",
    "detected_fonts": _FONTS
    + f""",
d AS (SELECT *, ascent - ascent % 100 AS a, descent - descent % 50 AS b FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY name, a, b ORDER BY font_no) AS k FROM d)
SELECT name, CAST(a AS DOUBLE) AS ascent, CAST(b AS DOUBLE) AS descent, font_no, regexp_matches(lower(name), 'serif|times|georgia|garamond') AS is_serif, average_width / max_width > 0.9 AS is_monospace,
  CASE WHEN {_weight("name")} < 400 THEN 'light' WHEN {_weight("name")} < 500 THEN 'normal' WHEN {_weight("name")} < 700 THEN 'medium' WHEN {_weight("name")} < 900 THEN 'bold' ELSE 'heavy' END AS weight_category FROM r WHERE k = 1
""",
}
