"""Text functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"(?i)(https?://|www\.)"
BULLETS = "•·▪▸►◦‣⁃"

#: List markers in the order they are tried, with the kind of list.
LIST_MARKERS = (
    (r"^[•●○■□◆◇▪▫]\s+", "ul"),
    (r"^[-–—]\s+", "ul"),
    (r"^\(?\d+[.)\]]\s+", "ol"),
    (r"^\(?[A-Za-z][.)\]]\s+", "ol"),
    (r"^\(?[ivxIVX]+[.)\]]\s+", "ol"),
)
#: Beginnings of an item that make it a list item.
LIST_STARTS = (r"^[-•·]\s", r"^\d+[.)]\s", r"^[a-z][.)]\s", r"^[ivxIVX]+[.)]\s")


#: Control characters that are dropped, and blanks that are trimmed: at edges, inside brackets and quotes, before punctuation.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
EDGE_BLANKS = r"^[ \t]{2,}|[ \t]{2,}$"
TIDY = (
    ("([(\\[{‘“\"'])\\s{2,}", "$1"),
    ("\\s{2,}([)\\]}’”\"'])", "$1"),
    (r"\s{2,}([,.;:!?])", "$1"),
)


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda a, s: F.regexp_replace(a, *s), steps, c)


def sanitize(c: Column) -> Column:
    """Drops control characters; apart from URLs, trims two or more edge blanks and blanks inside brackets and before punctuation."""
    out = F.regexp_replace(c, CONTROLS, "")
    bare = F.trim(out, F.lit(" \t"))
    tidy = chain(F.when(out.rlike(EDGE_BLANKS) & (bare != ""), bare).otherwise(out), *TIDY)
    return F.when(out.rlike(URL), out).otherwise(tidy)


#: What shows that a text needs respacing, and words that short fragments are not glued to.
RESPACE_SIGNS = (
    r"\b[A-Z]{2,3}[0-9]{2,4}\b",
    r"\b[A-Z]{2,3}\s+[0-9]{2,4}\b",
    r"\b[A-Z]{2,3}\s*-\s*[0-9]{2,4}\b",
    r"[a-z]{4,}[A-Z][a-z]",
    r"[A-Z][a-z]{2,}[A-Z][a-z]{2,}",
    r"[A-Za-z]{4,}\s+[a-z]{1,2}\b",
)
CONNECTORS = "to|with|for|and|of|at|in|on|as"
KEPT_APART = ("if", "to", "for", "with", "and", "of", "in", "on", "at", "as", "or", "an", "a", "the", "be", "we", "us", "my", "me", "do", "no")
#: Places where a space is missing or too many, in the order in which they are mended.
RESPACING = (
    (rf"\b({CONNECTORS})([A-Z][a-z])", "$1 $2"),
    (r"([A-Za-z]{4,})\s+([a-z]{1,2})\b", "$1$2"),
    (r"\b([A-Z]{2,3})([0-9]{2,4})\b", "$1 $2"),
    (rf"([A-Za-z]{{4,}})({CONNECTORS})(?=[A-Z][a-z])", "$1 $2"),
    (r"([a-z]{4,})([A-Z][a-z])", "$1 $2"),
    (r"([A-Z][a-z]{2,})([A-Z][a-z]{2,})", "$1 $2"),
)
#: Possessive, as Java's other loops over groups recurse once a round.
_FRAGMENTS = r"\b(?:[a-z]{1,3}\s+(?=[a-z]{1,3}\b))++[a-z]{1,3}\b"


def join_fragments(c: Column) -> Column:
    """Runs of lower-case pieces of up to three letters become one word, unless they start with a common short word."""
    gaps, runs = F.split(c, _FRAGMENTS, -1), F.regexp_extract_all(c, F.lit(_FRAGMENTS), F.lit(0))
    pieces = lambda r: F.split(r, r"\s+")
    glued = F.transform(
        runs, lambda r: F.when((F.length(F.regexp_replace(r, r"\s+", "")) < 4) | F.get(pieces(r), F.lit(0)).isin(*KEPT_APART), r).otherwise(F.regexp_replace(r, r"\s+", ""))
    )
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(glued, i), F.lit("")))), "")


def respace(c: Column) -> Column:
    """Spacing of text whose words run together or fall apart."""
    clean = sanitize(c)
    out = chain(clean, *RESPACING)
    out = F.regexp_replace(join_fragments(out), r"\s{2,}", " ")
    return F.when(clean.rlike("|".join(RESPACE_SIGNS)), out).otherwise(clean)


def normalize_glyphs(c: Column) -> Column:
    """Without zero-width characters, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\\u200B-\\u200D\\uFEFF]", ""), r"\s+", " "))


def escape_html(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def list_marker(c: Column) -> Column:
    """ul, ol or null."""
    text = F.ltrim(c)
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(LIST_MARKERS):
        out = F.when(text.rlike(pattern), kind).otherwise(out)
    return out


def strip_marker(c: Column) -> Column:
    """Without its list marker; leading blanks stay."""
    text = F.ltrim(c)
    lead = F.substr(c, F.lit(1), F.length(c) - F.length(text))
    out = text
    for pattern, _ in reversed(LIST_MARKERS):
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "")).otherwise(out)
    return F.concat(lead, out)


def is_list_item(c: Column) -> Column:
    return F.trim(c).rlike("|".join(LIST_STARTS))


def without_soft_hyphen(c: Column) -> Column:
    return F.regexp_replace(c, "\\u00AD$", "")


def continues(previous: Column, line: Column) -> Column:
    """A short capitalised beginning at the end of a line goes on in the next."""
    return previous.rlike("[A-Z][a-z]{0,2}$") & line.rlike("^[a-z]{3,}")


def hyphen_joins(previous: Column, line: Column) -> Column:
    """A soft hyphen after a letter, and a lower-case start."""
    return previous.rlike("[A-Za-z]\\u00AD$") & line.rlike("^[a-z]")


def is_title_case_or_caps(c: Column) -> Column:
    t = F.trim(c)
    return (F.length(t) <= 50) & ((t.rlike("^[A-Z][a-z]++(?: [A-Z][a-z]++)*+$")) | ((t == F.upper(t)) & t.rlike("[A-Z]")))


#: Code-point ranges of each script, in the order in which ties are settled.
SCRIPTS = {
    "latin": "\\u0041-\\u007A\\u00C0-\\u024F",
    "cyrillic": "\\u0400-\\u052F",
    "greek": "\\u0370-\\u03FF",
    "cjk": "\\u4E00-\\u9FFF\\u3400-\\u4DBF\\u3040-\\u30FF\\u31F0-\\u31FF\\uAC00-\\uD7AF",
    "arabic": "\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF\\uFB50-\\uFDFF\\uFE70-\\uFEFF",
    "hebrew": "\\u0590-\\u05FF\\uFB1D-\\uFB4F",
    "devanagari": "\\u0900-\\u097F",
}
#: Characters of scripts written from right to left.
RIGHT_TO_LEFT = "[\\u0590-\\u05FF\\u0600-\\u06FF\\u0700-\\u074F\\u0750-\\u077F\\u08A0-\\u08FF\\uFB50-\\uFDFF\\uFE70-\\uFEFF]"


def script_counts(c: Column) -> dict[str, Column]:
    """Characters of each script; ``other`` is the rest."""
    counts = {name: F.regexp_count(c, F.lit(f"[{ranges}]")) for name, ranges in SCRIPTS.items()}
    return counts | {"other": F.length(c) - reduce(lambda a, b: a + b, counts.values())}


def dominant_script(counts: dict[str, Column], fallback: str = "latin") -> Column:
    """The script with most characters; the first of equals, the fallback without any."""
    most = F.greatest(*counts.values())
    out = F.lit(fallback)
    for name in reversed(counts):
        out = F.when(counts[name] == most, name).otherwise(out)
    return F.when(most > 0, out).otherwise(fallback)
