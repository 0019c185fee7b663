"""Is there a word boundary between two neighbouring items of a line?

Four deciders, from plain geometry to dictionary evidence.  Each takes the two texts, the raw gap, the mean font size and a
line model, and gives a struct; they are expressions over one row, so a line needs no more than ``lead``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classifier profiles (name, script, scale of the word-break threshold, least threshold between digits, splits).
PROFILES = (
    ("latin-default", "latin", 1.0, 1.35, ""),
    ("latin-words", "latin", 1.0, 1.35, "lower_upper all_caps digit_alpha"),
    ("latin-tight", "latin", 1.1, 1.45, ""),
    ("latin-loose", "latin", 0.9, 1.15, ""),
    ("auto-default", "auto", 1.0, 1.35, ""),
    ("cyrillic-default", "cyrillic", 1.05, 1.35, ""),
    ("greek-default", "greek", 1.05, 1.35, ""),
    ("arabic-default", "arabic", 1.15, 1.35, ""),
    ("hebrew-default", "hebrew", 1.1, 1.35, ""),
    ("devanagari-default", "devanagari", 1.1, 1.35, ""),
    ("cjk-default", "cjk", 2.0, 1.35, "join_cjk"),
)
DEFAULT_PROFILE = "auto-default"
SHORT_CONNECTORS = ("to", "of", "in", "on", "at", "by", "or", "an", "as", "if", "is")
CJK = "^[\\u4E00-\\u9FFF\\u3400-\\u4DBF\\u3040-\\u30FF\\u31F0-\\u31FF\\uAC00-\\uD7AF]+$"


def profile(name: str | None) -> tuple:
    """The named profile; an unknown or empty name gives the default."""
    known = {p[0]: p for p in PROFILES}
    return known.get((name or "").strip(), known[DEFAULT_PROFILE])


def usable_gap(gap: Column, font_size: Column) -> Column:
    """Overlaps of up to a quarter of the font size count as touching."""
    return F.when((gap < 0) & (gap >= -0.25 * font_size), 0.0).otherwise(gap)


def by_char(gap: Column, char_width: Column) -> Column:
    return gap / F.greatest(F.lit(0.01), char_width)


def in_url(a: Column, b: Column) -> Column:
    """The pair looks like the inside of a URL."""
    la, lb = F.lower(a), F.lower(b)
    return (
        la.rlike(r"https?://|www\.|://|/")
        | lb.rlike(r"https?://|www\.|://|^/")
        | (a.rlike(r"\.$") & b.rlike("^[A-Za-z0-9-]{2,}$"))
        | a.rlike(r"\.[A-Za-z]{2,4}$")
        | (b.rlike("^[A-Za-z]{2,4}$") & a.rlike(r"\.$") & (F.length(a) >= 4))
    )


def _pair(a: Column, b: Column) -> dict[str, Column]:
    return {
        "alpha": a.rlike("[A-Za-z]$") & b.rlike("^[A-Za-z]"),
        "digits": a.rlike("[0-9]$") & b.rlike("^[0-9]"),
        "time": a.rlike("[0-9]:$") & b.rlike("^[0-9]"),
        "case": a.rlike("[a-z]$") & b.rlike("^[A-Z]"),
        "after_separator": a.rlike("[:;,]$") & b.rlike("^[A-Za-z0-9]"),
        "before_punctuation": b.rlike("^[,.;:!?)]"),
    }


def _decision(kind: Column | str, confidence: Column | float, threshold: Column) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lift(kind).alias("type"), lift(confidence).cast("double").alias("confidence"), threshold.cast("double").alias("threshold"))


def _raised(t: Column, when: Column, limit: float) -> Column:
    """At least ``limit`` where the condition holds; ``t`` stands once, so that chains of these stay small."""
    return F.greatest(t, F.when(when, limit).otherwise(0.0))


def _lowered(t: Column, when: Column, limit: float) -> Column:
    return F.least(t, F.when(when, limit).otherwise(1e9))


def _by_gap(ratio: Column, threshold: Column) -> Column:
    margin = F.least(F.lit(1.5), F.abs(ratio - threshold))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.55 + margin / 1.5))
    return _decision(F.when(ratio >= threshold, "space").otherwise("join"), confidence, threshold)


def basic(a: Column, b: Column, gap: Column, font_size: Column, char_width: Column, word_break: Column) -> Column:
    """Geometry with a few exceptions: struct<type, confidence, threshold>."""
    px = usable_gap(gap, font_size)
    ratio = by_char(px, char_width)
    p = _pair(a, b)
    t = _raised(word_break, p["digits"], 1.35)
    t = _lowered(t, p["after_separator"] & ~(a.rlike(":$") & b.rlike("^[0-9]")), 0.28)
    t = _lowered(t, (F.length(a) >= 2) & (F.length(b) >= 2) & p["alpha"], 0.32)
    return (
        F.when(px < 0, _decision("join", 0.9, word_break))
        .when(p["time"] | in_url(a, b) | p["before_punctuation"], _decision("join", 0.95, word_break))
        .otherwise(_by_gap(ratio, t))
    )


def rule(a: Column, b: Column, gap: Column, font_size: Column, char_width: Column, word_break: Column, name: str = DEFAULT_PROFILE, script: Column | None = None) -> Column:
    """Geometry under a profile: single letters stick, and profiles may split at case, capitals and digits."""
    _, _, scale, digit_least, splits = profile(name)
    px = usable_gap(gap, font_size)
    ratio = by_char(px, char_width)
    p = _pair(a, b)
    no = F.lit(False)
    cjk = a.rlike(CJK) & b.rlike(CJK) & (script == "cjk") if "join_cjk" in splits and script is not None else no
    single = p["alpha"] & (a.rlike("^[A-Za-z]$") | b.rlike("^[A-Za-z]$"))
    single_least = F.greatest(word_break * 1.35, F.lit(1.25))
    case_least = F.least(F.lit(0.35), F.greatest(F.lit(0.18), word_break * 0.55))
    case = p["case"] & ~a.rlike("^[ei]$") & (ratio >= case_least) if "lower_upper" in splits else no
    caps_least = F.least(F.lit(0.45), F.greatest(F.lit(0.2), word_break * 0.6))
    caps = a.rlike("^[A-Z0-9]{3,}$") & b.rlike("^[A-Z0-9]{3,}$") & (ratio >= caps_least) if "all_caps" in splits else no
    t = word_break * max(0.25, min(3.0, scale))
    t = _raised(t, p["digits"], digit_least)
    mixed_least = F.least(F.lit(0.4), F.greatest(F.lit(0.16), t * 0.55))
    mixed = ((a.rlike("[0-9]$") & b.rlike("^[A-Za-z]")) | (a.rlike("[A-Za-z]$") & b.rlike("^[0-9]"))) & (ratio >= mixed_least) if "digit_alpha" in splits else no
    last = _lowered(t, p["after_separator"] & ~(a.rlike(":$") & b.rlike("^[0-9]")), 0.28)
    last = _lowered(last, (F.length(a) >= 3) & (F.length(b) >= 3) & p["alpha"], 0.32)
    return (
        F.when(px < 0, _decision("join", 0.9, word_break))
        .when(cjk | p["time"] | in_url(a, b), _decision("join", 0.95, word_break))
        .when(single & (ratio < single_least), _decision("join", 0.9, single_least))
        .when(p["before_punctuation"], _decision("join", 0.95, word_break))
        .when(case, _decision("space", 0.7, case_least))
        .when(caps, _decision("space", 0.75, caps_least))
        .when(mixed, _decision("space", 0.7, mixed_least))
        .otherwise(_by_gap(ratio, last))
    )


#: Thresholds of the unified decider.
MULTI_TOKEN, CASE, GENERAL = 0.15, 0.08, 0.85


def unified(a: Column, b: Column, gap: Column, font_size: Column, char_width: Column, is_word: Column, both_words: Column) -> Column:
    """struct<space, confidence, threshold, reason>; ``is_word``: the joined text is in the dictionary; ``both_words``: both parts are."""
    px = usable_gap(gap, font_size)
    ratio = by_char(px, char_width)
    p = _pair(a, b)

    def said(space: Column | bool, confidence: float, threshold: Column | float, reason: str) -> Column:
        lift = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(lift(space).alias("space"), F.lit(confidence).alias("confidence"), lift(threshold).cast("double").alias("threshold"), F.lit(reason).alias("reason"))

    la, lb = F.lower(a), F.lower(b)
    url = la.rlike(r"https?://|www\.|://") | lb.rlike(r"https?://|www\.|://") | (la.contains("/") & lb.rlike("^[a-z0-9-]")) | (a.rlike(r"\.[A-Za-z]{2,4}$") & b.rlike("^[A-Za-z0-9/]"))
    address = "^[A-Za-z0-9._%+-]+$"
    email = a.contains("@") | b.contains("@") | (a.rlike(address) & b.rlike(address) & (a.contains(".") | b.contains(".")))
    single = a.rlike("^[A-Za-z0-9]$") & b.rlike("^[A-Za-z0-9]$")
    multi = (F.length(a) >= 3) & (F.length(b) >= 3) & p["alpha"]
    cased = F.when(p["case"], CASE).otherwise(MULTI_TOKEN)
    worded = F.when(both_words, F.least(cased, F.lit(0.1))).otherwise(cased)
    return (
        F.when(px < 0, said(False, 0.95, 0.0, "negative_gap"))
        .when(ratio >= 2.0, said(True, 0.95, 2.0, "large_gap"))
        .when(url, said(False, 0.9, 2.0, "url_context"))
        .when(email, said(False, 0.9, 2.0, "email_context"))
        .when(b.rlike("^[,.;:!?)\\]}\"']+$"), said(False, 0.95, 2.0, "punctuation_attach"))
        .when(a.rlike("^[(\\[{\"']+$"), said(False, 0.9, 2.0, "opening_punct"))
        .when(p["time"], said(False, 0.95, 2.0, "time_pattern"))
        .when(single, said(ratio >= 2.2, 0.8, 2.2, "single_char"))
        .when(p["digits"], said(ratio >= 1.35, 0.85, 1.35, "digit_sequence"))
        .when(multi & is_word, said(False, 0.9, cased, "valid_word"))
        .when(multi, said(ratio >= worded, 0.85, worded, "multi_token_alpha"))
        .when((F.length(a) <= 3) & (F.length(b) <= 3) & p["alpha"], said(ratio >= 1.85, 0.75, 1.85, "short_alpha_pair"))
        .when(p["after_separator"], said(ratio >= 0.28, 0.8, 0.28, "after_separator"))
        .otherwise(said(ratio >= GENERAL, 0.7, GENERAL, "default"))
    )


def statistical(a: Column, b: Column, gap: Column, font_size: Column, char_width: Column, word_break: Column) -> Column:
    """struct<space, threshold>: the line's own threshold, raised or lowered by what the texts look like."""
    px = usable_gap(gap, font_size)
    ratio = by_char(px, char_width)
    p = _pair(a, b)
    address = "^[A-Za-z0-9._%+-]+$"
    email = a.contains("@") | b.contains("@") | (a.endswith(".") & b.rlike("^[A-Za-z]{2,6}$")) | (a.rlike(address) & b.rlike(address) & (a.contains(".") | b.contains(".")))
    multi = (F.length(a) >= 3) & (F.length(b) >= 3) & p["alpha"]
    short = a.rlike("^[A-Za-z]{1,3}$") & b.rlike("^[A-Za-z]{1,3}$") & ~multi
    # in this order: (when, at least or at most, limit)
    steps = (
        (p["digits"], _raised, 1.35),
        (email, _raised, 2.2),
        (a.rlike("^[A-Za-z0-9]$") & b.rlike("^[A-Za-z0-9]$"), _raised, 2.2),
        (multi, _lowered, 0.15),
        (short, _raised, 1.85),
        (p["after_separator"], _lowered, 0.28),
        (p["case"] & (F.length(a) >= 2) & (F.length(b) >= 2), _lowered, 0.08),
        (F.lower(b).isin(*SHORT_CONNECTORS) & p["alpha"], _lowered, 0.18),
        (F.lower(a).isin(*SHORT_CONNECTORS) & p["alpha"], _lowered, 0.18),
    )
    t = reduce(lambda t, s: s[1](t, s[0], s[2]), steps, word_break)
    url_start = b.rlike(r"^(?i)(https?://|https?:|www\.)") & a.rlike("[A-Za-z0-9)]$")
    url_limit = F.least(F.lit(0.95), F.greatest(F.lit(0.65), word_break))
    said = lambda s, t: F.struct(s.alias("space"), t.cast("double").alias("threshold"))
    return (
        F.when(px < 0, said(F.lit(False), word_break))
        .when(in_url(a, b), said(url_start & (ratio >= url_limit), F.when(url_start, url_limit).otherwise(word_break)))
        .when(p["before_punctuation"], said(F.lit(False), word_break))
        .otherwise(said(ratio >= t, t))
    )


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def two_means(values: Column) -> Column:
    """struct<c0, c1>: two centres from the extremes, twelve rounds at most; a round that moves both less than 0.001 is not taken."""

    def rounds(v: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            near = lambda x: F.abs(x - s["c0"]) <= F.abs(x - s["c1"])
            sums = F.aggregate(
                v,
                F.struct(F.lit(0.0).alias("s0"), F.lit(0).alias("n0"), F.lit(0.0).alias("s1"), F.lit(0).alias("n1")),
                lambda a, x: F.struct(
                    (a["s0"] + F.when(near(x), x).otherwise(0.0)).alias("s0"), (a["n0"] + near(x).cast("int")).alias("n0"), (a["s1"] + F.when(near(x), 0.0).otherwise(x)).alias("s1"), (a["n1"] + 1 - near(x).cast("int")).alias("n1")
                ),
            )
            means = bound(sums, lambda t: F.struct(F.when(t["n0"] > 0, t["s0"] / t["n0"]).otherwise(s["c0"]).alias("m0"), F.when(t["n1"] > 0, t["s1"] / t["n1"]).otherwise(s["c1"]).alias("m1")))
            moved = bound(
                means,
                lambda m: F.when((F.abs(m["m0"] - s["c0"]) < 1e-3) & (F.abs(m["m1"] - s["c1"]) < 1e-3), F.struct(s["c0"].alias("c0"), s["c1"].alias("c1"), F.lit(True).alias("done"))).otherwise(
                    F.struct(m["m0"].alias("c0"), m["m1"].alias("c1"), F.lit(False).alias("done"))
                ),
            )
            return F.when(s["done"], s).otherwise(moved)

        start = F.struct(F.coalesce(F.get(v, F.lit(0)), F.lit(0.0)).alias("c0"), F.coalesce(F.get(v, F.size(v) - 1), F.lit(1.0)).alias("c1"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step)

    return bound(F.array_sort(values), rounds)


def _within(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def word_break_threshold(gaps: Column, variant: str = "geometry") -> Column:
    """The gap, in character widths, from which a line breaks words.  Two variants: ``geometry`` and ``statistical``."""

    def figures(g: Column) -> Column:
        at = lambda share: F.coalesce(F.get(g, F.least(F.size(g) - 1, F.floor(F.size(g) * share)).cast("int")), F.lit(0.0))
        c = two_means(g)
        shares = [at(s).alias(n) for n, s in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9))]
        return F.struct(F.size(g).alias("n"), F.coalesce(F.get(g, F.lit(0)), F.lit(0.0)).alias("one"), *shares, c.alias("c"))

    def chosen(f: Column) -> Column:
        one, p25, p50, p75, p90 = (f[k] for k in ("one", "p25", "p50", "p75", "p90"))
        small, large = F.least(f["c"]["c0"], f["c"]["c1"]), F.greatest(f["c"]["c0"], f["c"]["c1"])
        flat = (large - small < 0.12) | (F.when(small > 0, large / small).otherwise(large) < 1.5)
        middle = (small + large) / 2
        if variant == "geometry":
            single = F.when(one >= 0.55, _within(one * 0.85, 0.25, 1.2)).when(one >= 0.25, 0.35).otherwise(0.65)
            unclear = F.when((p90 >= 0.38) & (p50 <= 0.18), _within((p50 + p90) / 2, 0.25, 1.1)).when(p50 >= 0.35, _within(p50 * 0.9, 0.25, 1.1)).otherwise(_within(p90 * 0.9, 0.25, 1.25))
            clear = _within(F.greatest(middle, p75 * 0.85), 0.25, 1.35)
        else:
            single = F.when(one >= 0.18, _within(one * 0.85, 0.2, 0.95)).otherwise(_within(one * 1.25, 0.95, 1.6))
            unclear = F.when(p50 >= 0.42, _within(p50 * 0.9, 0.28, 0.95)).otherwise(_within(p90 * 1.15, 0.95, 1.6))
            clear = _within(F.greatest(middle, p75 * 0.9), 0.5, 1.35)
        many = F.when(p25 >= 0.32, _within(p25 * 0.9, 0.28, 0.95)).when(flat, unclear).otherwise(clear)
        return F.when(f["n"] == 0, 0.95).when(f["n"] == 1, single).otherwise(many)

    usable = F.array_sort(F.transform(F.filter(gaps, lambda x: x >= 0), lambda x: _within(x, 0.0, 6.0)))
    return bound(bound(usable, figures), chosen)
