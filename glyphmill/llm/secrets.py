"""Secret scan: fixed patterns, plus tokens that a battery of randomness tests finds, all in DataFrame functions.

Fixed kinds: assign, access and hex (below).  The method's kind, ``random``, looks at every maximal run of 20 or more of
either base64 alphabet, ``[A-Za-z0-9+/]`` and ``[A-Za-z0-9_-]``, with its padding, and at what the fixed spans leave of it;
so a run ends at an inner ``=``, and a path is also cut at ``/``.  An encoding is inferred from the characters (hex, base32,
base36, base62, base64); of accepted runs, one within another is left out.  Against the hypothesis "ordinary text" it asks
three questions, each as a test of equivalence with a uniform random string whose power grows with the token's length n
over k symbols:

* uniformity: by chi-squared (two letters of ordinary text are equal with probability LETTER_MASS, less in mixed case; the
  statistic is n * (mass * k - 1), or LEAST_AWAY * n, above that of a uniform string; lower tail of that non-central law)
  and by the number of changes between digits and other characters (CHANGES of all steps in ordinary text; upper tail).
  Both speak against the same hypothesis, so their normal scores are added; the better of chi-squared alone and of the sum
  counts, doubled (Bonferroni);
* runs about the alphabet's middle: ordinary patterns change sides nearly never or nearly always;
* first-order serial correlation: ordinary patterns stray by MARGIN.  For both the p-value is the tail of sqrt(n) *
  (MARGIN - |estimate|) in standard units.

The largest of the three is the token's p-value (an intersection-union test).  False discoveries are held at FDR over all
candidates of all documents by Benjamini-Hochberg, with length-aware weights proportional to n * log2(k) and of mean one.
Its threshold comes from a histogram of the weighted p-values over all documents with a fixed number of bins.

Matches are located by running totals of the lengths of matches and gaps, and spans are subtracted and merged in sorted
order, so the work grows with the text and not with the square of its matches.  Texts are scanned once; the candidates
are written beside them, and the threshold is applied to what was written.

Edge cases: null and empty texts have no spans; repeated rows are each scanned; ties in the order of spans go by kind as
listed, then end; no candidate anywhere means no random spans; columns named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, free_name, running, with_results, written

#: The patterns of the contract, as Java writes them; (kind, pattern, group, least length).
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
KINDS = ("assign", "access", "hex", "random")
CANDIDATES = tuple(rf"([A-Za-z0-9{marks}]{{20,}}(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?)" for marks in ("+/", "_-"))
LETTER_MASS, MIXED_MASS, LEAST_AWAY, CHANGES, MARGIN, FDR, BINS = 0.065, 0.045, 0.5, 0.15, 0.9, 0.05, 4000
SPAN = "struct<start:int,kind:int,end:int>"


def _matches(text: Column, pattern: str, group: int = 1) -> Column:
    """Matches, leftmost and non-overlapping, as array<struct<start, end, token, n>>: places in code points, the match and its group's length."""

    def placed(m: Column) -> Column:
        ends = running(F.zip_with(F.slice(m["gaps"], 1, F.size(m["whole"])), m["whole"], lambda g, w: F.length(g) + F.length(w)), lambda x, y: x + y)
        return bound(
            ends,
            lambda e: F.transform(
                m["whole"],
                lambda w, i: F.struct((F.get(e, i) - F.length(w)).alias("start"), F.get(e, i).alias("end"), w.alias("token"), F.length(F.get(m["value"], i)).alias("n")),
            ),
        )

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group != 1 else whole
    found = bound(F.struct(whole.alias("whole"), value.alias("value"), F.split(text, pattern, -1).alias("gaps")), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,token:string,n:int>>"))


def _found(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the matches; those whose group is too short are dropped afterwards."""
    kept = F.filter(_matches(text, pattern, group), lambda m: m["n"] >= least)
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_found(text, i, *rest) for i, (_, *rest) in enumerate(BASE)]))


#: Encodings from the narrowest: (pattern of the whole token, alphabet).
_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "[0-9a-f]*", _DIGITS + "abcdef"),
    ("hex", "[0-9A-F]*", _DIGITS + "ABCDEF"),
    ("base32", "[A-Z2-7]*", _UP + "234567"),
    ("base36", "[a-z0-9]*", _LOW + _DIGITS),
    ("base36", "[A-Z0-9]*", _UP + _DIGITS),
    ("base62", "[A-Za-z0-9]*", _UP + _LOW + _DIGITS),
    ("base64", "[A-Za-z0-9+/]*", _UP + _LOW + _DIGITS + "+/"),
    ("base64", "[A-Za-z0-9_-]*", _UP + _LOW + _DIGITS + "-_"),
)


def _normal(z: Column) -> Column:
    """The standard normal distribution function, by the logistic approximation 1 / (1 + exp(-1.5976 z - 0.07056 z^3))."""
    z = F.greatest(F.least(z, F.lit(9.0)), F.lit(-9.0))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def battery(token: Column) -> Column:
    """struct<encoding, n, k, p> of a token; p is null where the characters show no encoding (mixed marks, padding alone)."""

    def encoded(body: Column) -> Column:
        found = F.lit(None).cast("struct<name:string,letters:string>")
        for label, pattern, letters in reversed(ENCODINGS):
            found = F.when(body.rlike(f"^{pattern}$"), F.struct(F.lit(label).alias("name"), F.lit(letters).alias("letters"))).otherwise(found)
        return bound(F.when(F.length(body) >= 20, found), lambda e: tested(body, e))

    def tested(body: Column, e: Column) -> Column:
        values = F.transform(F.split(body, ""), lambda c: (F.instr(e["letters"], c) - 1).cast("double"))
        digits = F.transform(F.split(F.regexp_replace(F.regexp_replace(body, "[^0-9]", "a"), "[0-9]", "0"), ""), lambda c: c == "0")
        mass = F.when(F.instr(e["letters"], "a").cast("boolean") & F.instr(e["letters"], "A").cast("boolean"), MIXED_MASS).otherwise(LETTER_MASS)
        facts = F.struct(F.length(e["letters"]).cast("double").alias("k"), values.alias("values"), digits.alias("digits"), mass.alias("mass"))
        p = F.when(e.isNotNull(), bound(facts, _p_value))
        return F.struct(e["name"].alias("encoding"), F.length(body).alias("n"), F.length(e["letters"]).cast("double").alias("k"), p.alias("p"))

    return bound(F.regexp_replace(token, "={1,2}$", ""), encoded)


def _p_value(t: Column) -> Column:
    k, v, digits = t["k"], t["values"], t["digits"]
    n = F.size(v).cast("double")
    zero = F.lit(0.0)
    counts = F.transform(F.array_distinct(v), lambda s: F.size(F.filter(v, lambda x: x == s)).cast("double"))
    chi = F.aggregate(counts, zero, lambda a, c: a + c * c) * k / n - n
    df, nc = k - 1, n * F.greatest(t["mass"] * k - 1, F.lit(LEAST_AWAY))
    z_chi = (chi - df - nc) / F.sqrt(2 * (df + 2 * nc))
    steps = F.sequence(F.lit(0), F.size(v) - 2)
    share = lambda differs: F.aggregate(steps, zero, lambda a, i: a + F.when(differs(i), 1.0).otherwise(0.0)) / (n - 1)
    z_changes = (CHANGES - share(lambda i: F.get(digits, i) != F.get(digits, i + 1))) * F.sqrt((n - 1) / (CHANGES * (1 - CHANGES)))
    p_uniform = F.least(F.lit(1.0), 2 * F.least(_normal(z_chi), _normal((z_chi + z_changes) / F.sqrt(F.lit(2.0)))))
    middle = (k - 1) / 2
    p_runs = _normal(-F.sqrt(n) * (MARGIN / 2 - F.abs(share(lambda i: (F.get(v, i) > middle) != (F.get(v, i + 1) > middle)) - 0.5)) / 0.5)
    spread = (k * k - 1) / 12
    serial = F.aggregate(steps, zero, lambda a, i: a + (F.get(v, i) - middle) * (F.get(v, i + 1) - middle)) / ((n - 1) * spread)
    p_serial = _normal(-F.sqrt(n) * (MARGIN - F.abs(serial)))
    return F.greatest(p_uniform, p_runs, p_serial)


_PIECES = "array<struct<start:int,back:int,token:string>>"


def _left(matches: Column, spans: Column, least: int = 20) -> Column:
    """What the spans leave of the matches, pieces of ``least`` or more: array<struct<start, back, token>>, back the negative end."""

    def point(at: Column, match: Column | int, span: int, number: Column | int) -> Column:
        as_int = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
        return F.struct(at.alias("at"), as_int(match).alias("match"), as_int(span).alias("span"), as_int(number).alias("number"))

    def cut(points: Column) -> Column:
        total = lambda c: running(F.transform(points, lambda p: p[c]), lambda x, y: x + y)
        last = running(F.transform(points, lambda p: p["number"]), lambda x, y: F.greatest(x, y))
        return bound(F.struct(total("match").alias("match"), total("span").alias("span"), last.alias("number")), lambda now: between(points, now))

    def between(points: Column, now: Column) -> Column:
        sections = F.transform(
            F.sequence(F.lit(0), F.size(points) - 2),
            lambda i: F.struct(F.get(points, i)["at"].alias("start"), F.get(points, i + 1)["at"].alias("end"), F.get(now["number"], i).alias("number"), ((F.get(now["match"], i) > 0) & (F.get(now["span"], i) == 0)).alias("free")),
        )
        kept = F.filter(sections, lambda s: s["free"] & (s["end"] - s["start"] >= least))
        return F.transform(
            kept,
            lambda s: bound(
                F.get(matches, s["number"] - 1), lambda m: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.substr(m["token"], s["start"] - m["start"] + 1, s["end"] - s["start"]).alias("token"))
            ),
        )

    ends = F.transform(matches, lambda m, i: F.array(point(m["start"], 1, 0, i + 1), point(m["end"], -1, 0, 0)))
    marks = F.transform(spans, lambda s: F.array(point(s["start"], 0, 1, 0), point(s["end"], 0, -1, 0)))
    plain = F.transform(matches, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), m["token"].alias("token")))
    return F.when((F.size(matches) == 0) | (F.size(spans) == 0), plain).otherwise(bound(F.array_sort(F.flatten(F.concat(ends, marks))), cut)).cast(_PIECES)


def _candidates(text: Column, base: Column) -> Column:
    """Candidate tokens apart from the fixed spans, with their p-values, in the order of starts, longest first: array<struct<start, end, encoding, bits, p>>."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.array_sort(F.concat(*[bound(_matches(text, pattern), lambda m: _left(m, base)) for pattern in CANDIDATES]))
    once = bound(pieces, lambda all_: F.filter(all_, lambda p, i: (i == 0) | (p["start"] != F.get(all_, i - 1)["start"]) | (p["back"] != F.get(all_, i - 1)["back"])))
    tested = F.transform(
        once,
        lambda p: bound(
            battery(p["token"]),
            lambda t: F.struct(p["start"].alias("start"), (-p["back"]).alias("end"), t["encoding"].alias("encoding"), (t["n"] * F.log2(t["k"])).alias("bits"), t["p"].alias("p")),
        ),
    )
    return F.filter(tested, lambda t: t["p"].isNotNull())


def _cut(tested: DataFrame, column: str) -> tuple[float, float]:
    """The mean weight, and the largest weighted p-value that Benjamini-Hochberg at FDR accepts (-1: none).

    Only BINS + 1 counts come to the driver, however many candidates there are; p is rounded up to its bin.
    """
    each = tested.select(F.explode(column).alias("c")).select("c.*")
    mean = each.agg(F.avg("bits")).first()[0]
    if not mean:
        return 1.0, -1.0
    scale = BINS / 40.0
    bins = each.select(F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(-F.ln(F.greatest(F.col("p") * mean / F.col("bits"), F.lit(1e-18))) * scale))).alias("bin")).groupBy("bin").count().collect()
    total, seen, cut = sum(r["count"] for r in bins), 0, -1.0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        seen += r["count"]
        upper = 2.718281828459045 ** (-r["bin"] / scale)
        if upper <= FDR * seen / total:
            cut = max(cut, upper)
    return float(mean), cut


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base_spans and spans: array<struct<start, kind, end>>, kind an index into KINDS."""
    base, tested = free_name(docs, "base_"), free_name(docs, "tested_")
    found = docs.withColumn(base, base_spans(F.col(f"`{text}`"))).withColumn(tested, _candidates(F.col(f"`{text}`"), F.col(base)))
    found = written(found, "secrets")
    mean, cut = _cut(found, tested)
    accepted = F.filter(F.col(tested), lambda c: c["p"] * mean / c["bits"] <= cut)
    # sorted by start, longest first: one lies within another if an earlier one ends there or later
    outer = lambda a: bound(running(F.transform(a, lambda c: c["end"]), lambda x, y: F.greatest(x, y)), lambda e: F.filter(a, lambda c, i: (i == 0) | (F.get(e, i - 1) < c["end"])))
    random = F.transform(bound(accepted, outer), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    spans = F.when(F.size(tested) == 0, F.col(base)).otherwise(F.array_sort(F.concat(F.col(base), random)))
    return with_results(found, {"base_spans": F.col(base), "spans": spans}).drop(base, tested)


def _spelled(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_spelled(F.col("base_spans")), 256).alias("base_sha256"), _spelled(F.col("spans")).alias("spans"))


#: Code points that a text is cut into before pieces of it are taken: Spark walks a string to find a place in it.
BLOCK = 4096


def _between(text: Column, spans: Column) -> Column:
    """The text with ``[SECRET]`` in place of each span; spans in order, none overlapping."""

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        """Code points start to end, of the blocks that they lie in."""
        which = F.sequence(F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int"))
        part = lambda b: F.substr(F.get(blocks, b), F.greatest(start - b * BLOCK, F.lit(0)) + 1, F.least(end - b * BLOCK, F.lit(BLOCK)) - F.greatest(start - b * BLOCK, F.lit(0)))
        return F.when(end <= start, F.lit("")).otherwise(F.array_join(F.transform(which, part), ""))

    def joined(blocks: Column) -> Column:
        before = lambda s, i: piece(blocks, F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]), s["start"])
        head = F.array_join(F.transform(spans, lambda s, i: F.concat(before(s, i), F.lit("[SECRET]"))), "")
        return F.concat(head, piece(blocks, F.element_at(spans, -1)["end"], F.length(text)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int")), lambda b: F.substr(text, b * BLOCK + 1, F.lit(BLOCK)))
    return bound(blocks, joined)


def _merged(spans: Column) -> Column:
    """Overlapping spans as one; a span that only touches the next stays its own."""

    def starts(ends: Column) -> Column:
        first = F.filter(F.transform(spans, lambda s, i: F.when((i == 0) | (F.get(ends, i - 1) <= s["start"]), i)), lambda i: i.isNotNull())
        return bound(first, lambda f: F.transform(f, lambda i, j: F.struct(F.get(spans, i)["start"].alias("start"), F.get(ends, F.coalesce(F.get(f, j + 1), F.size(spans)) - 1).alias("end"))))

    return bound(running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y)), starts)


def masked(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` with each span, overlapping ones together, replaced by ``[SECRET]``."""
    t, spans = F.col(f"`{text}`"), F.col("spans")
    hidden = bound(spans, lambda s: bound(_merged(s), lambda m: _between(t, m)))
    return with_results(found, {text: F.when(F.size(spans) == 0, t).otherwise(hidden)}).select(*found.columns)
