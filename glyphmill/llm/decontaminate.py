"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered.  Each item gives its windows of ten
consecutive words; an item with fewer words, but at least one, is one window.  A text is normalised once to
`` w1 w2 ... wn ``, read once by the automaton, and every occurrence is mapped back to word numbers and to code points
of the original text.

Edge cases: a null or wordless text has no words, no hits and no items; an empty benchmark hits nothing; items with a
null id take part as the id ``null``; repeated rows each get the same result; an input column named like a result is
replaced by the result.  The benchmark is sent to executors in blocks of at most ``block_bytes`` of UTF-8 text each: one
block when it is small (the usual case), else one automaton and one scan for each block, merged by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, with_results

WINDOW = 10
BLOCK_BYTES = 16 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def windows_of(items: list[tuple[str, str | None]], size: int = WINDOW) -> dict[bytes, tuple[str, ...]]:
    """Each window, spaced at both ends, with the ids of its items."""
    out: dict[bytes, set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            out.setdefault(b" " + b" ".join(words[i : i + size]) + b" ", set()).add(item)
    return {k: tuple(sorted(v)) for k, v in out.items()}


class Scanner:
    """The automaton, over bytes read as Latin-1 so that offsets are byte offsets of the normalised text."""

    def __init__(self, windows: dict[bytes, tuple[str, ...]]):
        self.auto = ahocorasick.Automaton()
        for key, items in windows.items():
            self.auto.add_word(key.decode("latin-1"), (len(key), items))
        if windows:
            self.auto.make_automaton()
        self.any = bool(windows)

    def scan(self, text: str | None) -> tuple[int, np.ndarray | None, set[str]]:
        """Number of words, which of them are hit (None: none), and the items that occur."""
        words = words_of(text)
        if not words or not self.any:
            return len(words), None, set()
        line = b" " + b" ".join(words) + b" "
        found = list(self.auto.iter(line.decode("latin-1")))
        if not found:
            return len(words), None, set()
        ends = np.array([e for e, _ in found])
        lengths = np.array([v[0] for _, v in found])
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)  # the i-th space stands before word i
        turns = np.zeros(len(words) + 1, np.int64)
        np.add.at(turns, np.searchsorted(gaps, ends - lengths + 1), 1)
        np.add.at(turns, np.searchsorted(gaps, ends), -1)
        return len(words), np.cumsum(turns[:-1]) > 0, {i for _, v in found for i in v[1]}


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Hit runs as code points of the original text, end exclusive."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    is_word = np.frombuffer(_LOWER, np.uint8)[raw] != 32
    edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    runs = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1), strict=True)]


RUN = "struct<start:long,end:long,since:long,until:long>"  # words, then code points of the original
_RESULT = f"n_words long, items array<string>, runs array<{RUN}>"


def _scan_column(text: Column, items: list[tuple[str, str | None]], df: DataFrame, size: int) -> Column:
    sent = df.sparkSession.sparkContext.broadcast(items)  # at most block_bytes of text

    @F.pandas_udf(_RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(windows_of(sent.value, size))
        for texts in batches:
            rows = []
            for text in texts:
                n, hit, names = scanner.scan(text)
                if hit is None:
                    rows.append((n, [], []))
                    continue
                edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
                runs = zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), spans_of(text, hit), strict=True)
                rows.append((n, sorted(names), [{"start": int(a), "end": int(b), "since": c, "until": e} for a, b, (c, e) in runs]))
            yield pd.DataFrame(rows, columns=["n_words", "items", "runs"])

    return scan(text)


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[list[tuple[str, str | None]]]:
    """The benchmark in blocks that are each read to the driver within the bound; a longer single item is a block."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    parts = []
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        parts.append(sorted((r.item, r.text) for r in part.select("item", "text").distinct().collect() if r.text))
    return parts


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items (array of ids that occur), spans (hit code points of the original) and contaminated."""
    blocks = _blocks(benchmark, item, item_text, block_bytes)
    got = free_name(docs, "scanned")
    out, names = docs, []
    for i, block in enumerate(blocks):  # one, unless the benchmark is beyond block_bytes
        names.append(free_name(out, f"{got}{i}"))
        out = out.withColumn(names[-1], _scan_column(F.col(f"`{text}`"), block, docs, size))
    runs, items = F.col(f"{names[0]}.runs"), F.col(f"{names[0]}.items")
    if len(names) > 1:
        runs = _merged(F.array_sort(F.concat(*[F.col(f"{n}.runs") for n in names])))
        items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}.items") for n in names]))))
    n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    spans = F.transform(runs, lambda x: F.struct(x["since"].alias("start"), x["until"].alias("end")))
    return with_results(out, {"n_words": F.col(f"{names[0]}.n_words"), "n_hit": n_hit, "items": items, "spans": spans, "contaminated": n_hit > 0}).drop(*names)


def _merged(runs: Column) -> Column:
    """Sorted runs, those that meet or overlap in one."""

    def step(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["since"].alias("since"), F.greatest(last["until"], x["until"]).alias("until"))
        return F.when((F.size(a) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(runs, F.array().cast(f"array<{RUN}>"), step)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def brute_force(docs: list[tuple], items: list[tuple], size: int = WINDOW) -> list[tuple]:
    """The same, window by window, for tests."""
    import re

    def words(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)

    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            k = words(t)
            for i in range(max(1, len(k) - size + 1) if k else 0):
                win = k[i : i + size]
                for j in range(len(w) - len(win) + 1):
                    if w[j : j + len(win)] == win:
                        hit |= set(range(j, j + len(win)))
                        names.add("null" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out
