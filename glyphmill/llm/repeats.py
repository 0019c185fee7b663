"""Exact repeated passages by bucket-pointer refinement: removes each byte that a repeated 400-byte string covers.

A window is WINDOW units of one text.  A suffix array of the whole corpus is never sorted: the cluster deals windows to
q-gram buckets, and only buckets that hold different contents are refined.

1. Initial buckets are grams of a fifth of a window.  A window's bucket is its least gram (the leftmost of equals): equal
   windows have the same.  Neighbouring windows with the same least gram are a segment; one pass over the texts gives each
   segment's bucket and its content identifier (128 bits, hashed from the grams at later offsets).
2. Segments alone in their bucket have no repeat.  Segments of equal content are repeated as a whole, however many there
   are: only their count matters.
3. Buckets with several contents are refined: one witness of each content is fetched, its grams are ranked, and the ranks
   (bucket pointers) are refined by sorting on the pointers one gram, two grams and four grams later, each round reusing
   the pointers of the one before, until windows of one pointer are equal.  A bucket with more than BUCKET contents goes
   through a grouped count of hashed windows over the cluster instead.
4. A document's repeated windows cover its removed bytes.

The position of a segment does not matter for the result: it only needs that equal windows share a bucket and that no two
equal windows lie in one segment (they would have two least grams, and the leftmost decides).

The same search over words (``[^\\x20\\x09-\\x0D]+``, A-Z lowered; hashes of 64 bits as units) finds passages of PASSAGE
words or more that stand in another document too, whatever their length in bytes or their white space; they are
reported as n_shared_words and not removed.  Rows of one doc_id and text are one document there.

Edge cases: null and empty texts, and texts shorter than a window, lose nothing; repeated rows repeat each other; a null
doc_id is an id like others; matches never cross documents; an empty table gives no rows; an input column named like a
result is replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, released, with_results, written
from .sketch import U, binary, bloom, chunks, in_bloom, map_bits, maybe_in, mixed, numbers, powers, word_hashes

WINDOW = 400
PASSAGE = 51
BUCKET = 4000
_POSITION = 20
_MOST = 1 << 19
_LANES = np.random.Generator(np.random.PCG64(400)).integers(0, 1 << 64, (2, 256), U, endpoint=False) | U(1)


def _bytes(texts: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint8) for t in texts]


def _words(texts: list[bytes]) -> list[np.ndarray]:
    return list(word_hashes(texts))


#: What a window is counted in: how to cut texts, and the type of a unit.
UNITS = {"bytes": (_bytes, np.uint8), "words": (_words, U)}


def gram_of(window: int) -> int:
    return -(-window // 5)


class Ids:
    """Identifiers of the grams and windows of one buffer, in two lanes of 64 bits."""

    def __init__(self, raw: np.ndarray, window: int):
        self.window, self.gram, n = window, gram_of(window), len(raw) + 1
        self.up, self.down = powers(n)
        self.sums = np.zeros((2, n), U)
        for lane in (0, 1):
            values = _LANES[lane][raw] if raw.dtype == np.uint8 else mixed(raw, 41 + lane)
            np.cumsum(values * self.up[: n - 1], out=self.sums[lane, 1:])

    def grams(self, at: np.ndarray, lane: int) -> np.ndarray:
        sums = self.sums[lane]
        return mixed((sums[at + self.gram] - sums[at]) * self.down[at], lane)

    def windows(self, at: np.ndarray, lane: int) -> np.ndarray:
        """Pairs of identifiers at later offsets: 2 grams, 4 grams, then the last."""
        g = self.gram
        two = lambda x: self._pair(self.grams(x, lane), self.grams(x + g, lane))
        return self._pair(self._pair(two(at), two(at + min(2 * g, self.window - 2 * g))), self.grams(at + self.window - g, lane))

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed(a * U(0x9FB21C651E98DF25) + b, 9)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from running minima within blocks from both sides."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(U).max, U)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _pieces(texts: list[np.ndarray], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about half a million units: units, and for each text in it its number, its place in the buffer and the offset of its first unit there."""
    long = [i for i, t in enumerate(texts) if len(t) > _MOST]
    for a, b in chunks(texts, _MOST):
        which = [i for i in range(a, b) if window <= len(texts[i]) <= _MOST]
        if which:
            places = np.cumsum([0] + [len(texts[i]) for i in which])
            yield np.concatenate([texts[i] for i in which]), np.array(which), places, np.zeros(len(which), np.int64)
    for i in long:
        step = _MOST - window + 1
        for at in range(0, len(texts[i]) - window + 1, step):
            part = texts[i][at : at + _MOST]
            yield part, np.array([i]), np.array([0, len(part)]), np.array([at])


def segments(texts: list[bytes], window: int, unit: str) -> Iterator[dict[str, np.ndarray]]:
    """Segments of the texts: text number, start, n windows, bucket and content identifiers a, s1, s2, and place in ``raw``."""
    gram = gram_of(window)
    for raw, which, places, offsets in _pieces(UNITS[unit][0](texts), window):
        ids = Ids(raw, window)
        keys = ids.grams(np.arange(len(raw) - gram + 1), 0)
        ranked = (keys >> U(_POSITION) << U(_POSITION)) | np.arange(len(keys), dtype=U)
        least = _sliding_min(ranked, window - gram + 1) & U((1 << _POSITION) - 1)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[places[:-1]] += 1
        np.add.at(inside, places[1:] - window + 1, -1)
        at = np.flatnonzero(np.cumsum(inside[: len(least)]) > 0)
        anchors = least[at].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        start, n = at[first], np.diff(np.concatenate((first, [len(at)])))
        anchors = anchors[first]
        text = np.searchsorted(places, start, "right") - 1
        ends = start + n - 1
        shape = (n * 1024 + (anchors - start)).astype(U)
        s = [mixed(Ids._pair(ids.windows(start, lane), ids.windows(ends, lane)) + shape, 20 + lane) for lane in (0, 1)]
        yield {"text": which[text], "start": start - places[text] + offsets[text], "n": n, "a": keys[anchors], "s1": s[0], "s2": s[1], "raw": raw, "place": start}


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _witness(k: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mixed(k, 5) + start.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15)


def _found(docs: DataFrame, window: int, unit: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in segments(binary(batch.column(2)), window, unit):
                own = pa.array(s["text"])
                cols = [batch.column(0).take(own), batch.column(1).take(own), pa.array(s["start"].astype(np.int32)), pa.array(s["n"].astype(np.int32)), _long(s["a"]), _long(s["s1"]), _long(s["s2"])]
                yield pa.RecordBatch.from_arrays(cols, ["id", "k", "start", "n", "a", "s1", "s2"])

    return docs.mapInArrow(released(each), f"id {docs.schema['id'].dataType.simpleString()}, k long, start int, n int, a long, s1 long, s2 long")


def _contexts(docs: DataFrame, seen_map, window: int, unit: str) -> DataFrame:
    """Units of the witnesses' segments (and of a few others, which changes nothing: their contents occur too)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = numbers(batch.column(1))
            for s in segments(binary(batch.column(2)), window, unit):
                got = np.flatnonzero(in_bloom(seen_map.value, _witness(keys[s["text"]], s["start"])))
                raw, lo, hi = s["raw"], s["place"][got], s["place"][got] + s["n"][got] + window - 1
                spans = [raw[x:y].tobytes() for x, y in zip(lo, hi, strict=True)]
                yield pa.RecordBatch.from_arrays([_long(s["a"][got]), _long(s["s1"][got]), _long(s["s2"][got]), pa.array(spans, pa.binary())], ["a", "s1", "s2", "bytes"])

    return docs.mapInArrow(released(each), "a long, s1 long, s2 long, bytes binary")


def _laid_out(spans: list[bytes], window: int, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of the spans one after the other, where all their windows start, and where each span's windows begin among those."""
    raw = np.frombuffer(b"".join(spans), UNITS[unit][1])
    places = np.cumsum([0] + [len(x) // raw.itemsize for x in spans])
    counts = np.diff(places) - window + 1
    begin = np.cumsum(np.concatenate(([0], counts)))
    return raw, np.arange(begin[-1]) + np.repeat(places[:-1] - begin[:-1], counts), begin


def _pointers(raw: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Bucket pointers of the windows at ``at``: equal windows, equal pointers.  Ranks of grams, refined by ranks at later offsets."""
    ids = Ids(raw, window)
    g = ids.gram

    def refined(one: np.ndarray, two: np.ndarray, offset: int) -> np.ndarray:
        n = min(len(one), len(two) - offset)
        return np.unique(one[:n] * (int(two.max()) + 1) + two[offset : offset + n], return_inverse=True)[1]

    first = np.unique(ids.grams(np.arange(len(raw) - g + 1), 0), return_inverse=True)[1]
    second = refined(first, first, g)
    fourth = refined(second, second, min(2 * g, window - 2 * g))
    return refined(fourth, first, window - g)[at]


_SPANS = "array<struct<since:int,until:int>>"
_REFINED = f"s1 long, s2 long, spans {_SPANS}"


def _runs(flags: np.ndarray, begin: np.ndarray) -> list[list[dict]]:
    """Runs of set flags within each stretch."""
    out = []
    for lo, hi in zip(begin[:-1], begin[1:], strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], flags[lo:hi].view(np.int8), [0]))))
        out.append([{"since": int(x), "until": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
    return out


def _repeated(pointers: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which windows share their pointer with another owner: the owners of one pointer range from the least low to the greatest high."""
    least, most = np.full(int(pointers.max()) + 1, np.iinfo(np.int64).max), np.full(int(pointers.max()) + 1, np.iinfo(np.int64).min)
    np.minimum.at(least, pointers, low)
    np.maximum.at(most, pointers, high)
    return (least < most)[pointers]


def _refined(contexts: DataFrame, owners: DataFrame, window: int, unit: str, across: bool) -> DataFrame:
    """Repeated windows of each content, by refinement within buckets; partitions are sorted by bucket and read as a stream."""

    def some(rows: list[tuple]) -> pa.RecordBatch:
        owner = {r[:2]: r[3:] for r in rows if r[2] is None}
        rows = [r for r in {r[:2]: r for r in rows if r[2] is not None}.values() if r[:2] in owner]
        spans: list[list[dict]] = []
        if rows:
            raw, at, begin = _laid_out([r[2] for r in rows], window, unit)
            low, high = (np.array([owner[r[:2]][i] if across else j for j, r in enumerate(rows)], np.int64) for i in (0, 1))
            counts = np.diff(begin)
            spans = _runs(_repeated(_pointers(raw, at, window), np.repeat(low, counts), np.repeat(high, counts)), begin)
        keep = [i for i, s in enumerate(spans) if s]
        kind = pa.list_(pa.struct([("since", pa.int32()), ("until", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in keep], pa.int64()), pa.array([rows[i][1] for i in keep], pa.int64()), pa.array([spans[i] for i in keep], kind)], ["s1", "s2", "spans"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        last = None
        for batch in batches:
            for a, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != last and size > 1 << 20:  # whole buckets only
                    yield some(held)
                    held, size = [], 0
                held.append(tuple(row))
                size += len(row[2] or b"")
                last = a
        if held:
            yield some(held)

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("long")
    rows = contexts.select("a", "s1", "s2", "bytes", none.alias("low"), none.alias("high")).unionByName(owners.select("a", "s1", "s2", F.lit(None).cast("binary").alias("bytes"), "low", "high"))
    # by a hash of the bucket: Spark drops a deal by the bucket itself where both sides of the union were joined on it, and then
    # merges small partitions of each side on its own, so that contents and their owners part
    return rows.repartition(parts, F.xxhash64("a")).sortWithinPartitions("a").mapInArrow(released(each), _REFINED)


def _counted(scratch: Scratch, contexts: DataFrame, owners: DataFrame, window: int, unit: str, across: bool) -> DataFrame:
    """The same for large buckets: a grouped count of window identifiers, joined back."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                raw, at, begin = _laid_out(part.column(2).to_pylist(), window, unit)
                ids = Ids(raw, window)
                own = np.repeat(np.arange(part.num_rows), np.diff(begin))
                again = [part.column(i).take(pa.array(own)) for i in (0, 1, 3, 4)]
                yield pa.RecordBatch.from_arrays([_long(ids.windows(at, 0)), _long(ids.windows(at, 1)), *again, pa.array((np.arange(len(own)) - begin[own]).astype(np.int32))], ["w1", "w2", "s1", "s2", "low", "high", "at"])

    once = contexts.dropDuplicates(["s1", "s2"]).join(owners.select("s1", "s2", "low", "high"), ["s1", "s2"]).select("s1", "s2", "bytes", "low", "high")
    windows = scratch.written(once.mapInArrow(released(each), "w1 long, w2 long, s1 long, s2 long, low long, high long, at int"), "windows")
    again = windows.groupBy("w1", "w2").agg(F.count("*").alias("c"), F.min("low").alias("low"), F.max("high").alias("high")).where("low != high" if across else "c > 1").select("w1", "w2")
    spans = F.transform(F.collect_list("at"), lambda x: F.struct(x.alias("since"), (x + 1).alias("until")))
    return windows.join(again, ["w1", "w2"]).groupBy("s1", "s2").agg(spans.cast(_SPANS).alias("spans"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, bucket: int = BUCKET, unit: str = "bytes", across: bool = False) -> DataFrame:
    """docs(id, k, text) -> (id, k, spans): starts of repeated windows as ranges, for documents that have any.

    ``across``: only windows that another document (another k) has too.
    """
    with Scratch(docs.sparkSession) as scratch:
        some = _shared_segments(docs, window, unit, scratch)
        hits = _repeated_segments(docs, some, window, bucket, unit, across, scratch)
        return written(hits.groupBy("id", "k").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "repeats")


def _shared_segments(docs: DataFrame, window: int, unit: str, scratch: Scratch) -> DataFrame:
    """Segments whose bucket holds others too."""
    spark = docs.sparkSession
    with Scratch(spark) as first:
        found = first.written(_found(docs, window, unit), "segments")
        shared = first.written(found.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"), "buckets")
        sent = spark.sparkContext.broadcast(bloom(shared, lambda b: numbers(b.column(0)), map_bits(shared.count())))

        def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bloom(sent.value, numbers(batch.column(4)))))

        return scratch.written(found.mapInArrow(released(maybe), found.schema).join(shared, "a"), "candidates")


def _repeated_segments(docs: DataFrame, some: DataFrame, window: int, bucket: int, unit: str, across: bool, scratch: Scratch) -> DataFrame:
    """(id, k, spans) of the segments with a repeated window."""
    spark = docs.sparkSession
    contents = some.groupBy("a", "s1", "s2").agg(F.count("*").alias("c"), F.min(F.struct("k", "start")).alias("witness"), F.max("k").alias("high"))
    contents = contents.select("a", "s1", "s2", "witness", F.col("witness.k").alias("low"), "high", (F.col("witness.k") != F.col("high") if across else F.col("c") > 1).alias("whole"))
    contents = scratch.written(contents, "contents")
    # written, so that a bucket of many contents can be split in the join
    buckets = scratch.written(contents.groupBy("a").agg(F.count("*").alias("contents")).where("contents > 1"), "buckets")
    open_ = scratch.written(contents.join(buckets, "a").select("a", "s1", "s2", "low", "high", "witness.k", "witness.start", "contents"), "open")
    key = lambda b: _witness(numbers(b.column(0)), b.column(1).to_numpy())
    seen = spark.sparkContext.broadcast(bloom(open_.select("k", "start"), key, map_bits(open_.count())))
    contexts = scratch.written(_contexts(docs, seen, window, unit), "contexts")
    # written, so that Spark sees how small it is
    hot = scratch.written(open_.where(F.col("contents") > bucket).select("a").distinct(), "hot")
    if hot.isEmpty():
        refined = _refined(contexts, open_, window, unit, across)
    else:
        rest, large = ((contexts.join(hot, "a", how), open_.where(some)) for how, some in (("left_anti", F.col("contents") <= bucket), ("left_semi", F.col("contents") > bucket)))
        refined = _refined(*rest, window, unit, across).unionByName(_counted(scratch, *large, window, unit, across))
    refined = contents.select("s1", "s2", "whole").join(scratch.written(refined, "refined"), ["s1", "s2"], "left").where("whole or spans is not null")
    whole = F.array(F.struct(F.lit(0).alias("since"), F.col("n").alias("until"))).cast(_SPANS)
    spans = F.when(F.col("whole"), whole).otherwise(F.col("spans"))
    placed = F.transform(spans, lambda x: F.struct((x["since"] + F.col("start")).alias("since"), (x["until"] + F.col("start")).alias("until")))
    return some.join(scratch.written(refined, "repeated"), ["s1", "s2"]).select("id", "k", placed.alias("spans"))


def _cut(window: int):
    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, ranges in zip(text, spans, strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            turns = np.zeros(len(raw) + 1, np.int64)
            for r in ranges:
                turns[r["since"]] += 1
                turns[r["until"] + window - 1] -= 1
            gone = np.cumsum(turns[:-1]) > 0
            edge = np.diff(np.concatenate(([0], gone.view(np.int8))))
            out.append((int(gone.sum()), int((edge == 1).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    return cut


def _covered(spans, window: int):
    """How many units the windows of sorted spans cover."""
    state = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["until"], s["until"] + window - 1).alias("until"),
            (a["n"] + F.greatest(F.lit(0), s["until"] + window - 1 - F.greatest(a["until"], s["since"]))).cast("long").alias("n"),
        ),
    )
    return state["n"]


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, passage: int = PASSAGE, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) and n_shared_words."""
    spark = docs.sparkSession
    body, k = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), k.alias("k"), body.alias("text"))
    size = F.octet_length("text")
    repeated = repeated_windows(texts.where(size >= window), window, bucket)
    shared = repeated_windows(texts.where(size >= 2 * passage - 1), passage, bucket, "words", across=True)
    none = F.array().cast(_SPANS)
    hits = repeated.select("id", "k", "spans", F.lit(0).cast("long").alias("shared")).unionByName(shared.dropDuplicates(["id", "k"]).select("id", "k", none.alias("spans"), _covered(F.col("spans"), passage).alias("shared")))
    hits = written(hits.groupBy("id", "k").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.max("shared").alias("shared")), "hits")
    sent = spark.sparkContext.broadcast(bloom(hits.select("k"), lambda b: numbers(b.column(0)), map_bits(hits.count())))

    mine, flag, got = free_name(docs, "key"), free_name(docs, "maybe"), free_name(docs, "cut")
    rows = docs.withColumn(mine, k).withColumn(flag, maybe_in(sent, F.col(mine)))
    h = {c: free_name(docs, f"hit_{c}") for c in ("id", "k", "spans", "shared")}
    theirs = hits.select(*[F.col(c).alias(name) for c, name in h.items()])
    some = rows.where(F.col(flag)).join(theirs, (F.col(mine) == F.col(h["k"])) & F.col(f"`{doc_id}`").eqNullSafe(F.col(h["id"])), "left")
    some = some.withColumn(got, _cut(window)(body, F.coalesce(h["spans"], none)))
    n_bytes, zero = F.octet_length(body).cast("long"), F.lit(0).cast("long")
    some = with_results(some, {"n_bytes": n_bytes, **{c: F.col(f"{got}.{c}") for c in ("n_removed", "n_spans", "kept")}, "n_shared_words": F.coalesce(h["shared"], zero)}).drop(mine, flag, got, *h.values())
    rest = with_results(rows.where(~F.col(flag)), {"n_bytes": n_bytes, "n_removed": zero, "n_spans": zero, "kept": body.cast("binary"), "n_shared_words": zero}).drop(mine, flag)
    return some.unionByName(rest)


def digest(cut: DataFrame) -> DataFrame:
    """The contract's columns, and n_shared_words."""
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared_words")


def brute_force(docs: list[tuple], window: int = WINDOW, passage: int = PASSAGE) -> list[tuple]:
    """The same, window by window, for tests."""
    import hashlib
    import re
    from collections import Counter

    raws = [(d, (t or "").encode()) for d, t in docs]
    counts = Counter(r[i : i + window] for _, r in raws for i in range(len(r) - window + 1))
    split = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in docs]
    owners: dict[tuple, set] = {}
    for row, words in zip(docs, split, strict=True):
        for i in range(len(words) - passage + 1):
            owners.setdefault(tuple(words[i : i + passage]), set()).add(row)
    out = []
    for (d, r), words in zip(raws, split, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if counts[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        shared = {j for i in range(len(words) - passage + 1) if len(owners[tuple(words[i : i + passage])]) > 1 for j in range(i, i + passage)}
        out.append((d, len(r), sum(gone), bytes(gone).replace(b"\1\0", b"\1|\0").count(b"\1|") + gone.endswith(b"\1"), hashlib.sha256(kept).hexdigest(), len(shared)))
    return out
