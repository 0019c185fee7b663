"""Document fingerprints: quartile bucket digests of hashed byte triplets, compared by a bounded difference.

A window of five bytes gives six triplets (its first byte with two others); each is hashed to one of BUCKETS counts.  The
digest holds two bits a bucket (which quarter of the counts it is in), the ratios of the quartiles, the length on a log
scale and a check byte: 70 hex digits.  The difference of two digests adds the steps between buckets (from one extreme
quarter to the other counts double), ratios and lengths; at BOUND and beyond the likeness is 0, equal digests have 1.

Edge cases: a null text is empty; texts under five bytes have no triplets and all buckets in the lowest quarter; equal
texts have equal digests; rows of one doc_id go by text, and a null doc_id comes after all others, in "next document";
a single document is its own next; an empty table gives no rows; columns named like results are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import trim, written

BUCKETS = 128
BOUND = 400.0
#: Offsets of a triplet within the window of five bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Rows of one range of ids, between which "next document" crosses by a guest row.
RANGE_ROWS = 2000
MOST_RANGES = 50_000

_TABLES = np.random.Generator(np.random.PCG64(128)).integers(0, 1 << 32, (len(TRIPLETS), 3, 256), np.uint32, endpoint=False)


def counts_of(raw: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(raw) - 4, 0), 1 << 18):
        b = np.frombuffer(raw[at : at + (1 << 18) + 4], np.uint8)
        n = len(b) - 4
        for (i, j, k), (x, y, z) in zip(TRIPLETS, _TABLES, strict=True):
            mix = x[b[i : i + n]] + y[b[j : j + n]]
            mix ^= z[b[k : k + n]]
            mix *= np.uint32(0x9E3779B1)
            counts += np.bincount(mix >> np.uint32(25), minlength=BUCKETS)
    return counts


def digest_of(raw: bytes) -> str:
    counts = counts_of(raw)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = (codes.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    ratio = lambda q: int(q * 15 // q3) if q3 else 0
    length = min(255, int(np.log(len(raw)) / np.log(1.1))) if raw else 0
    check = int(np.frombuffer(raw, np.uint8).sum() * 167 % 251) if raw else 0
    return f"{check:02x}{length:02x}{ratio(q1):x}{ratio(q2):x}{body.tobytes().hex()}"


def likeness(a: pd.Series, b: pd.Series) -> np.ndarray:
    """1 - difference / BOUND, between 0 and 1."""
    x, y = (np.frombuffer(bytes.fromhex("".join(s)), np.uint8).reshape(len(s), -1).astype(np.int64) for s in (a, b))
    codes = lambda v: np.stack([v[:, 3:] >> s & 3 for s in (6, 4, 2, 0)], -1)
    steps = np.abs(codes(x) - codes(y))
    far = np.where(steps == 3, 6, steps).sum((1, 2))
    lengths = np.abs(x[:, 1] - y[:, 1])
    ratios = np.abs((x[:, 2] >> 4) - (y[:, 2] >> 4)) + np.abs((x[:, 2] & 15) - (y[:, 2] & 15))
    total = far + np.where(lengths <= 1, lengths, 4 * lengths) + 2 * ratios + (x[:, 0] != y[:, 0])
    return np.clip(1 - total / BOUND, 0, 1)


def fingerprint(text: Column) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        out = pd.Series([digest_of((t or "").encode("utf-8", "surrogatepass")) for t in texts])
        trim()
        return out

    return of(text)


def likeness_of(a: Column, b: Column) -> Column:
    return F.pandas_udf(lambda x, y: pd.Series(likeness(x, y)), "double")(a, b)


_LEAST = -(1 << 63)


def _ranges(rows: DataFrame) -> tuple[list[int], DataFrame]:
    """Cuts between ranges of ids, from all ids; rows with their range, counted from the highest ids."""
    n = rows.count()
    parts = min(MOST_RANGES, -(-n // RANGE_ROWS))
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(rows.agg(F.percentile_approx("o", shares, 20 * parts)).first()[0])) if shares else []
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("long")
    def place(o: pd.Series) -> pd.Series:
        return pd.Series(len(edges) - np.searchsorted(edges, o.to_numpy(np.int64)))

    return cuts, rows.withColumn("range", place("o"))


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint): the next document in descending doc_id, after the last the first.

    Each range of ids is one small group; the first document of the following range visits it as a guest, so the order
    holds across ranges without a global sort, and texts are shuffled once.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("o", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST).cast("long")))
    cuts, ids = _ranges(rows.select("o"))
    heads = ids.groupBy("range").agg(F.max("o").alias("o"))
    heads = written(heads, "heads")  # one row a range
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy()))
    visits = heads.select("o", before.alias("range"))
    guests = rows.join(F.broadcast(visits), "o").groupBy("o", "range").agg(F.min("text").alias("text"))  # at most MOST_RANGES rows of numbers
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("long")
    def place(o: pd.Series) -> pd.Series:
        return pd.Series(len(edges) - np.searchsorted(edges, o.to_numpy(np.int64)))

    own = rows.select("doc_id", "text", "o", place("o").alias("range"), F.lit(0).alias("guest"))
    guests = guests.select(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "text", "o", "range", F.lit(1).alias("guest"))
    both = own.unionByName(guests).withColumn("fingerprint", fingerprint(F.col("text")))
    order = Window.partitionBy("range").orderBy("guest", F.col("o").desc(), "text")
    return (
        both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("guest = 0").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    )


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's columns."""
    rows = with_next(docs, doc_id, text)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    like = lambda other: likeness_of(F.col("fingerprint"), F.col(other))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
