"""Vectorised hashing of words and shingles, and two tables of bounded size that every row of a DataFrame feeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random 64-bit value for each byte.
_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, U, endpoint=False) | U(1)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ U((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, i < n, modulo 2 ** 64."""
    if len(_powers["up"]) < n:
        n = max(n, 1 << 19)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """Hash of each span of bytes; equal spans have equal hashes wherever they are."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def chunks(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of about ``most`` bytes together; a longer text is a range of its own."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if texts:
        yield start, len(texts)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``size`` words ([^\\x20\\x09-\\x0D]+, A-Z lowered).

    A text of fewer words, but at least one, has its whole sequence as one shingle.
    """
    for a, b in chunks(texts):
        part = [t.translate(_LOWER) for t in texts[a:b]]
        raw = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        edge = np.diff(np.concatenate(([1], _SPACE[raw].view(np.int8))))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        hashes = span_hashes(raw, starts, ends)
        limits = np.cumsum([0] + [len(t) + 1 for t in part])
        first = np.searchsorted(starts, limits)
        if len(hashes) >= size:
            n = len(hashes) - size + 1
            joined = np.zeros(n, U)
            for k in range(size):
                joined = joined * U(0x2545F4914F6CDD1D) + hashes[k : k + n]
            joined = mixed(joined, size)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= size:
                yield np.unique(joined[lo : hi - size + 1])
            elif hi > lo:
                one = np.zeros(1, U)
                for h in hashes[lo:hi]:
                    one = one * U(0x2545F4914F6CDD1D) + h
                yield mixed(one, int(hi - lo) - size)  # another salt: never a full shingle
            else:
                yield np.zeros(0, U)


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words ([^\\x20\\x09-\\x0D]+, A-Z lowered), in order."""
    for a, b in chunks(texts):
        part = [t.translate(_LOWER) for t in texts[a:b]]
        raw = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        edge = np.diff(np.concatenate(([1], _SPACE[raw].view(np.int8))))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        hashes = span_hashes(raw, starts, ends)
        first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in part]))
        yield from (hashes[lo:hi] for lo, hi in zip(first[:-1], first[1:], strict=True))


def binary(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def counted(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """How many hashes of all rows fall into each of 2 ** bits cells.  Partitions send sums; the driver gets one number a cell."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.int64)
        for batch in batches:
            cells += np.bincount((hashes(batch) >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "n"])

    rows = df.mapInArrow(released(each), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits, np.int64)
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def bloom(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """Two bits in a map of 2 ** bits for each key of all rows: a superset of fixed size, however many rows there are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            for at in _cells(keys(batch), bits):
                seen[at] = True
        words = np.packbits(seen).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["cell", "word"])

    rows = df.mapInArrow(released(each), "cell long, word long").groupBy("cell").agg(F.bit_or("word").alias("word")).toPandas()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[rows["cell"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64)
    return out


def _cells(x: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mixed(x, salt) >> U(64 - bits)).astype(np.int64) for salt in (1, 2)]


def in_bloom(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which keys may be in the map; the map stays packed."""
    packed = words.view(np.uint8)
    hit = np.ones(len(x), bool)
    for at in _cells(x, (len(packed) * 8).bit_length() - 1):
        hit &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return hit


def maybe_in(words, column: Column) -> Column:
    """A condition on a long column: false only if the broadcast map does not hold it; null is false."""

    @F.pandas_udf("boolean")
    def maybe(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in keys:
            there = x.notna().to_numpy()
            yield pd.Series(there & in_bloom(words.value, x.fillna(0).to_numpy(np.int64).view(U)))

    return maybe(column)


def numbers(column: pa.Array) -> np.ndarray:
    """A long column without nulls as unsigned numbers."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(U)


def map_bits(n: int) -> int:
    """Size of a map for n keys: 16 bits each, from 2 ** 16 to 2 ** 28 bits (32 MB)."""
    return min(28, max(16, int(16 * n).bit_length()))
