"""Quality by importance resampling: the ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words are lowered; words and pairs of neighbouring words fall into 2 ** CELLS cells.  The raw model counts the n-grams of
all documents, the target model those of documents labelled good; a bounded sample of SAMPLE labelled rows (those with
the least hash of doc_id) fits it, every other one of them, all documents feed the raw model.  A document's ratio is the sum over its n-grams of log p_target -
log p_raw, divided by their number plus PRIOR: normalised for length, and drawn to nought where there is little text.

The sum of thousands of ratios would be far larger than any noise and resampling would be a threshold, so the ratio is
tempered: a logistic curve of it, fitted on the other half of the sample (with smoothed labels, so that its slope stays
finite), gives the share of good documents at each ratio.  That share is the importance weight p(text | good) / p(text), up
to a constant.  Documents are drawn without replacement in proportion to it: the k largest of log weight + Gumbel noise
(from a hash of seed, doc_id and text) are kept.  k is BUDGET times the expected number of good
documents, which is the sum of all weights.

Edge cases: a document without words is rejected; null labels and labels of unknown documents are passed over; without
labels of both kinds nothing is rejected but wordless texts; rows of one doc_id and text get one decision; an input
column named like a result is replaced by the result; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, released, trim, with_results, written
from .sketch import U, binary, chunks, mixed, span_hashes

CELLS = 16
SAMPLE = 20_000
SMOOTHING = 0.05
PRIOR = 8
BUDGET = 1.01
SEED = 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def grams(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Cells of the words and word pairs of each text."""
    for a, b in chunks(texts):
        part = [t.translate(_LOWER) for t in texts[a:b]]
        raw = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        edge = np.diff(np.concatenate(([1], _SPACE[raw].view(np.int8))))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        words = span_hashes(raw, starts, ends)
        pairs = mixed(words[:-1] * U(0x2545F4914F6CDD1D) + words[1:], 2) if len(words) > 1 else words[:0]
        first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in part]))
        shift = U(64 - CELLS)
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            yield np.concatenate((words[lo:hi] >> shift, pairs[lo : max(lo, hi - 1)] >> shift)).astype(np.int64)


def _models(docs: DataFrame, sent) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the raw and of the target model: 2 ** CELLS numbers each, summed over the cluster."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, good = sent.value
        raw, target = np.zeros(1 << CELLS, np.int64), np.zeros(1 << CELLS, np.int64)
        for batch in batches:
            wanted = np.isin(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), ids[good]) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            found = list(grams(binary(batch.column(1))))
            for model, some in ((raw, found), (target, [g for g, w in zip(found, wanted, strict=True) if w])):
                if some:
                    model += np.bincount(np.concatenate(some), minlength=1 << CELLS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["cell", "raw", "target"])

    rows = docs.mapInArrow(released(each), "cell long, raw long, target long").groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    out = np.zeros((2, 1 << CELLS))
    out[0, rows["cell"].to_numpy(np.int64)] = rows["raw"]
    out[1, rows["cell"].to_numpy(np.int64)] = rows["target"]
    return out[0], out[1]


def _ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw; the target model is mixed with SMOOTHING of the raw one, for cells that its sample does not show."""
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw))
    share = raw / raw.sum()
    p = (target / target.sum() + SMOOTHING * share) / (1 + SMOOTHING)
    return np.where(raw > 0, np.log(np.maximum(p, 1e-300)) - np.log(np.maximum(share, 1e-300)), 0.0)


def _score(docs: DataFrame, ratio: np.ndarray, text: Column) -> Column:
    """struct<n, total>: sum of log ratios over the n n-grams of a text."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)  # 2 ** CELLS numbers

    @F.pandas_udf("n long, total double")
    def score(texts: pd.Series) -> pd.DataFrame:
        sums = [(len(g), float(sent.value[g].sum())) for g in grams([(t or "").encode("utf-8", "surrogatepass") for t in texts])]
        trim()
        return pd.DataFrame(sums, columns=["n", "total"])

    return score(text)


def curve(ratios: np.ndarray, good: np.ndarray) -> tuple[float, float] | None:
    """(a, b) of the share of good documents 1 / (1 + exp(-a - b * ratio)): logistic regression by Newton steps on smoothed labels; None without both kinds."""
    n, m = int(good.sum()), int((~good).sum())
    if not n or not m:
        return None
    aim = np.where(good, (n + 1) / (n + 2), 1 / (m + 2))
    middle, width = ratios.mean(), max(float(ratios.std()), 1e-9)
    x = np.stack([np.ones(len(ratios)), (ratios - middle) / width])
    at = np.array([np.log((n + 1) / (m + 1)), 0.0])
    loss = lambda c: float((np.logaddexp(0, c @ x) - aim * (c @ x)).sum())
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-9 * np.eye(2), x @ (aim - p))
        size = 1.0
        while loss(at + size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at + size * step
        if float(np.abs(size * step).max()) < 1e-9:
            break
    return float(at[0] - at[1] * middle / width), float(at[1] / width)


def _fitted(scores: DataFrame, sample: pd.DataFrame) -> tuple[float, float] | None:
    """The curve over the labelled documents of ``sample``, which bounds what comes to the driver."""
    spark = scores.sparkSession
    known = scores.where("n > 0").join(F.broadcast(spark.createDataFrame(sample)), "doc_id").select((F.col("total") / (F.col("n") + PRIOR)).alias("ratio"), "good", "doc_id", "h").toPandas()
    known = known.sort_values(["doc_id", "h"])
    return curve(known["ratio"].to_numpy(float), known["good"].to_numpy(bool))


def _uniform(doc_id: Column, h: Column, seed: int) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"gumbel {seed}"), doc_id.cast("string"), h.cast("string"))), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def _least_of_top(keys: DataFrame, k: int) -> tuple[float, int] | None:
    """(key, tie) of the k-th largest row, by counting in bins of the range that holds it; None if all rows are among the k."""
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k >= n:
        return None
    bins = 4096
    inside = keys
    while n > bins and hi > lo:
        width = (hi - lo) / bins
        counts = {r["bin"]: r["count"] for r in inside.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("key") - lo) / width)).alias("bin")).count().collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b]:
                break
            k -= counts[b]
        part = inside.where(F.least(F.lit(bins - 1), F.floor((F.col("key") - lo) / width)) == b)
        lo, hi, m = part.agg(F.min("key"), F.max("key"), F.count("*")).first()
        inside, n = part, m
    row = inside.orderBy(F.desc("key"), F.desc("tie")).limit(k).orderBy("key", "tie").first()
    return row["key"], row["tie"]


def judge_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """``docs`` with log_weight (null without words) and kept."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.col(f"`{label}`") == 1).alias("good")).dropna().dropDuplicates(["doc_id"])
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()  # at most ``sample`` rows
    ids, good = picked["doc_id"].to_numpy(np.int64)[::2], picked["good"].to_numpy(bool)[::2]
    d, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    texts = docs.select(d.alias("doc_id"), t.alias("text"))
    ratio = _ratio(*_models(texts, spark.sparkContext.broadcast((ids, good))))
    scores = texts.select("doc_id", F.xxhash64("text").alias("h"), _score(docs, ratio, F.col("text")).alias("s"))
    scores = written(scores.select("doc_id", "h", "s.*"), "quality")
    fitted = _fitted(scores, picked[1::2]) if len(picked) > 1 else None

    def log_weight(s: Column) -> Column:
        if fitted is None:
            return F.when(s["n"] > 0, F.lit(0.0))
        z = fitted[0] + fitted[1] * s["total"] / (s["n"] + PRIOR)
        return F.when(s["n"] > 0, -F.log1p(F.exp(-F.greatest(z, F.lit(-60.0)))))

    def key(w: Column, one: Column, h: Column) -> Column:
        return F.struct((w - F.ln(-F.ln(_uniform(one, h, seed)))).alias("key"), F.xxhash64(one, h).alias("tie"))

    keyed = scores.select(log_weight(F.struct("n", "total")).alias("w"), "doc_id", "h").where("w is not null").select("w", key(F.col("w"), F.col("doc_id"), F.col("h")).alias("k")).select("w", "k.*")
    # in whole billionths, so that the order of the sum does not matter
    k = round(budget * float(keyed.agg(F.sum(F.round(F.exp("w") * 1e9).cast("decimal(38,0)"))).first()[0] or 0) / 10**9)
    last = _least_of_top(keyed, k) if k else (float("inf"), 0)
    rows = free_name(docs, "judged")
    judged = docs.withColumn(rows, _score(docs, ratio, t))
    w = log_weight(F.col(rows))
    kept = F.lit(True) if last is None else key(w, d, F.xxhash64(t)) >= F.struct(F.lit(last[0]).alias("key"), F.lit(last[1]).cast("long").alias("tie"))
    return with_results(judged, {"log_weight": w, "kept": F.coalesce(w.isNotNull() & kept, F.lit(False))}).drop(rows)


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "log_weight", "kept")
