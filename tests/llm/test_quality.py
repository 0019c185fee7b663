import hashlib
import math
import random
from collections import Counter

import numpy as np
import xxhash

from glyphmill.llm import quality as q


def corpus(n=600):
    rng = random.Random(1)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}%%" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        junk = i % 6 == 0
        words = [rng.choice(bad if junk else good) for _ in range(rng.randint(3, 80))]
        if i % 9 == 0:  # between the two
            words = [rng.choice(rng.choice((good, bad))) for _ in words]
        rows.append((i, " ".join(words), "x"))
        if i % 2 == 0:
            labels.append((i, int(not junk)))
    return rows, labels


def long_hash(x):
    """Spark's xxhash64 of a long."""
    return xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), 42) - (1 << 64 if xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), 42) >> 63 else 0)


def brute_force(rows, labels, budget=q.BUDGET, seed=q.SEED):
    """(log weight, kept) of each row, with plain counters and a sort over everything."""
    cells = [list(next(q.grams([(t or "").encode()]))) for _, t, *_ in rows]
    sample = sorted(labels, key=lambda x: (long_hash(x[0]), x[0]))
    target_ids, fit = {i for i, y in sample[::2] if y}, dict(sample[1::2])
    raw, target = Counter(c for g in cells for c in g), Counter(c for r, g in zip(rows, cells, strict=True) if r[0] in target_ids for c in g)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = {c: math.log((target[c] / n_target + q.SMOOTHING * raw[c] / n_raw) / (1 + q.SMOOTHING)) - math.log(raw[c] / n_raw) for c in raw}
    means = [sum(ratio[c] for c in g) / (len(g) + q.PRIOR) if g else None for g in cells]
    known = [(m, fit[r[0]]) for r, m in zip(rows, means, strict=True) if m is not None and r[0] in fit]
    n, m = sum(y for _, y in known), sum(1 - y for _, y in known)
    a, b = 0.0, 0.0
    for _ in range(200):  # Newton steps, short at first
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y in known:
            p = 1 / (1 + math.exp(-max(-60, min(60, a + b * x))))
            d, w = ((n + 1) / (n + 2) if y else 1 / (m + 2)) - p, p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + d, g1 + d * x, h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        s0, s1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        most = max(abs(s0), abs(s1), 1.0)
        a, b = a + s0 / most, b + s1 / most
    weights = [None if x is None else -math.log1p(math.exp(-(a + b * x))) for x in means]
    keys = []
    for (d, t, *_), w in zip(rows, weights, strict=True):
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        name = ":".join([f"gumbel {seed}", *([] if d is None else [str(d)]), str(h - (1 << 64 if h >> 63 else 0))])
        u = (int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        keys.append(None if w is None else w - math.log(-math.log(u)))
    k = round(budget * sum(math.exp(w) for w in weights if w is not None))
    top = sorted((x for x in keys if x is not None), reverse=True)[:k]
    return [(w, x is not None and k > 0 and x >= top[-1]) for w, x in zip(weights, keys, strict=True)]


def test_against_brute_force(spark):
    rows, labels = corpus()
    rows += [(1000, "", "n"), (1001, " \n ", "n"), (None, rows[1][1], "n"), (3, rows[3][1], "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Kept string")
    known = spark.createDataFrame(labels + [(None, 1), (5, None), (9999, 0)], "doc_id long, quality int")
    found = q.judge_quality(docs, known)
    assert found.columns == ["doc_id", "text", "log_weight", "kept"]
    got = sorted(((r.doc_id, r.text, r.log_weight, r.kept) for r in found.collect()), key=str)
    want = sorted(((r[0], r[1], *w) for r, w in zip(rows, brute_force(rows, labels + [(9999, 0)]), strict=True)), key=str)
    assert [(g[:2], g[3]) for g in got] == [(w[:2], w[3]) for w in want]
    assert all((g[2] is None) == (w[2] is None) and (g[2] is None or abs(g[2] - w[2]) < 1e-4) for g, w in zip(got, want, strict=True))
    assert got == sorted(((r.doc_id, r.text, r.log_weight, r.kept) for r in q.judge_quality(docs.repartition(3), known).collect()), key=str)
    clear = [g for g in got if g[0] is not None and g[0] < 600 and g[0] % 9]
    assert np.mean([g[3] for g in clear if "%%" not in g[1]]) > 0.9 and np.mean([g[3] for g in clear if "%%" in g[1]]) < 0.1


def test_null_text_and_no_words(spark):
    rows, labels = corpus(120)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(500, None), (501, " ")], "doc_id long, text string")
    got = {r.doc_id: (r.log_weight, r.kept) for r in q.judge_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got[500] == got[501] == (None, False)


def test_inclusion_follows_the_weight(spark):
    """Over many draws, documents are kept the more often the larger their weight, and neither always nor never between the two kinds."""
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, quality int")
    seen = {i: q.judge_quality(docs, known, seed=i, budget=0.5).select("doc_id", "log_weight", "kept").collect() for i in range(6)}
    draws = [(math.exp(r.log_weight), r.kept) for s in seen.values() for r in s]
    share = lambda lo, hi: np.mean([k for w, k in draws if lo <= w < hi])
    assert share(0, 0.05) < 0.03 < share(0.05, 0.6) < share(0.6, 1.01)
    assert 0.2 < share(0.6, 1.01) < 0.8  # half of the budget: good documents are drawn, not cut off
    assert len({frozenset(r.doc_id for r in s if r.kept) for s in seen.values()}) == 6


def test_top_k_is_exact(spark):
    rng = random.Random(2)
    keys = [rng.choice([rng.random(), 0.5]) for _ in range(9000)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key double, tie long")
    order = sorted(((k, i) for i, k in enumerate(keys)), reverse=True)
    for k in (1, 100, 4500, 8999):
        assert q._least_of_top(df, k) == order[k - 1]
    assert q._least_of_top(df, 9000) is None


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in q.judge_quality(docs, none).collect()} == {1: True, 2: False}
    assert q.judge_quality(docs.limit(0), none).count() == 0
