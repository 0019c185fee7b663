import math
import re

from pyspark.sql.functions import lit

from glyphmill.llm import mixing as m


def water(sizes):
    """Targets by repeated sharing."""
    weight = {k: i % 3 + 1 for i, k in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [k for k in sizes if k not in fixed]
        if not free:
            return fixed
        unit = (total - sum(fixed.values())) / sum(weight[k] for k in free)
        over = [k for k in free if unit * weight[k] > 3 * sizes[k]]
        if not over:
            return fixed | {k: unit * weight[k] for k in free}
        fixed |= {k: 3 * sizes[k] for k in over}


def test_targets_and_taken(spark):
    rows = [(i, "w " * (i * 7919 % 97), ["a", "b", "c", "d", None][0 if i % 3 else i % 5], "x") for i in range(3000)]
    rows += [(None, None, "a", "y"), (7, "one two", "empty", "z"), (7, "one two", "empty", "z"), (8, "", "none", "z"), (9, "v " * 50000, "big", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Target string").withColumn("p", lit(1)).withColumn("rest", lit(2)).repartition(7)
    old, m.BUCKET_ROWS = m.BUCKET_ROWS, 50
    try:
        got, again = m.mix(df).collect(), m.mix(df.coalesce(1)).collect()
    finally:
        m.BUCKET_ROWS = old
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes, taken, most = {}, {}, {}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r.size)
    want = water(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
    for k in want:
        assert abs(taken[k] - want[k]) <= most[k] + 1e-6


def test_learned_weights_decide_the_fractional_epoch(spark):
    """Of two kinds of documents, those whose labels are good are drawn first by far; SQL gives the same rows."""
    import duckdb
    import pandas as pd

    rows = [(i, ("1 2 3 4 % " if i % 2 else "plain words of a text ") * (2 + i % 5), "ab"[i % 4 // 2]) for i in range(4000)] + [(None, None, None), (4001, "", "a")]
    labels = [(i, int(i % 2 == 0)) for i in range(0, 4000, 3)] + [(3, None), (None, 1), (99999, 1), (6, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = m.digest(m.mix(docs, known)).collect()
    some = [r for r in got if r.source_size and 0 < r.target % r.source_size]
    whole = lambda r: int(r.target // r.source_size) * r.size
    part = {k: sum(r.taken > whole(r) for r in some if r.size and r.doc_id is not None and r.doc_id % 2 == k) for k in (0, 1)}
    assert part[0] > 3 * part[1]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality"]).astype("Int64"))
    key = lambda x: tuple("null" if v is None else f"{v:.9g}" for v in x)
    assert sorted(map(key, got)) == sorted(map(key, con.sql(m.ORACLE).fetchall()))


def test_empty_table(spark):
    assert m.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
