"""Mixing sources to target weights by Efraimidis-Spirakis sampling, all in DataFrame functions.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the budget, the total of all sizes;
no target is above ``most`` times its source's size, the excess goes to the others by weight.  A source takes its whole
epochs, floor(target / size) of each document, and then documents in the order of the exponential key -ln(u) / w, w their
quality weight (below) and u a uniform number from a hash of doc_id, as long as the running sum of sizes, less half the
document's size, is within the rest: so the sum ends within half a document of its target.

No source is sorted as a whole.  The keys go through the monotone map 1 - exp(-key) into equal buckets; sums by (source,
bucket) find the one bucket in which the rest runs out; only that bucket's rows are sorted.  A hot source thus spreads
over all its buckets.

Quality weights are learned from labelled documents: documents fall into cells by the share of digits and of the signs
``%$&*#|`` among their characters and by the binary length of their size, and a cell's weight is its smoothed share of
good documents.  A cell without labels has the share of all; without labels every weight is 1.  There are at most
11 * 12 cells, whose counts come to the driver.

Edge cases: null labels and labels of unknown documents are passed over, several labels of a document count by their mean; null text has size 0; a null source is a source; rows equal in key go by doc_id, then size (equal rows may
stand for each other), null ids first; size-0 documents take nothing; an empty table gives no rows; a source of size 0 has target 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, written

MOST = 3.0
#: Rows that one bucket of a source should hold at most.
BUCKET_ROWS = 2_000


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def cell_of(text: Column, size: Column) -> Column:
    """Number of a text's cell."""
    t = F.coalesce(text, F.lit(""))
    share = F.regexp_count(t, F.lit("[%$&*#|0-9]")).cast("double") / F.greatest(F.length(t), F.lit(1))
    return (F.least(F.lit(10), F.floor(share * 50)) * 100 + F.least(F.lit(11), F.length(F.bin(size)))).cast("int")


def quality_weights(facts: DataFrame, labels: DataFrame | None, doc_id: str, label: str) -> Callable[[Column], Column]:
    """The weight of a cell, from facts(id, cell) and labels."""
    if labels is None:
        return lambda cell: F.lit(1.0)
    known = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("id")).agg(F.avg(F.col(f"`{label}`").cast("double")).alias("good"))
    rows = facts.join(known, "id").groupBy("cell").agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()
    all_ = (sum(r["good"] for r in rows) + 1.0) / (sum(r["n"] for r in rows) + 2.0) if rows else 1.0
    table = [F.lit(x) for r in rows for x in (r["cell"], (r["good"] + 1.0) / (r["n"] + 2.0))]
    return lambda cell: F.coalesce(F.try_element_at(F.create_map(*table), cell), F.lit(all_)) if table else F.lit(all_)


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1): 32 bits of a hash of the id's text."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / 4294967296.0


def targets(sizes: DataFrame, budget_share: float = 1.0, most: float = MOST) -> DataFrame:
    """Rows (source, source_size, ...) with target; one row per source, so the window over all of them is small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1)
    rows = rows.withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("level", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("budget", budget_share * F.sum("source_size").over(every))
        .withColumn("left_budget", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("share", F.col("left_budget") / F.col("left_weight"))
        .withColumn("capped", F.col("level") <= F.col("share"))
    )
    free = F.min(F.when(~F.col("capped"), F.struct("level", "share"))).over(every)  # the first that is not capped sets the share of all that follow
    return rows.select(*sizes.columns, F.when(F.col("capped"), F.col("cap")).otherwise(free["share"] * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", label: str = "quality", seed: int = 7, budget_share: float = 1.0, most: float = MOST
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words that the mix takes of the document, repeats counted).

    ``labels``: rows (doc_id, label 0 or 1) that quality weights are learned from.
    """
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    mine, aim = free_name(docs, "mix_"), free_name(docs, "aim_")
    m, p = (lambda c: F.col(f"{mine}.{c}")), (lambda c: F.col(f"{aim}.{c}"))
    t, d = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    with Scratch(docs.sparkSession) as scratch:
        # texts are read once: what the mix needs of them is written beside the columns
        size = size_of(t)
        measured = written(docs.select(*kept, F.struct(F.col(f"`{source}`").alias("source"), d.alias("id"), size.alias("size"), cell_of(t, size).alias("cell"), (-F.ln(uniform(d, seed))).alias("draw")).alias(mine)), "mix")
        weight = quality_weights(measured.select(f"{mine}.id", f"{mine}.cell"), labels, doc_id, label)
        key = (m("draw") / weight(m("cell"))).alias("key")
        plan = _plan(measured.select(m("source").alias("source"), key, m("id").alias("id"), m("size").alias("size")), budget_share, most, scratch).withColumnRenamed("p", aim)

    rows = measured.join(plan, m("source").eqNullSafe(p("source")), "left")
    # nulls come first in a struct's order, as in the window of _plan
    part = F.when(F.struct(key, m("id").alias("id"), m("size").alias("size")) <= p("last"), m("size")).otherwise(F.lit(0).cast("long"))
    return rows.select(*kept, m("size").alias("size"), p("source_size").alias("source_size"), p("target").alias("target"), (p("epochs") * m("size") + part).cast("long").alias("taken"))


def _plan(facts: DataFrame, budget_share: float, most: float, scratch: Scratch) -> DataFrame:
    """One struct ``p`` for each source: source, source_size, target, epochs and the last document of the fractional part.

    Written, so that its size is known to the join that uses it: Spark broadcasts it only below its own threshold.
    """
    sizes = facts.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims = targets(sizes, budget_share, most)
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    aims = aims.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS))
    aims = scratch.written(aims, "mix-targets").alias("a")

    same = F.col("f.source").eqNullSafe(F.col("a.source"))
    rows = facts.alias("f").join(aims, same).select("f.*", "a.rest", F.floor((1 - F.exp(-F.col("key"))) * F.col("a.buckets")).alias("bucket"))
    sums = rows.groupBy("source", "rest", "bucket").agg(F.sum("size").alias("part"))
    sums = sums.withColumn("until", F.sum("part").over(Window.partitionBy("source").orderBy("bucket")))
    edge = sums.where(F.col("until") >= F.col("rest")).groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("until") - F.col("part")).alias("before")), "bucket").alias("edge"))
    edge = scratch.written(edge, "mix-edges").alias("e")

    open_ = rows.alias("r").join(edge, F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bucket") == F.col("e.edge.bucket"))).select("r.*", "e.edge.before")
    order = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    open_ = open_.withColumn("upto", F.col("before") + F.sum("size").over(order)).where(F.col("upto") - F.col("size") / 2.0 <= F.col("rest"))
    # no row of the edge bucket fits: what lies before the bucket is taken, that is keys below its lower end
    last = open_.groupBy("source").agg(F.max(F.struct("key", "id", "size")).alias("last"))
    ends = rows.alias("r").join(edge, F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bucket") < F.col("e.edge.bucket"))).select("r.*")
    ends = ends.groupBy("source").agg(F.max(F.struct("key", "id", "size")).alias("last"))
    both = last.unionByName(ends).groupBy("source").agg(F.max("last").alias("last")).alias("l")
    plan = aims.join(both, F.col("a.source").eqNullSafe(F.col("l.source")), "left")
    return written(plan.select(F.struct("a.source", "a.source_size", "a.target", "a.epochs", "l.last").alias("p")), "mix-plan")


def digest(mixed: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size,
    least(10, floor(CAST(length(regexp_replace(t, '[^%$&*#|0-9]', '', 'g')) AS DOUBLE) / greatest(length(t), 1) * 50)) * 100 + least(11, length(bin(size))) AS cell,
    (CAST(CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0 AS u
  FROM d),
g AS (SELECT doc_id, avg(CAST(quality AS DOUBLE)) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
b AS (SELECT cell, sum(good) AS good, count(*) AS n FROM k JOIN g USING (doc_id) GROUP BY cell),
r AS (
  SELECT doc_id, source, size,
    -ln(u) / coalesce((b.good + 1.0) / (b.n + 2.0), (SELECT (sum(good) + 1.0) / (sum(n) + 2.0) FROM b), 1.0) AS key
  FROM k LEFT JOIN b ON k.cell = b.cell),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM r GROUP BY source),
c AS (
  SELECT *, 3.0 * source_size AS cap, 3.0 * source_size / weight AS level, CAST(sum(source_size) OVER () AS DOUBLE) AS budget,
    sum(weight) OVER () AS weights FROM s),
w AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY level, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (weights - coalesce(sum(weight) OVER (ORDER BY level, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share
  FROM c),
a AS (
  SELECT source, source_size, CASE WHEN level <= share THEN CAST(cap AS DOUBLE)
    ELSE (SELECT min_by(x.share, x.level) FROM w x WHERE x.level > x.share) * weight END AS target FROM w),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM a),
q AS (
  SELECT r.doc_id, r.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id NULLS FIRST, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + CASE WHEN upto - size / 2.0 <= rest THEN size ELSE 0 END AS BIGINT) AS taken
FROM q
"""
