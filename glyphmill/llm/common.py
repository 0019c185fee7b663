"""Shared helpers: table access, scratch tables in the shared folder, result columns."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a session in one process (tests) gets a temporary folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='glyphmill-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of an Arrow batch while a table is written: texts may be long, and a batch is held by Spark and by Python.
BATCH = 2000


def _write(df: DataFrame, tag: str) -> str:
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = f"{shared_dir(spark)}/glyphmill/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(min(BATCH, int(before or BATCH))))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, prunes columns on reread."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, tag))


class Scratch:
    """Tables that only the steps inside a ``with`` block read; they are deleted at its end, when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        self.paths.append(_write(df, tag))
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def __exit__(self, *_) -> None:
        self.drop()

    def drop(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


def with_results(df: DataFrame, results: dict[str, Column]) -> DataFrame:
    """Adds result columns; an input column of the same name (in any case) is replaced by the result."""
    taken = {k.lower() for k in results}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in results.items()])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Elements that one step of ``running`` copies at most.
STEP = 64


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an int array under an associative ``op``; in blocks, so that no long array is copied for each element."""

    def plain(v: Column) -> Column:
        return F.aggregate(v, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x).otherwise(op(F.element_at(a, -1), x)))))

    def joined(blocks: Column, tops: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: op(F.get(tops, i - 1), x)))))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda i: plain(F.slice(v, i * STEP + 1, F.lit(STEP))))
        return bound(blocks, lambda b: bound(plain(F.transform(b, lambda x: F.element_at(x, -1))), lambda tops: joined(b, tops)))

    return bound(values, lambda v: F.when(F.size(v) == 0, v).otherwise(whole(v)))


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, and what they hold counts against their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a partition that trims when it is done."""

    @functools.wraps(each)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from each(batches)
        finally:
            trim()

    return run
