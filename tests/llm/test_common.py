import os

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import common


def test_running_totals_in_blocks(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        values = [(i * 37) % 11 - 5 for i in range(n)]
        row = spark.createDataFrame([(values,)], "v array<int>").select(common.running(F.col("v"), lambda a, b: a + b).alias("s"), common.running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).first()
        assert row.s == [sum(values[: i + 1]) for i in range(n)] and row.m == [max(values[: i + 1]) for i in range(n)]


def test_scratch_tables_go_when_their_step_ends(spark):
    with common.Scratch(spark) as scratch:
        rows = scratch.written(spark.range(10), "here")
        path = scratch.paths[0].removeprefix("file:")
        assert rows.count() == 10 and os.path.isdir(path)
    assert not os.path.exists(path) and not scratch.paths


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
    Context.master = "local-cluster[3,2,3000]"
    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
