import os

import pytest
from pyspark.sql import functions as F

from rillflow.session import discard, settled, shared_folder


def test_size_estimates_end_with_each_round(spark):
    state = settled(spark.range(50).select(F.col("id").alias("a"), (F.col("id") / 2).cast("long").alias("b")))
    for _ in range(40):
        last, state = state, settled(state.alias("x").join(state.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")))
        discard(last)
    assert state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 32
    assert state.where("b = 0").count() == 50


def test_discarded_tables_are_gone(spark):
    made = settled(spark.range(3))
    folder = made._settled_in.removeprefix("file:")
    assert made.count() == 3 and os.path.isdir(folder)
    discard(made)
    discard(made.where("id > 0"))
    assert not os.path.exists(folder)


def test_rows_are_written_once(spark):
    made = settled(spark.range(1000).select(F.rand().alias("x")).repartition(3))
    assert made.collect() == made.collect() and shared_folder(spark) in made._settled_in


def test_a_cluster_must_name_its_folder():
    class Cluster:
        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getCheckpointDir = staticmethod(lambda: None)
            getConf = staticmethod(dict)

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        shared_folder(Cluster)
