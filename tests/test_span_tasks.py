"""Set operations of masks share their rows out and sort them once."""

from pyspark.sql import functions as F

from rillflow.operators import spans


def test_set_operations_keep_their_tasks_and_sort_once(spark):
    cells = lambda share: spark.range(4000).where(f"id % 7 < {share}").select((F.col("id") % 2).cast("int").alias("grid_id"), F.lit(1).alias("site"), (F.col("id") % 40).cast("int").alias("row"), F.expr("cast(id div 40 as int)").alias("col"))
    a, b = ({(r.grid_id, r.row, r.col) for r in cells(n).collect()} for n in (3, 5))
    left, right = spans.from_cells(cells(3)).localCheckpoint(), spans.from_cells(cells(5).unionByName(cells(5))).localCheckpoint()
    for made, want in ((spans.union(left, right), a | b), (spans.intersection(left, right), a & b), (spans.difference(right, left), b - a)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
        rows = [(r.grid_id, r.row, c) for r in made.collect() for c in range(r.first, r.last + 1)]
        assert set(rows) == want and len(rows) == len(want)
        assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = {(r.grid_id, r.row, r.last + 1) for r in left.collect()}
    assert not ends & {(r.grid_id, r.row, r.first) for r in left.collect()}
