"""Tables of cells meet by shuffles, never as a whole through the driver."""

from pyspark.sql import functions as F

from rillflow.operators import graph, siting


def chain(spark, n=40):
    """A way of n cells in one column, from the north down to cell 0."""
    below = F.when(F.col("id") > 0, F.col("id") - 1)
    return spark.range(n).select(F.lit(0).alias("grid_id"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.col("id").alias("cell"), F.col("id").cast("double").alias("z"), below.alias("receiver"))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_graphs_send_no_tables_through_the_driver(spark, monkeypatch):
    plans = []
    for module in (graph,):
        kept = module.settled
        monkeypatch.setattr(module, "settled", lambda df, kept=kept: (plans.append(planned(df)), kept(df))[1])
    flow = chain(spark)
    toured = graph.tour(flow, 1)
    found = graph.members_of(toured, flow.where("cell IN (0, 30)"))
    paths = graph.flow_paths(toured, graph.longest_path(found, 10.0).select("grid_id", "outlet", F.col("remote_cell").alias("cell")))
    linked = graph.connected(flow.where("receiver IS NOT NULL").select("grid_id", F.col("cell").alias("a"), F.col("receiver").alias("b")))
    ordered = graph.chains(flow.select("grid_id", "cell", "receiver"))
    plans += [planned(df) for df in (found, paths, linked, ordered)]
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]
    assert found.count() == 40 + 10 and paths.count() == 40 + 10
    assert linked.select("root").distinct().count() == 1 and ordered.agg(F.max("step")).first()[0] == 39


def test_points_meet_no_list_of_cells_around_them(spark):
    import random

    from rillflow.functions.projection import Grid, LocalFrame

    rng = random.Random(5)
    made = {(g, r, c): float(rng.randint(1, 9)) for g in (0, 1) for r in range(17) for c in range(14) if rng.random() < (0.8 if r < 9 else 0.04)}
    cells = spark.createDataFrame([(g, r, c, a) for (g, r, c), a in made.items()], "grid_id int, row int, col int, accumulation double")
    asked = [(g, 100 * g + i, rng.randint(-9, 26), rng.randint(-9, 23)) for g in (0, 1) for i in range(60)]
    points = spark.createDataFrame([*asked, asked[0]], "grid_id int, point_id int, row int, col int")
    # grids of two resolutions: squares of 6 and 3 cells to a side of the point
    each = lambda df: df.withColumn("resolution_m", F.when(F.col("grid_id") == 0, 10.0).otherwise(20.0))
    found = siting.snap(each(cells), each(points), Grid(LocalFrame(8.3, 46.25), F.col("resolution_m"), 14), 60.0)
    assert "b_row" not in planned(found)
    want = {}
    for g, i, r, c in asked:
        k = 3 if g else 6
        near = [(-a, y, x) for (h, y, x), a in made.items() if h == g and abs(y - r) <= k and abs(x - c) <= k]
        if near:
            a, y, x = min(near)
            want[g, i] = (y, x, -a, round(((y - r) ** 2 + (x - c) ** 2) ** 0.5 * (20.0 if g else 10.0), 6))
    got = [((r.grid_id, r.point_id), (r.row, r.col, r.accumulation, round(r.moved_m, 6))) for r in found.collect()]
    assert dict(got) == want and len(got) == len(want) > 40


def test_an_ensemble_sends_no_cells_through_the_driver(spark, monkeypatch):
    from rillflow.functions.projection import Grid, LocalFrame
    from rillflow.plans import ensemble

    plans, kept = [], ensemble.settled
    monkeypatch.setattr(ensemble, "settled", lambda df: (plans.append(planned(df)), kept(df))[1])
    base = Grid(LocalFrame(8.3, 46.25), 10.0, 6)
    surface = spark.range(60).select(F.expr("cast(id div 6 as int)").alias("row"), F.expr("cast(id % 6 as int)").alias("col"), (F.col("id") * 7 % 60).cast("double").alias("z"))
    routed = ensemble.route(surface, base, ensemble.spacings(base, 10, (10.0, 15.0)), fill=False)
    points = spark.range(3).select(F.col("id").alias("point_id"), base.lon(F.col("id")).alias("lon"), base.lat(F.col("id") * 2).alias("lat"))
    found = ensemble.delineate(routed, points, 20.0)
    plans += [planned(found), planned(ensemble.summarise(found))]
    # the only thing broadcast is one row: the extent of the surface
    assert len(plans) == 5 and not [p for p in plans if "BroadcastHashJoin" in p]
    assert found.count() == 6
