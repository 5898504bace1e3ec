"""Masks, candidates and the choice of storage sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import settings
from ..functions.projection import Grid
from ..session import shuffled
from . import graph

KEY = ["grid_id", "cell"]


def mapped_area(lattice: DataFrame, grid: Grid, value: str = "z") -> DataFrame:
    """(grid_id, mapped_m2): ground area of the cells with data, summed by row and then over rows."""
    rows = lattice.where(F.col(value).isNotNull()).groupBy("grid_id", "row").agg(F.count("*").alias("n"))
    return rows.groupBy("grid_id").agg(F.sum(F.col("n") * grid.cell_area(F.col("row"))).alias("mapped_m2"))


def upstream_area(grid: Grid) -> Column:
    """Area that drains through a cell, from its accumulation and its own row's cell area."""
    return F.col("accumulation") * grid.cell_area(F.col("row"))


def stream_cells(cells: DataFrame, areas: DataFrame, grid: Grid) -> DataFrame:
    """Cells that carry at least the stream's share of the mapped area; ``areas`` has one row for each grid."""
    joined = cells.join(areas, "grid_id")
    return joined.where(upstream_area(grid) >= F.col("mapped_m2") * settings.sites.stream_share).drop("mapped_m2")


def buildable_cells(cells: DataFrame) -> DataFrame:
    """Cells with a gentle slope, far enough from the edge of the data."""
    s = settings.sites
    return cells.where((F.nanvl("slope", F.lit(float("inf"))) < s.steepest) & (F.col("edge_m") >= s.from_edge_m))


def trunk_cells(cells: DataFrame, grid: Grid) -> DataFrame:
    """Cells of watercourses, by absolute area."""
    return cells.where(upstream_area(grid) >= settings.sites.trunk_ha * 1e4)


def clear_cells(cells: DataFrame) -> DataFrame:
    """Cells high enough above the watercourse that they drain to."""
    return cells.where(F.col("above") >= settings.sites.above_trunk_m)


def available_cells(cells: DataFrame, excluded: DataFrame) -> DataFrame:
    """Cells that nobody has ruled out."""
    return cells.join(shuffled(excluded.select(*KEY).distinct()), KEY, "left_anti")


def top_n(n: int | None) -> int:
    s = settings.sites
    return max(1, min(s.most_sites, s.n_sites if n is None else n))


def choose_sites(flow: DataFrame, candidates: DataFrame, n: int | None = None) -> DataFrame:
    """(grid_id, cell, accumulation, rank): the candidates with most water, none upstream of another.

    Taking candidates by falling accumulation and striking out each pick's catchment leaves
    just those with no candidate downstream, as accumulation always grows downstream; so no
    loop over picks is needed.
    """
    first = graph.drain(flow, candidates).select("grid_id", F.col("cell").alias("receiver"), F.col("root").alias("below"))
    marks = candidates.select("grid_id", F.col("cell").alias("below"), F.lit(True).alias("taken")).distinct()
    own = candidates.select(*KEY, "accumulation").join(shuffled(flow.select(*KEY, "receiver")), KEY)
    free = own.join(shuffled(first), ["grid_id", "receiver"], "left").join(shuffled(marks), ["grid_id", "below"], "left").where("taken is null")
    # the bound on the rank lets Spark drop all but a few rows of a grid before the shuffle
    rank = F.row_number().over(W.partitionBy("grid_id").orderBy(F.desc("accumulation"), "cell"))
    return free.select("grid_id", "cell", "accumulation", rank.alias("rank")).where(F.col("rank") <= top_n(n))


def recommended(sites: DataFrame) -> DataFrame:
    """Sites (grid_id, rank, confidence) that their grids don't contradict; ``best`` marks the first of each grid.

    A site without a confidence was not held against other grids and stays.
    """
    kept = sites.where(F.coalesce("confidence", F.lit("")) != "low")
    return kept.withColumn("best", F.col("rank") == F.min("rank").over(W.partitionBy("grid_id")))


def placed_points(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points (grid_id, lon, lat) with ``code``: null inside their grid's box (west, south, east, north), else why they can't be used."""
    within = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    code = F.when(F.coalesce(within, F.lit(False)), F.lit(None).cast("string")).otherwise("pour_point_outside_map")
    own = boxes.select("grid_id", "west", "south", "east", "north")
    return points.join(own, "grid_id", "left").withColumn("code", code).drop("west", "south", "east", "north")


def why_none(cells: DataFrame) -> DataFrame:
    """(grid_id, code): which rule emptied the candidates, from boolean columns stream, buildable, clear and available."""
    n = lambda c: F.count_if(c)
    on = F.col("stream")
    code = (
        F.when(n(F.col("available")) == 0, "no_available_ground")
        .when(n(on) == 0, "no_stream_network")
        .when(n(on & F.col("buildable")) == 0, "no_buildable_ground")
        .when(n(on & F.col("buildable") & F.col("clear")) == 0, "no_ground_clear_of_watercourse")
        .when(n(on & F.col("buildable") & F.col("clear") & F.col("available")) == 0, "no_site_found")
    )
    return cells.groupBy("grid_id").agg(code.alias("code"))


def snap(cells: DataFrame, points: DataFrame, grid: Grid, radius_m: float | None = None) -> DataFrame:
    """Each point (point_id, row, col) moved to the cell with most accumulation in a square around it.

    The best cell of a square is the best of its rows' bests: one window along rows and one
    along columns, each row of a table once however wide the square; of equals the first in
    row-major order wins. Where the grid's numbers are columns, cells and points have them,
    and each grid has a square of its own.
    """
    reach = F.lit(grid.spacing_m * settings.flow.snap_spacings if radius_m is None else radius_m)
    k = F.greatest(F.lit(1), F.rint(reach / F.lit(grid.resolution_m)).cast("int"))
    # bounds of a frame are the same for all rows: places are measured in squares, half a cell more than k to one
    near = lambda c, *by: W.partitionBy("grid_id", *by).orderBy(F.col(c) / (F.col("_k") + 0.5)).rangeBetween(-1, 1)
    # what isn't a cell has no best, and counts for nothing in a maximum
    value = F.struct("accumulation", (-F.col("row")).alias("minus_row"), (-F.col("col")).alias("minus_col"))
    known = cells.where("row IS NOT NULL AND col IS NOT NULL").select("grid_id", "row", "col", k.alias("_k"), value.alias("best"))
    order = W.partitionBy("grid_id", "row").orderBy("col")
    after, before = F.lead("col").over(order), F.lag("col").over(order)
    # places without a cell but with one in reach in their row: after a cell, and before one that the last cell's reach does not meet
    sided = known.withColumn("_after", after).withColumn("_before", before)
    right = F.least(F.col("col") + F.col("_k"), F.coalesce(F.col("_after") - 1, F.col("col") + F.col("_k")))
    left = F.greatest(F.col("col") - F.col("_k"), F.coalesce(F.col("_before") + F.col("_k") + 1, F.col("col") - F.col("_k")))
    places = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    beside = F.concat(places(left, F.col("col") - 1), places(F.col("col") + 1, right))
    bare = sided.select("grid_id", "row", F.explode(beside).alias("col"), "_k", F.lit(None).cast(known.schema["best"].dataType).alias("best"))
    rows = known.unionByName(bare).select("grid_id", "row", "col", "_k", F.max("best").over(near("col", "row")).alias("best"))
    wanted = points.select("grid_id", "point_id", F.col("row").alias("p_row"), F.col("col").alias("p_col"), k.alias("_k"), F.lit(grid.resolution_m).alias("p_resolution")).distinct()
    squares = wanted.select("grid_id", F.col("p_row").alias("row"), F.col("p_col").alias("col"), "_k").distinct()
    asked = rows.select("*", F.lit(False).alias("_asked")).unionByName(squares.select("*", F.lit(None).cast(known.schema["best"].dataType).alias("best"), F.lit(True).alias("_asked")))
    best = asked.withColumn("best", F.max("best").over(near("row", "col"))).where("_asked AND best IS NOT NULL").select("grid_id", F.col("row").alias("p_row"), F.col("col").alias("p_col"), "best")
    snapped = wanted.join(shuffled(best), ["grid_id", "p_row", "p_col"])
    row, col = -F.col("best.minus_row"), -F.col("best.minus_col")
    moved = F.hypot((row - F.col("p_row")).cast("double"), (col - F.col("p_col")).cast("double")) * F.col("p_resolution")
    return snapped.select("grid_id", "point_id", row.alias("row"), col.alias("col"), F.col("best.accumulation").alias("accumulation"), moved.alias("moved_m"))


def edge_contact(members: DataFrame, lattice: DataFrame, value: str = "z") -> DataFrame:
    """(grid_id, site, edge_contact): share of a mask's outward sides that face a gap or the border.

    ``members`` is (grid_id, site, row, col).
    """
    sides = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    facing = members.withColumn("o", F.explode(sides)).select("grid_id", "site", (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"))
    outward = facing.join(shuffled(members), ["grid_id", "site", "row", "col"], "left_anti")
    ground = lattice.where(F.col(value).isNotNull()).select("grid_id", "row", "col", F.lit(True).alias("mapped"))
    return outward.join(shuffled(ground), ["grid_id", "row", "col"], "left").groupBy("grid_id", "site").agg((F.count_if(F.col("mapped").isNull()) / F.count("*")).alias("edge_contact"))


def catchment_summary(members: DataFrame, lattice: DataFrame, grid: Grid, value: str = "z") -> DataFrame:
    """One row for each outlet: cells, area, relief, longest path and its relief, edge contact, and whether the area is a lower bound.

    ``members`` is what graph.upstream returns with steps counted.
    """
    z = lattice.where(F.col(value).isNotNull()).select("grid_id", "row", "col", grid.cell(F.col("row"), F.col("col")).alias("cell"), F.col(value).alias("z"))
    own = members.join(shuffled(z), KEY)
    sums = own.groupBy("grid_id", "outlet").agg(F.count("*").alias("cells"), F.sum(grid.cell_area(F.col("row"))).alias("area_m2"), F.max("z").alias("top"))
    paths = graph.longest_path(members, grid.resolution_m)
    at = lambda name, key: z.select("grid_id", F.col("cell").alias(key), F.col("z").alias(name))
    contact = edge_contact(own.select("grid_id", F.col("outlet").alias("site"), "row", "col"), lattice, value).withColumnRenamed("site", "outlet")
    joined = sums.join(shuffled(paths), ["grid_id", "outlet"]).join(shuffled(at("outlet_z", "outlet")), ["grid_id", "outlet"]).join(shuffled(at("remote_z", "remote_cell")), ["grid_id", "remote_cell"]).join(shuffled(contact), ["grid_id", "outlet"])
    return joined.select(
        "grid_id", "outlet", "cells", "area_m2", (F.col("top") - F.col("outlet_z")).alias("relief_m"), "length_m", "remote_cell",
        (F.col("remote_z") - F.col("outlet_z")).alias("path_relief_m"), "edge_contact", (F.col("edge_contact") > settings.flow.open_edge_share).alias("lower_bound"),
    )


def ensemble(areas: DataFrame) -> DataFrame:
    """(point_id, mean_m2, std_m2, cv, confidence) of the areas (point_id, area_m2) that several grids give."""
    from ..functions.scalars import confidence

    made = areas.groupBy("point_id").agg(F.avg("area_m2").alias("mean_m2"), F.stddev_pop("area_m2").alias("std_m2"))
    return made.withColumn("cv", F.when(F.col("mean_m2") > 0, F.col("std_m2") / F.col("mean_m2"))).withColumn("confidence", confidence(F.col("mean_m2"), F.col("std_m2")))
