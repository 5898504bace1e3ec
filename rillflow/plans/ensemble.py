"""The same points delineated on grids of several spacings, all in one pass.

What tells one grid from another are columns: ``grid_id``, ``resolution_m``, ``n_rows``,
``n_cols`` and the origin ``x0``, ``y0``. A ``Grid`` whose numbers are those columns gives
the same expressions for all of them, so sampling, filling, routing, snapping and measuring
run once over the cells of all grids, keyed by ``grid_id``, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions.projection import Grid
from ..operators import focal, graph, rasters, siting
from ..session import settled, shuffled

KEY = ["grid_id", "cell"]
GEOMETRY = ["grid_id", "resolution_m", "n_rows", "n_cols", "x0", "y0"]


@dataclass(frozen=True)
class Spacing:
    """One grid of an ensemble; the one with the smallest id is the one whose catchments are reported."""

    grid_id: int
    resolution_m: float
    n_rows: int
    n_cols: int
    x0: float
    y0: float

    def literal(self) -> Column:
        kinds = ("int", "double", "int", "int", "double", "double")
        return F.struct(*(F.lit(getattr(self, c)).cast(t).alias(c) for c, t in zip(GEOMETRY, kinds, strict=True)))


def spacings(base: Grid, n_rows: int, resolutions_m: Sequence[float]) -> list[Spacing]:
    """Grids of those spacings that begin at the south-west cell of ``base`` and end within it."""
    if not resolutions_m or min(resolutions_m) <= 0:
        raise AnalysisError("invalid_resolution", "An ensemble needs spacings above 0.")
    size = lambda n, r: math.floor((n - 1) * base.resolution_m / r + 1e-9) + 1
    return [Spacing(i, float(r), size(n_rows, r), size(base.n_cols, r), base.x0, base.y0) for i, r in enumerate(resolutions_m)]


def of_columns(base: Grid) -> Grid:
    """The grid whose numbers are the columns of ``GEOMETRY``."""
    return Grid(base.frame, F.col("resolution_m"), F.col("n_cols"), F.col("x0"), F.col("y0"), base.spacing_m, base.interval_m)


def on_each(df: DataFrame, grids: Sequence[Spacing]) -> DataFrame:
    """Each row once for each grid, with the grid's numbers; an array of a few structs, no join."""
    wide = df.withColumn("_g", F.explode(F.array(*(g.literal() for g in grids))))
    return wide.select(*(c for c in df.columns if c not in GEOMETRY), *(F.col("_g")[c].alias(c) for c in GEOMETRY))


def with_geometry(df: DataFrame, grids: Sequence[Spacing]) -> DataFrame:
    """Adds the numbers of each row's grid, from a map of as many entries as there are grids."""
    found = F.create_map(*(x for g in grids for x in (F.lit(g.grid_id), g.literal())))[F.col("grid_id")]
    return df.withColumn("_g", found).select(*df.columns, *(F.col("_g")[c].alias(c) for c in GEOMETRY if c not in df.columns))


def sample(surface: DataFrame, base: Grid, grids: Sequence[Spacing], decimals: int | None = None) -> DataFrame:
    """(grid_id, row, col, z): the surface (row, col, z) of one grid, read at the cells of each of ``grids``.

    Cells beside a hole of the surface are null, as are those of a hole.
    """
    g = of_columns(base)
    rows = on_each(surface.sparkSession.range(1), grids).withColumn("row", F.explode(F.expr("sequence(0, n_rows - 1)"))).repartition("grid_id", "row")
    cells = rows.withColumn("col", F.explode(F.expr("sequence(0, n_cols - 1)")))
    place = F.struct("grid_id", "row", "col").alias("place")
    prow, pcol = (g.y(F.col("row")) - F.lit(base.y0)) / F.lit(base.resolution_m), (g.x(F.col("col")) - F.lit(base.x0)) / F.lit(base.resolution_m)
    met = rasters.bilinear(cells.select(place, prow.alias("prow"), pcol.alias("pcol")), surface.select(F.col("row").alias("prow"), F.col("col").alias("pcol"), "z"), "place")
    height = F.col("height") if decimals is None else F.round("height", decimals)
    return met.select("place.grid_id", "place.row", "place.col", height.alias("z"))


@dataclass
class Routed:
    """All grids of an ensemble, routed: ``cells`` has a row for each cell with data."""

    base: Grid
    grids: list[Spacing]
    cells: DataFrame
    tour: DataFrame


def route(surface: DataFrame, base: Grid, grids: Sequence[Spacing], fill: bool = True, decimals: int | None = None) -> Routed:
    """Samples the surface on each grid, fills pits, finds receivers, and measures what drains through each cell.

    ``accumulation`` counts cells, ``area_m2`` is their ground area.
    """
    lattice = settled(sample(surface, base, grids, decimals))
    if fill:
        raised = graph.fill_depressions(lattice).select("grid_id", "row", "col", "filled")
        lattice = lattice.select("grid_id", "row", "col").join(shuffled(raised), ["grid_id", "row", "col"], "left").withColumnRenamed("filled", "z")
    wide = with_geometry(lattice, grids)
    flow = focal.steepest_descent(wide, F.col("n_cols"), F.col("resolution_m")).select("grid_id", "row", "col", "cell", "z", "receiver")
    flow = settled(with_geometry(flow, grids).withColumn("own_m2", of_columns(base).cell_area(F.col("row"))))
    toured = graph.tour(flow, F.col("n_cols"))
    areas = graph.accumulate(flow, "own_m2").select(*KEY, F.col("accumulation").alias("area_m2"))
    counts = toured.select(*KEY, F.col("size").cast("double").alias("accumulation"))
    return Routed(base, list(grids), settled(flow.drop("own_m2").join(shuffled(counts), KEY).join(shuffled(areas), KEY)), toured)


def delineate(routed: Routed, points: DataFrame, radius_m: float | None = None) -> DataFrame:
    """(point_id, grid_id, outlet, accumulation, area_m2, moved_m): each point (point_id, lon, lat) snapped and measured on each grid.

    Each grid snaps for itself. Points with no cell in reach are left out of that grid.
    """
    g = of_columns(routed.base)
    at = on_each(points.select("point_id", "lon", "lat"), routed.grids)
    at = at.withColumn("row", g.row(g.frame.y(F.col("lat")))).withColumn("col", g.col(g.frame.x(F.col("lon"))))
    snapped = siting.snap(routed.cells, at, g, radius_m)
    own = routed.cells.select("grid_id", "row", "col", F.col("cell").alias("outlet"), "area_m2")
    return snapped.join(shuffled(own), ["grid_id", "row", "col"]).select("point_id", "grid_id", "outlet", "accumulation", "area_m2", "moved_m")


def members(routed: Routed, delineated: DataFrame) -> DataFrame:
    """(grid_id, cell, outlet, straight, diagonal): the cells of each catchment on each grid."""
    return graph.members_of(routed.tour, delineated.select("grid_id", F.col("outlet").alias("cell")))


def summarise(delineated: DataFrame) -> DataFrame:
    """(point_id, n_grids, area_m2, mean_m2, std_m2, cv, confidence): the first grid's area, and how far the grids agree."""
    spread = siting.ensemble(delineated)
    first = delineated.groupBy("point_id").agg(F.count("*").alias("n_grids"), F.min(F.struct("grid_id", "area_m2")).alias("first"))
    return spread.join(shuffled(first.select("point_id", "n_grids", F.col("first.area_m2").alias("area_m2"))), "point_id")
