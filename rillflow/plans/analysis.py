"""Analyses from end to end: a contour sheet, or an area over elevation pixels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import settings
from ..errors import AnalysisError
from ..functions import resolution
from ..functions.projection import TILE_PX, Grid, LocalFrame, fit_frame
from ..operators import focal, graph, hull, rasters, siting
from ..operators.triangulate import triangulated
from ..session import settled
from ..sources import kml, selection
from ..sources import rasters as raster_files
from . import terrain


def empty_lattice(spark: SparkSession, n_rows: int, n_cols: int, grid_id: int = 0) -> DataFrame:
    """One row for each cell of a rectangle."""
    return spark.range(n_rows * n_cols).select(F.lit(grid_id).alias("grid_id"), F.expr(f"cast(id div {n_cols} as int)").alias("row"), F.expr(f"cast(id % {n_cols} as int)").alias("col"), F.col("id").alias("cell"))


def sheet_surface(vertices: DataFrame, resolution_m: float | None = None) -> tuple[Grid, DataFrame, list[str]]:
    """(grid, lattice, warnings) of the vertices of one sheet: triangulated at cell centres and smoothed."""
    spark = vertices.sparkSession
    frame = fit_frame(vertices)
    placed = settled(vertices.withColumn("x", frame.x(F.col("lon"))).withColumn("y", frame.y(F.col("lat"))))
    length = kml.contour_lengths(placed).agg(F.sum("length_m")).first()[0]
    around = hull.convex_hulls(placed).agg(F.max("hull_m2").alias("m2"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    if not length or not around.m2:
        raise AnalysisError("degenerate_geometry", "The contours have no length or no extent.", status=400)
    spacing = around.m2 / length
    box = (around.x1 - around.x0) * (around.y1 - around.y0)
    res, _, warnings = resolution.sheet_resolution(spacing, box, resolution_m)
    levels = placed.select(F.round("z", 6).alias("level")).distinct().orderBy("level")
    steps = levels.agg(F.sort_array(F.collect_list("level")).alias("l")).select(F.explode(F.expr("zip_with(slice(l, 2, size(l)), l, (b, a) -> b - a)")).alias("step")).agg(F.median("step")).first()[0]
    n_cols, n_rows = int((around.x1 - around.x0) // res) + 1, int((around.y1 - around.y0) // res) + 1
    grid = Grid(frame, res, n_cols, around.x0, around.y0, spacing, steps or 1.0)
    cells = empty_lattice(spark, n_rows, n_cols)
    spots = cells.select("cell", grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y"))
    heights = triangulated(spots, placed.select("x", "y", "z"), max(50 * res, 4 * spacing))
    raw = settled(cells.join(heights, "cell"))
    smooth = focal.smooth(raw, spacing / settings.sheet.smoothing_divisor / res)
    return grid, settled(smooth.select("grid_id", "row", "col", "cell", F.col("z").alias("raw"), F.col("smoothed").alias("z"))), warnings


def pixel_surface(pixels: DataFrame, zoom: int, ring: selection.Ring, native_m: float, resolution_m: float | None = None) -> tuple[Grid, DataFrame, DataFrame, list[str]]:
    """(grid, lattice, excluded, warnings) of an area over pixels (prow, pcol, z) of a web-map zoom.

    The lattice reaches beyond the area, as water comes from outside it; cells outside are
    excluded as sites only.
    """
    spark, e = pixels.sparkSession, settings.area
    west, south, east, north = buffered_box(ring)
    frame = LocalFrame((west + east) / 2, (south + north) / 2)
    width, height = (east - west) * frame.metres_per_lon, (north - south) * frame.metres_per_lat
    res, _, warnings = resolution.area_resolution(native_m, width * height, resolution_m)
    n_cols, n_rows = int(width // res) + 1, int(height // res) + 1
    grid = Grid(frame, res, n_cols, -width / 2, -height / 2, max(30.0, res), 0.0)
    cells = empty_lattice(spark, n_rows, n_cols)
    heights = rasters.bilinear(raster_files.lattice_places(cells, grid, zoom), pixels)
    raw = settled(cells.join(heights.select(F.col("point_id").alias("cell"), F.col("height").cast("double").alias("z")), "cell"))
    gaps = raw.agg(F.avg(F.col("z").isNull().cast("double"))).first()[0]
    if gaps > e.most_gaps:
        raise AnalysisError("elevation_unavailable", f"{gaps:.0%} of the area has no heights.", status=503)
    smooth = focal.smooth(raw, e.sigma_m / res)
    lattice = settled(smooth.select("grid_id", "row", "col", "cell", F.col("z").alias("raw"), F.col("smoothed").alias("z")))
    corners = [((lon_ - frame.lon0) * frame.metres_per_lon, (lat_ - frame.lat0) * frame.metres_per_lat) for lon_, lat_ in ring]
    inside = rasters.polygon_mask(lattice.select("grid_id", "row", "col", "cell"), [((x - grid.x0) / res, (y - grid.y0) / res) for x, y in corners])
    return grid, lattice, lattice.select("grid_id", "cell").join(inside.select("grid_id", "cell"), ["grid_id", "cell"], "left_anti"), warnings


def buffered_box(ring: selection.Ring) -> tuple[float, float, float, float]:
    from ..functions.projection import buffered

    return buffered(selection.bbox_of(selection.check_size(ring)))


def analyse(grid: Grid, lattice: DataFrame, rain: DataFrame, top_n: int | None = None, excluded: DataFrame | None = None, curve_number: float | None = None) -> dict[str, DataFrame]:
    """Sites of a surface with their water balance; the parts of terrain.sites, and ``balances``."""
    drained = terrain.route(lattice, grid)
    found = terrain.sites(drained, top_n, excluded)
    if not found["sites"].limit(1).count():
        raise AnalysisError(terrain.why_no_site(drained, excluded), "No cell passes every rule.")
    ranks = found["sites"].select("grid_id", F.col("cell").alias("outlet"), "rank")
    found["balances"] = terrain.balances(found, rain, curve_number).join(ranks, ["grid_id", "outlet"])
    found["geojson"] = terrain.feature_collection(found, drained)
    return found


def analyse_area(spark: SparkSession, roots: Sequence[str], ring: selection.Ring, rain: DataFrame, resolution_m: float | None = None, land: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Sites within an area, over elevation tiles in folders; of equal tiles that of the first folder counts.

    The zoom is the finest at which the buffered area keeps within the tiles allowed. A
    missing tile is answered by a coarser one. ``land`` (lon, lat, class), if given, rules out what is not
    available. Beside the parts of ``analyse``, ``origins`` counts the wanted tiles by folder and by zooms between, null for those that none answers.
    """
    box = buffered_box(ring)
    zoom = raster_files.budget_zoom(box, settings.area.most_tiles)
    wanted = settled(raster_files.wanted_tiles(spark, box, zoom))
    tiles = settled(raster_files.answered(wanted, raster_files.read_tiles(spark, *roots)))
    if not tiles.limit(1).count():
        raise AnalysisError("elevation_unavailable", "No folder has a tile of the area.", status=503)
    pixels = settled(raster_files.tile_heights(tiles))
    native_m = settings.earth.lon_m * 360 * math.cos(math.radians((box[1] + box[3]) / 2)) / (TILE_PX * 2**zoom)
    grid, lattice, excluded, _ = pixel_surface(pixels, zoom, ring, native_m, resolution_m)
    if land is not None:
        taken = land.where("class <> 0").select(F.lit(0).alias("grid_id"), grid.cell(grid.row(grid.frame.y(F.col("lat"))), grid.col(grid.frame.x(F.col("lon")))).alias("cell"))
        excluded = excluded.unionByName(taken).distinct()
    found = analyse(grid, lattice, rain, excluded=excluded, **options)
    found["origins"] = wanted.join(tiles.select("zoom", "x", "y", "source", "up"), ["zoom", "x", "y"], "left").groupBy("source", "up").agg(F.count("*").alias("n"))
    return found


def analyse_sheet(spark: SparkSession, path: str, rain: DataFrame, resolution_m: float | None = None, pour_point: tuple[float, float] | None = None, **options) -> dict[str, DataFrame]:
    """Sites of the contour sheet at a path; with a ``pour_point`` (lon, lat) also what drains through it, as ``pour_point``."""
    marks = settled(kml.read_placemarks(spark, path))
    bad = kml.problems(marks).first()
    if bad is not None:
        raise AnalysisError(bad.code, f"{bad.path} gives no contours.", status=400)
    vertices = kml.vertices(marks)
    if pour_point is not None:
        box = vertices.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
        check_pour_point(*pour_point, tuple(box))
    grid, lattice, _ = sheet_surface(vertices, resolution_m)
    found = analyse(grid, lattice, rain, **options)
    if pour_point is not None:
        found["pour_point"] = drained_through(found, grid, lattice, *pour_point)
    return found


def drained_through(found: dict[str, DataFrame], grid: Grid, lattice: DataFrame, lon: float, lat: float) -> DataFrame:
    """The summary of the catchment of the cell with most water near a point."""
    spark = lattice.sparkSession
    row, col = grid.row(grid.frame.y(F.lit(lat))), grid.col(grid.frame.x(F.lit(lon)))
    at = spark.range(1).select(F.lit(0).alias("grid_id"), F.lit(0).alias("point_id"), row.alias("row"), col.alias("col"))
    sized = found["tour"].select("grid_id", F.expr(f"cast(cell div {grid.n_cols} as int)").alias("row"), F.expr(f"cast(cell % {grid.n_cols} as int)").alias("col"), F.col("size").cast("double").alias("accumulation"))
    outlet = siting.snap(sized, at, grid).select("grid_id", grid.cell(F.col("row"), F.col("col")).alias("cell"))
    return siting.catchment_summary(graph.members_of(found["tour"], outlet), lattice, grid)


def check_pour_point(lon: float, lat: float, box: tuple[float, float, float, float]) -> None:
    """Refuses a point outside a sheet's box before a surface is made."""
    west, south, east, north = box
    if not (west <= lon <= east and south <= lat <= north):
        raise AnalysisError("pour_point_outside_map", f"({lon:g}, {lat:g}) lies outside {west:.6f}..{east:.6f} E and {south:.6f}..{north:.6f} N.")


def two_surfaces(a: tuple[Grid, DataFrame], b: tuple[Grid, DataFrame]) -> DataFrame:
    """How well two surfaces agree, the second sampled at the cells of the first."""
    (ga, la), (gb, lb) = a, b
    lon, lat = ga.lon(F.col("col")), ga.lat(F.col("row"))
    at = la.where("z is not null").select(F.col("cell").alias("point_id"), ((gb.frame.y(lat) - gb.y0) / gb.resolution_m).alias("prow"), ((gb.frame.x(lon) - gb.x0) / gb.resolution_m).alias("pcol"))
    other = rasters.bilinear(at, lb.select(F.col("row").alias("prow"), F.col("col").alias("pcol"), "z"))
    met = la.join(other.select(F.col("point_id").alias("cell"), "height"), "cell")
    return rasters.agreement(met.select("grid_id", "row", "col", "z"), met.select("grid_id", "row", "col", F.col("height").alias("z")))


def distance_m(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Metres between two places given in degrees."""
    frame = LocalFrame((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    return math.hypot((a[0] - b[0]) * frame.metres_per_lon, (a[1] - b[1]) * frame.metres_per_lat)
