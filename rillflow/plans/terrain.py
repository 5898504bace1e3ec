"""Whole analyses put together from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import settings
from ..errors import AnalysisError
from ..functions.projection import Grid
from ..operators import contours, focal, graph, hydrology, siting
from ..session import settled
from .outputs import collection

KEY = ["grid_id", "cell"]


@dataclass
class Drainage:
    """What routing a lattice gives: one row for each cell with data."""

    grid: Grid
    lattice: DataFrame
    filled: DataFrame
    flow: DataFrame
    cells: DataFrame


def route(lattice: DataFrame, grid: Grid, fill: bool = True, weight: str | None = None) -> Drainage:
    """Fills pits, finds receivers, accumulates, and measures slopes and distances to the edge of the data."""
    s = settings.sites
    filled = settled(graph.fill_depressions(lattice)) if fill else lattice.where("z is not null").select("grid_id", "row", "col", "z", F.col("z").alias("filled"))
    dense = lattice.select("grid_id", "row", "col").join(filled.select("grid_id", "row", "col", "filled"), ["grid_id", "row", "col"], "left")
    flow = focal.steepest_descent(dense, grid.n_cols, grid.resolution_m, "filled").select("grid_id", "row", "col", "cell", "filled", "receiver")
    ground = focal.distance_to_edge(focal.horn_slope(lattice, grid.resolution_m), grid.resolution_m, max(s.from_edge_m, grid.resolution_m)).where("z is not null")
    flow = settled(flow.join(ground.select("grid_id", "row", "col", "z", "slope", "edge_m"), ["grid_id", "row", "col"]))
    weighted = flow if weight is None else flow.join(lattice.select("grid_id", "row", "col", weight), ["grid_id", "row", "col"])
    accumulation = graph.accumulate(weighted, weight)
    return Drainage(grid, lattice, filled, flow, settled(flow.join(accumulation, KEY)))


def candidates(d: Drainage, excluded: DataFrame | None = None) -> DataFrame:
    """Stream cells on buildable, clear and available ground, with the height above their watercourse."""
    areas = siting.mapped_area(d.lattice, d.grid)
    above = graph.height_above(d.flow, siting.trunk_cells(d.cells, d.grid))
    found = siting.stream_cells(siting.buildable_cells(d.cells), areas, d.grid).join(above, KEY)
    found = siting.clear_cells(found)
    return found if excluded is None else siting.available_cells(found, excluded)


def why_no_site(d: Drainage, excluded: DataFrame | None = None) -> str:
    """Which rule left no candidate on a surface of one grid."""
    stream = siting.stream_cells(d.cells, siting.mapped_area(d.lattice, d.grid), d.grid)
    clear = siting.clear_cells(graph.height_above(d.flow, siting.trunk_cells(d.cells, d.grid)))
    cells = d.cells.select(*KEY)
    for name, kept in (("stream", stream), ("buildable", siting.buildable_cells(d.cells)), ("clear", clear)):
        cells = cells.join(kept.select(*KEY, F.lit(True).alias(name)), KEY, "left")
    ruled_out = cells.select(*KEY, F.lit(True).alias("out")).limit(0) if excluded is None else excluded.select(*KEY, F.lit(True).alias("out")).distinct()
    flags = cells.join(ruled_out, KEY, "left").withColumn("available", F.col("out").isNull()).fillna(False, ["stream", "buildable", "clear"])
    found = siting.why_none(flags).where("code is not null").first()
    return found.code if found is not None else "no_site_found"


def sites(d: Drainage, n: int | None = None, excluded: DataFrame | None = None, target_depth_m: float | None = None) -> dict[str, DataFrame]:
    """Chosen sites with their catchments, storage curves and outlines, as DataFrames by name."""
    able = settled(candidates(d, excluded))
    chosen = settled(siting.choose_sites(d.flow, able, n))
    toured = graph.tour(d.flow, d.grid.n_cols)
    members = settled(graph.members_of(toured, chosen))
    summary = siting.catchment_summary(members, d.lattice, d.grid)
    wet = settled(hydrology.wet_levels(members, d.filled, d.grid))
    curve = settled(hydrology.storage_curve(wet, d.grid, target_depth_m))
    usable = hydrology.spill(curve, d.grid.spacing_m)
    place = d.cells.select("grid_id", "cell", "row", "col")
    outline = contours.mask_geojson(members.join(place, KEY).select("grid_id", F.col("outlet").alias("site"), "row", "col"), d.grid)
    ponds = hydrology.pond_cells(wet, usable)
    return {"sites": chosen, "candidates": able, "tour": toured, "members": members, "catchments": summary, "storage": curve, "usable": usable, "outlines": outline, "ponds": ponds}


def balances(found: dict[str, DataFrame], rain: DataFrame, curve_number: float | None = None) -> DataFrame:
    """Water balance of every site under one rainfall record."""
    depth = hydrology.runoff(rain, curve_number).select("runoff_mm")
    if depth.count() != 1:
        raise AnalysisError("bad_rainfall_series", "Sites share one rainfall record.")
    catchments = found["catchments"].crossJoin(F.broadcast(depth))  # one row
    return hydrology.water_balance(catchments, found["usable"], F.col("runoff_mm"))


def _feature(geometry: Column, properties: Column) -> Column:
    """A feature around a geometry that is JSON text already; properties without a value stand there as null."""
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(properties, {"ignoreNullFields": "false"}), F.lit("}"))


def _warnings(over: Column) -> Column:
    """What a polygon's reader should know; null if nothing."""
    return F.when(over, F.array(F.lit(f"The outline keeps more than {settings.layers.most_corners} corners at the coarsest tolerance."))).alias("warnings")


def pond_features(found: dict[str, DataFrame], d: Drainage) -> DataFrame:
    """(grid_id, rank, feature): the water surface of every site; a pond of a single cell is left out."""
    key = ["grid_id", "outlet"]
    large = found["ponds"].groupBy(*key).agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    shape = contours.mask_geojson(found["ponds"].join(large, key, "left_semi").withColumnRenamed("outlet", "site"), d.grid).withColumnRenamed("site", "outlet")
    made = shape.join(found["usable"], key).join(found["sites"].select("grid_id", F.col("cell").alias("outlet"), "rank"), key)
    first = F.col("rank") == 1
    # the paints are fixed values
    paint = lambda a, b: F.when(first, a).otherwise(b)
    props = F.struct(
        F.lit("pond").alias("role"), "rank", F.rint("usable_m3").cast("long").alias("capacity_m3"), F.rint("usable_m2").cast("long").alias("surface_area_m2"), F.bround("usable_depth_m", 2).alias("depth_m"),
        paint("#08519c", "#3182bd").alias("stroke"), paint("#3182bd", "#9ecae1").alias("fill"), paint(0.6, 0.45).alias("fill-opacity"), _warnings(F.col("over")),
    )
    return made.select("grid_id", "rank", _feature(F.col("geometry"), props).alias("feature"))


def path_features(found: dict[str, DataFrame], d: Drainage) -> DataFrame:
    """(grid_id, rank, feature): the longest way of the water to the first site of each grid."""
    o = settings.layers
    first = found["sites"].where("rank = 1").select("grid_id", F.col("cell").alias("outlet"), "rank")
    known = found["catchments"].join(first, ["grid_id", "outlet"])
    steps = graph.flow_paths(found["tour"], known.select("grid_id", "outlet", F.col("remote_cell").alias("cell"))).join(d.cells.select(*KEY, "row", "col"), KEY)
    point = F.struct("step", F.array(F.bround(d.grid.lon(F.col("col")), o.decimals), F.bround(d.grid.lat(F.col("row")), o.decimals)).alias("at"))
    lines = steps.groupBy("grid_id", "outlet").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["at"]).alias("coordinates"))
    shape = F.to_json(F.struct(F.lit("LineString").alias("type"), "coordinates"))
    props = F.struct(F.lit("flow_path").alias("role"), "rank", F.bround("length_m", 1).alias("length_m"), F.bround("path_relief_m", 2).alias("relief_m"), F.lit("#e31a1c").alias("stroke"), F.lit(2).alias("stroke-width"))
    return lines.where(F.size("coordinates") > 1).join(known, ["grid_id", "outlet"]).select("grid_id", "rank", _feature(shape, props).alias("feature"))


def _trusted(found: dict[str, DataFrame]) -> DataFrame:
    """(grid_id, outlet, rank, confidence, std_m2, recommended) of the sites; without an ``ensemble`` (grid_id, outlet, std_m2, confidence) nothing speaks against any."""
    ranked = found["sites"].select("grid_id", F.col("cell").alias("outlet"), "rank")
    if "ensemble" not in found:
        return ranked.select("*", F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("double").alias("std_m2"), F.lit(True).alias("recommended"))
    held = ranked.join(found["ensemble"].select("grid_id", "outlet", "confidence", "std_m2"), ["grid_id", "outlet"], "left")
    return held.withColumn("recommended", F.coalesce(F.col("confidence") != "low", F.lit(True)))


def catchment_features(found: dict[str, DataFrame], d: Drainage) -> DataFrame:
    """(grid_id, rank, feature): the outline of every site's catchment with the figures that speak for it."""
    key = ["grid_id", "outlet"]
    area = found["catchments"].join(_trusted(found), key).join(found["outlines"].withColumnRenamed("site", "outlet"), key)
    # the paints are fixed values
    props = F.struct(
        F.lit("catchment").alias("role"), "rank", F.round(F.col("area_m2") / 1e4, 2).alias("area_ha"), "confidence", F.round(F.col("std_m2") / 1e4, 2).alias("area_uncertainty_ha"),
        F.round(F.col("edge_contact") * 100, 2).alias("edge_contact_pct"), F.col("lower_bound").alias("is_lower_bound"), F.round("relief_m", 2).alias("relief_m"), F.round("length_m", 1).alias("longest_flow_path_m"),
        F.lit(float(d.grid.resolution_m)).alias("resolution_m"), F.lit("#1f78b4").alias("stroke"), F.lit("#a6cee3").alias("fill"), F.lit(0.25).alias("fill-opacity"), _warnings(F.col("over")),
    )
    return area.select("grid_id", "rank", _feature(F.col("geometry"), props).alias("feature"))


def outlet_features(found: dict[str, DataFrame], d: Drainage) -> DataFrame:
    """(grid_id, rank, feature): the place of every site, why it was chosen, and its water balance if ``found`` has ``balances``; what is not finite is null."""
    o, key = settings.layers, ["grid_id", "outlet"]
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    ground = found["candidates"].select("grid_id", F.col("cell").alias("outlet"), "row", "col", "slope", "above")
    at = _trusted(found).join(ground, key).join(found["catchments"].select(*key, "area_m2"), key)
    figures = {"annual_runoff_m3": F.rint(finite(F.col("runoff_m3"))).cast("long"), "capacity_m3": F.rint(finite(F.col("usable_m3"))).cast("long"), "fill_ratio": F.round(finite(F.col("fill_ratio")), 2), "time_of_concentration_min": F.round(finite(F.col("concentration_min")), 1), "verdict": F.col("verdict")}
    if "balances" in found:
        at = at.join(found["balances"].select(*key, "runoff_m3", "usable_m3", "fill_ratio", "concentration_min", "verdict"), key, "left")
    else:
        figures = {}
    lon, lat = F.bround(d.grid.lon(F.col("col")), o.decimals), F.bround(d.grid.lat(F.col("row")), o.decimals)
    spot = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    props = F.struct(
        F.lit("outlet").alias("role"), "rank", "recommended", F.round(F.col("area_m2") / 1e4, 2).alias("catchment_area_ha"), "confidence",
        F.round(finite(F.col("slope")) * 100, 2).alias("slope_pct"), F.round(finite(F.col("above")), 2).alias("height_above_watercourse_m"), *(c.alias(n) for n, c in figures.items()),
        F.when(F.col("rank") == 1, "#08519c").otherwise("#6baed6").alias("marker-color"), F.lit("water").alias("marker-symbol"),
    )
    return at.select("grid_id", "rank", _feature(spot, props).alias("feature"))


def features(found: dict[str, DataFrame], d: Drainage) -> DataFrame:
    """(grid_id, layer, rank, part, feature): one row for each feature; areas are layer 0, lines 1, points 2."""
    placed = lambda df, layer, part: df.select("grid_id", F.lit(layer).alias("layer"), "rank", F.lit(part).alias("part"), "feature")
    return placed(catchment_features(found, d), 0, 0).unionByName(placed(pond_features(found, d), 0, 1)).unionByName(placed(path_features(found, d), 1, 0)).unionByName(placed(outlet_features(found, d), 2, 0))


def feature_collection(found: dict[str, DataFrame], d: Drainage) -> DataFrame:
    """One GeoJSON text for each grid: areas before lines before points, each by rank, a site's catchment before its pond."""
    return collection(features(found, d), ["layer", "rank", "part"])
