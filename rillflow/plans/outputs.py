"""What a caller gets: GeoJSON layers, the response of an analysis, and short texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import settings
from ..functions import geometry, scalars
from ..functions.projection import Grid
from ..operators import graph


def _degrees(grid: Grid, points: Column) -> Column:
    """Fractional (col, row) places as GeoJSON coordinates."""
    d = settings.layers.decimals
    return F.transform(points, lambda p: F.array(F.bround(grid.lon(p["x"]), d), F.bround(grid.lat(p["y"]), d)))


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    shape = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties")))


def stream_layer(flow: DataFrame, cells: DataFrame, grid: Grid, threshold_m2: float, trunk_m2: float | None = None, max_vertices: int = 60_000) -> DataFrame:
    """(grid_id, nth, feature): reaches as lines, those with most water first, as many as fit the vertex budget.

    ``cells`` has grid_id, row, col, cell and accumulation.
    """
    area = F.col("accumulation") * grid.cell_area(F.col("row"))
    stream = cells.withColumn("area", area).where(F.col("area") >= threshold_m2)
    steps = graph.reaches(flow, stream).join(stream.select("grid_id", "cell", "row", "col", "area"), ["grid_id", "cell"])
    point = F.struct("step", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    lines = steps.groupBy("grid_id", "head").agg(F.array_sort(F.collect_list(point)).alias("points"), F.max_by("area", "step").alias("area"))
    bare = F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    thin = lines.withColumn("thin", geometry.simplify(bare, F.lit(0.5))).withColumn("n", F.size("thin"))
    order = W.partitionBy("grid_id").orderBy(F.desc("area"), "head")
    ranked = thin.withColumn("nth", F.row_number().over(order)).withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    fits = ranked.where(F.col("upto") <= max_vertices)
    hectares = F.col("area") / 1e4
    is_trunk = F.lit(False) if trunk_m2 is None else F.col("area") >= trunk_m2
    width = F.round(F.least(F.lit(4.0), 0.8 + 0.6 * F.log10(F.greatest(hectares, F.lit(1.0)))), 2)
    props = F.struct(F.lit("stream").alias("role"), F.round(hectares, 1).alias("upstream_area_ha"), is_trunk.alias("watercourse"), width.alias("stroke-width"))
    return fits.select("grid_id", "nth", _feature("LineString", _degrees(grid, F.col("thin")), props).alias("feature"))


def contour_layer(lines: DataFrame, grid: Grid, interval_m: float) -> DataFrame:
    """(grid_id, level, line, feature): level lines as coloured features, thinned until all fit the vertex budget.

    The tolerance doubles until the vertices fit; each try is one aggregate.
    """
    o = settings.layers
    span = lines.agg(F.min("level").alias("low"), F.max("level").alias("high"))
    tolerance = o.thin_m / grid.resolution_m
    for _ in range(12):
        thin = lines.withColumn("thin", geometry.simplify(F.col("points"), F.lit(tolerance))).where(F.size("thin") > 1)
        if (thin.agg(F.sum(F.size("thin"))).first()[0] or 0) <= o.most_vertices:
            break
        tolerance *= 2
    wide = thin.crossJoin(F.broadcast(span))  # one row
    place = F.when(F.col("high") > F.col("low"), (F.col("level") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    props = F.struct(F.lit("contour").alias("role"), F.col("level").alias("elevation_m"), scalars.is_index_level(F.col("level"), F.lit(interval_m)).alias("index"), scalars.ramp_colour(place).alias("stroke"))
    return wide.select("grid_id", "level", "line", _feature("LineString", _degrees(grid, F.col("thin")), props).alias("feature"))


def boxed(features: DataFrame) -> DataFrame:
    """Features (feature, ...) with the box of their coordinates: west, south, east, north, null for one without."""
    numbers = lambda k: F.transform(F.regexp_extract_all("feature", F.lit(r"\[([-+0-9.Ee]+),([-+0-9.Ee]+)[],]"), F.lit(k)), lambda x: x.try_cast("double"))
    read = features.withColumn("_lon", numbers(1)).withColumn("_lat", numbers(2))
    return read.select(*features.columns, F.array_min("_lon").alias("west"), F.array_min("_lat").alias("south"), F.array_max("_lon").alias("east"), F.array_max("_lat").alias("north"))


def collection(features: DataFrame, order: list[str]) -> DataFrame:
    """(grid_id, geojson): the features of each grid in one GeoJSON text, with the box around all of their coordinates."""
    box = [F.min("west"), F.min("south"), F.max("east"), F.max("north")]
    rows = boxed(features).groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct(*order, "feature"))).alias("f"), F.array(*box).alias("box"))
    joined = F.array_join(F.transform("f", lambda x: x["feature"]), ",")
    around = F.when(F.exists("box", lambda v: v.isNull()), F.lit("")).otherwise(F.concat(F.lit('"bbox":'), F.to_json("box"), F.lit(",")))
    return rows.select("grid_id", F.concat(F.lit('{"type":"FeatureCollection",'), around, F.lit('"features":['), joined, F.lit("]}")).alias("geojson"))


def site_response(sites: DataFrame) -> DataFrame:
    """(grid_id, response): each grid's sites by rank as JSON, with fixed rounding and without infinite numbers."""
    finite = lambda c, digits: F.when(F.abs(c) < float("inf"), F.round(c, digits))
    ratio = F.when(F.col("fill_ratio") == float("inf"), -1.0).otherwise(F.round("fill_ratio", 2))
    site = F.struct(
        "rank", F.col("outlet").alias("cell"), finite(F.col("area_m2") / 1e4, 2).alias("area_ha"), finite(F.col("relief_m"), 2).alias("relief_m"), finite(F.col("length_m"), 1).alias("path_m"), finite(F.col("edge_contact") * 100, 2).alias("edge_contact_pct"),
        finite(F.col("runoff_m3"), 0).alias("runoff_m3"), finite(F.col("usable_m3"), 0).alias("usable_m3"), ratio.alias("fill_ratio"), "verdict", finite(F.col("concentration_min"), 1).alias("concentration_min"), why(F.col("lower_bound"), F.col("verdict")).alias("why"),
    )
    rows = sites.groupBy("grid_id").agg(F.array_sort(F.collect_list(site)).alias("sites"))
    return rows.select("grid_id", F.to_json(F.struct(F.lit("ok").alias("status"), "sites")).alias("response"))


def summary(responses: DataFrame) -> DataFrame:
    """(grid_id, cell, area_ha, runoff_m3, usable_m3, fill_ratio, verdict, sites): what a list of saved analyses shows of each response."""
    best = F.from_json(F.get_json_object("response", "$.sites[0]"), "cell long, area_ha double, runoff_m3 double, usable_m3 double, fill_ratio double, verdict string")
    n = F.coalesce(F.json_array_length(F.get_json_object("response", "$.sites")), F.lit(0))
    return responses.select("grid_id", best.alias("b"), n.cast("long").alias("sites")).select("grid_id", "b.*", "sites")


def surface_name(drawn: Column) -> Column:
    """What heights a catchment rests on: pixels where an area was drawn, else the sheet's contours."""
    return F.when(drawn.isNotNull(), "elevation pixels").otherwise("contour sheet")


def why(lower_bound: Column, verdict: Column) -> Column:
    """Sentences about a site, those that apply."""
    return F.array_compact(
        F.array(
            F.when(lower_bound, "The catchment runs off the mapped ground, so its area is a lower bound."),
            F.when(verdict == "oversized", "The ground can hold more than a usual year brings."),
            F.when(verdict == "overflows", "A usual year brings several times what the ground can hold."),
        )
    )


def warning_header(warnings: Column) -> Column:
    """Distinct warnings in one line of at most 900 characters of a header's alphabet."""
    line = F.regexp_replace(F.array_join(F.array_distinct(warnings), " | "), r"[^\x00-\xFF]", "?")
    return F.when(F.length(line) > 900, F.concat(F.substring(line, 1, 897), F.lit("..."))).otherwise(line)


def saved_layer(saved: DataFrame) -> DataFrame:
    """(geojson) of saved analyses whose summary has lon and lat: at most 500, the newest first."""
    lon, lat = (F.get_json_object("summary", f"$.{k}").cast("double") for k in ("lon", "lat"))
    points = saved.orderBy(F.desc("created"), "id").limit(500).select("created", "id", _feature("Point", F.array(lon, lat), F.struct("id", "name")).alias("feature"))
    return collection(points.select(F.lit(0).alias("grid_id"), (-F.col("created")).alias("order"), "id", "feature"), ["order", "id"]).drop("grid_id")
