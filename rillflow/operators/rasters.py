"""Joins between rasters, points and polygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.projection import Grid
from ..session import shuffled
from . import spans
from .quantiles import quantiles


def bilinear(points: DataFrame, pixels: DataFrame, key: str = "point_id") -> DataFrame:
    """(key, height) of points with fractional ``prow``, ``pcol`` over pixels (prow, pcol, z).

    The four corners are looked up by an equi-join. A point is null beside a hole, unless the
    hole has no weight, and half a pixel beyond the outermost pixels.
    """
    span = pixels.agg(F.min("prow").alias("r0"), F.max("prow").alias("r1"), F.min("pcol").alias("c0"), F.max("pcol").alias("c1"))
    wide = points.select(key, "prow", "pcol").crossJoin(F.broadcast(span))  # one row
    outside = (F.col("prow") < F.col("r0") - 0.5) | (F.col("prow") > F.col("r1") + 0.5) | (F.col("pcol") < F.col("c0") - 0.5) | (F.col("pcol") > F.col("c1") + 0.5)
    row, col = F.least(F.greatest("prow", "r0"), "r1"), F.least(F.greatest("pcol", "c0"), "c1")
    base = wide.withColumn("outside", outside).withColumn("row", row).withColumn("col", col)
    fr, fc = F.col("row") - F.floor("row"), F.col("col") - F.floor("col")
    corners = F.array(*(F.struct((F.floor("row") + a).alias("prow"), (F.floor("col") + b).alias("pcol"), ((fr if a else 1 - fr) * (fc if b else 1 - fc)).alias("w")) for a in (0, 1) for b in (0, 1)))
    wanted = base.select(key, "outside", F.explode(corners).alias("k")).where("k.w > 0 or outside").select(key, "outside", "k.prow", "k.pcol", "k.w")
    met = wanted.join(shuffled(pixels.select(F.col("prow").cast("long").alias("prow"), F.col("pcol").cast("long").alias("pcol"), "z")), ["prow", "pcol"], "left")
    hole = F.sum(F.when(F.col("z").isNull() | F.isnan("z"), F.col("w")).otherwise(0.0))
    value = F.when(~F.max("outside") & (hole <= 1e-6), F.sum(F.col("w") * F.coalesce("z", F.lit(0.0))))
    return met.groupBy(key).agg(value.alias("height"))


def nearest(points: DataFrame, pixels: DataFrame, key: str = "point_id") -> DataFrame:
    """(key, z) of the pixel nearest to each fractional place; ties go to the even index."""
    near = points.select(key, F.rint("prow").cast("long").alias("prow"), F.rint("pcol").cast("long").alias("pcol"))
    return near.join(shuffled(pixels.select(F.col("prow").cast("long").alias("prow"), F.col("pcol").cast("long").alias("pcol"), "z")), ["prow", "pcol"], "left").select(key, "z")


def class_majority(lattice: DataFrame, land: DataFrame, grid: Grid, land_grid: Grid, classes: Sequence[int], share: float = 0.5) -> DataFrame:
    """(grid_id, row, col, excluded): cells more than ``share`` covered by some classes, sampled at 3 x 3 places in each."""
    steps = F.array(*(F.struct(F.lit(a * grid.resolution_m / 3).alias("dy"), F.lit(b * grid.resolution_m / 3).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    placed = lattice.select("grid_id", "row", "col").withColumn("o", F.explode(steps))
    lon = grid.frame.lon(grid.x(F.col("col")) + F.col("o.dx"))
    lat = grid.frame.lat(grid.y(F.col("row")) + F.col("o.dy"))
    wanted = placed.select("grid_id", "row", "col", land_grid.row(land_grid.frame.y(lat)).alias("l_row"), land_grid.col(land_grid.frame.x(lon)).alias("l_col"))
    seen = land.where(F.col("class").isNotNull()).select(F.col("row").alias("l_row"), F.col("col").alias("l_col"), F.col("class").isin(*classes).alias("bad"))
    return wanted.join(seen, ["l_row", "l_col"], "left").groupBy("grid_id", "row", "col").agg((F.coalesce(F.avg(F.col("bad").cast("double")), F.lit(0.0)) > share).alias("excluded"))


def polygon_spans(spark: SparkSession, ring: Sequence[tuple[float, float]], grid_id: int = 0, site: int = 0) -> DataFrame:
    """(grid_id, site, row, first, last): the columns whose centres lie in a ring of fractional (col, row) places, by scanlines.

    Only the rows that an edge spans are made, and crossings are paired along each row.
    """
    closed = [*ring, ring[0]]
    edges = spark.createDataFrame([(float(ax), float(ay), float(bx), float(by)) for (ax, ay), (bx, by) in zip(closed[:-1], closed[1:], strict=True) if ay != by], "ax double, ay double, bx double, by double")
    rows = edges.withColumn("row", F.explode(F.expr("filter(sequence(cast(floor(least(ay, by)) as int), cast(ceil(greatest(ay, by)) as int)), r -> r >= least(ay, by) and r < greatest(ay, by))")))
    crossing = rows.select("row", (F.col("ax") + (F.col("row") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))).alias("x"))
    order = W.partitionBy("row").orderBy("x")
    pairs = crossing.withColumn("n", F.row_number().over(order)).withColumn("to", F.lead("x").over(order)).where("n % 2 = 1 and to is not null")
    found = pairs.select(F.lit(grid_id).alias("grid_id"), F.lit(site).alias("site"), "row", F.ceil("x").cast("int").alias("first"), (F.ceil("to") - 1).cast("int").alias("last"))
    return spans.merged(found)


def polygon_mask(lattice: DataFrame, ring: Sequence[tuple[float, float]]) -> DataFrame:
    """Cells of a lattice whose centre lies in a ring of fractional (col, row) places; the lattice is met by an equi-join."""
    cells = spans.to_cells(polygon_spans(lattice.sparkSession, ring)).select("row", "col")
    return lattice.join(cells, ["row", "col"], "left_semi")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(grid_id, site_a, site_b, shared, iou) of masks (grid_id, site, row, col) that share cells of one grid."""
    return spans.overlap(spans.from_cells(a), spans.from_cells(b))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(grid_id, cells, rmse, bias, p95, correlation): for each grid, two surfaces (grid_id, row, col, z) where both have data."""
    place = ["grid_id", "row", "col"]
    met = a.select(*place, F.col("z").alias("za")).join(b.select(*place, F.col("z").alias("zb")), place).where("za is not null and zb is not null")
    d = F.col("za") - F.col("zb")
    means = met.groupBy("grid_id").agg(F.count("*").alias("cells"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.corr("za", "zb").alias("correlation"))
    far = quantiles(met, ["grid_id"], F.abs(d), [0.95])
    return means.join(far, "grid_id", "left").select("grid_id", "cells", "rmse", "bias", F.col("q0").alias("p95"), "correlation")


def surface_summary(lattice: DataFrame, grid: Grid, value: str = "z", raw: str | None = None) -> DataFrame:
    """One row for each grid: mapped area, share of gaps, range, and how far smoothing moved the heights."""
    shift = F.abs(F.col(value) - F.col(raw or value))
    sums = lattice.groupBy("grid_id").agg(
        F.sum(F.when(F.col(value).isNotNull(), grid.cell_area(F.col("row"))).otherwise(0.0)).alias("mapped_m2"),
        F.avg(F.col(value).isNull().cast("double")).alias("gap_fraction"),
        F.min(value).alias("low"), F.max(value).alias("high"), F.max(shift).alias("max_shift"), F.count_if(shift > grid.interval_m).alias("over_interval"),
    )
    far = quantiles(lattice, ["grid_id"], shift, [0.999]).select(F.col("grid_id").alias("_grid"), F.col("q0").alias("p999_shift"))
    joined = sums.join(far, F.col("grid_id").eqNullSafe(F.col("_grid")), "left")
    return joined.select("grid_id", "mapped_m2", "gap_fraction", "low", "high", "max_shift", "p999_shift", "over_interval")
