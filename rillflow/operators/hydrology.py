"""Rainfall, runoff and what a site can store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import settings
from ..errors import AnalysisError
from ..functions import scalars
from ..functions.projection import Grid
from ..session import shuffled
from . import graph
from .focal import with_neighbours


def wet_days(rain: DataFrame) -> DataFrame:
    """Days with enough rain to count; a day without a figure is dry."""
    return rain.where(F.coalesce("mm", F.lit(0.0)) >= settings.rain.wet_mm)


def rainfall_measures(rain: DataFrame) -> DataFrame:
    """(place, years, annual_mm, rain_days, wettest_mm) of rain (place, day, mm); totals and days are those of wet days, by year."""
    spans = rain.groupBy("place").agg(F.count_distinct(F.year("day")).alias("years"))
    wet = wet_days(rain).groupBy("place").agg(F.sum("mm").alias("mm"), F.count("*").alias("n"), F.max("mm").alias("wettest_mm"))
    return spans.join(wet, "place", "left").select("place", "years", (F.col("mm") / F.col("years")).alias("annual_mm"), (F.col("n") / F.col("years")).alias("rain_days"), "wettest_mm")


def monthly_means(rain: DataFrame) -> DataFrame:
    """(place, month, mm): rain of every day, drizzle too, by month of the year and per year of the record."""
    spans = rain.groupBy("place").agg(F.count_distinct(F.year("day")).alias("years"))
    sums = rain.groupBy("place", F.month("day").alias("month")).agg(F.sum("mm").alias("mm"))
    return sums.join(spans, "place").select("place", "month", F.round(F.col("mm") / F.col("years"), 1).alias("mm"))


def annual_totals(rain: DataFrame) -> DataFrame:
    return rain.groupBy("place", F.year("day").alias("year")).agg(F.round(F.sum("mm"), 1).alias("mm"))


def runoff(rain: DataFrame, curve_number: float | None = None) -> DataFrame:
    """One row for each place: runoff of every wet day, summed and divided by the years of the record.

    Beside it stands the runoff of the same rain taken as one storm, which overstates it.
    """
    cn = settings.water.curve_number if curve_number is None else float(curve_number)
    low, high = settings.water.curve_numbers
    if not low <= cn <= high:
        raise AnalysisError("curve_number_out_of_range", f"A curve number lies between {low:g} and {high:g}.")
    retention = F.lit(25400.0 / cn - 254.0)
    daily = scalars.runoff_mm(F.col("mm"), retention)
    spans = rain.groupBy("place").agg(F.count_distinct(F.year("day")).alias("years"))
    sums = wet_days(rain).groupBy("place").agg(F.sum("mm").alias("rain"), F.sum(daily).alias("depth"), F.count("*").alias("n"), F.count_if(daily > 0).alias("contributing"))
    per_year = spans.join(sums, "place", "left").select(
        "place", (F.coalesce("rain", F.lit(0.0)) / F.col("years")).alias("rainfall_mm"), (F.coalesce("depth", F.lit(0.0)) / F.col("years")).alias("runoff_mm"),
        F.rint(F.coalesce("n", F.lit(0)) / F.col("years")).cast("long").alias("rain_days"), F.rint(F.coalesce("contributing", F.lit(0)) / F.col("years")).cast("long").alias("contributing_days"),
    )
    single = scalars.runoff_mm(F.col("rainfall_mm"), retention)
    ratio = lambda c: F.when(F.col("rainfall_mm") > 0, c / F.col("rainfall_mm")).otherwise(0.0)
    return per_year.withColumns({"coefficient": ratio(F.col("runoff_mm")), "single_event_mm": single, "single_event_coefficient": ratio(single)})


def stages(target_depth_m: float | None = None) -> list[float]:
    h = settings.water
    depth = h.depth_m if target_depth_m is None else float(target_depth_m)
    if depth <= 0:
        raise AnalysisError("bad_target_depth", "The target depth must be greater than zero.")
    return [depth * k / h.n_stages for k in range(h.n_stages + 1)]


def wet_levels(members: DataFrame, filled: DataFrame, grid: Grid) -> DataFrame:
    """(grid_id, outlet, row, col, z, level, datum): the lowest level at which water of each outlet's pool reaches each cell of its catchment.

    ``members`` is (grid_id, outlet, cell), ``filled`` (grid_id, row, col, z, filled); the datum
    is the filled level at the outlet.
    """
    ground = filled.withColumn("cell", grid.cell(F.col("row"), F.col("col")))
    own = members.select("grid_id", "outlet", "cell").join(shuffled(ground), ["grid_id", "cell"])
    datum = ground.select("grid_id", F.col("cell").alias("outlet"), F.col("filled").alias("datum"))
    # the masks of different outlets are flooded side by side, as grids of their own
    apart = own.select(F.struct("grid_id", "outlet").alias("pair"), "row", "col", "z", (F.col("cell") == F.col("outlet")).alias("seed"))
    apart = apart.withColumn("grid_id", F.concat_ws(":", "pair.grid_id", "pair.outlet"))
    reached = graph.flood(apart.select("grid_id", "row", "col", "z", "seed"), 0.0)
    names = apart.select("grid_id", "pair").distinct()
    return reached.join(shuffled(names), "grid_id").select("pair.grid_id", "pair.outlet", "row", "col", "z", "level").join(shuffled(datum), ["grid_id", "outlet"])


def stage_storage(members: DataFrame, filled: DataFrame, grid: Grid, target_depth_m: float | None = None) -> DataFrame:
    """(grid_id, outlet, step, stage_m, area_m2, volume_m3): what the ground around each outlet holds at each stage."""
    return storage_curve(wet_levels(members, filled, grid), grid, target_depth_m)


def storage_curve(wet: DataFrame, grid: Grid, target_depth_m: float | None = None) -> DataFrame:
    """``stage_storage`` from the levels that ``wet_levels`` gives; one flood serves all stages."""
    steps = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(s).alias("stage_m")) for k, s in enumerate(stages(target_depth_m))))
    at = wet.withColumn("s", F.explode(steps)).withColumn("surface", F.col("datum") + F.col("s.stage_m"))
    covered = F.col("level") <= F.col("surface")
    area = F.when(covered, grid.cell_area(F.col("row"))).otherwise(0.0)
    deep = F.greatest(F.col("surface") - F.col("z"), F.lit(0.0))
    return at.groupBy("grid_id", "outlet", F.col("s.step").alias("step"), F.col("s.stage_m").alias("stage_m")).agg(F.sum(area).alias("area_m2"), F.sum(area * deep).alias("volume_m3"))


def spill(curve: DataFrame, spacing_m: float) -> DataFrame:
    """One row for each outlet: the step at which water first tops a divide, and area and volume usable below it."""
    order = W.partitionBy("grid_id", "outlet").orderBy("step")
    before = F.lag("area_m2").over(order)
    jumped = (F.col("area_m2") > settings.water.spill_jump * before) & (before >= spacing_m**2)
    marked = curve.withColumn("spill", F.when(jumped, F.col("step") - 1))
    found = marked.groupBy("grid_id", "outlet").agg(F.min("spill").alias("spill_step"), F.max("step").alias("last_step"))
    usable = curve.join(found, ["grid_id", "outlet"]).where(F.col("step") == F.coalesce("spill_step", "last_step"))
    ends = curve.groupBy("grid_id", "outlet").agg(F.max_by("area_m2", "step").alias("surface_m2"), F.max_by("volume_m3", "step").alias("capacity_m3"), F.min_by("area_m2", "step").alias("natural_m2"), F.min_by("volume_m3", "step").alias("natural_m3"), F.max("stage_m").alias("depth_m"))
    own = usable.select("grid_id", "outlet", "spill_step", F.col("stage_m").alias("usable_depth_m"), F.col("area_m2").alias("usable_m2"), F.col("volume_m3").alias("usable_m3"))
    return own.join(ends, ["grid_id", "outlet"]).withColumn("frustum_m3", scalars.frustum_m3(F.col("depth_m"), F.col("surface_m2"), F.col("natural_m2")))


def pond_cells(wet: DataFrame, usable: DataFrame) -> DataFrame:
    """(grid_id, outlet, row, col): the water surface of each outlet at the deepest stage that it can use."""
    full = wet.join(usable.select("grid_id", "outlet", "usable_depth_m"), ["grid_id", "outlet"])
    return full.where(F.col("level") <= F.col("datum") + F.col("usable_depth_m")).select("grid_id", "outlet", "row", "col")


def hollows(filled: DataFrame, grid: Grid) -> DataFrame:
    """(grid_id, cell, hollow, hollow_m2, hollow_m3): the connected ground that had to be raised, with its size, for each of its cells."""
    low = filled.where(F.col("filled") > F.col("z"))
    patch = graph.patches(low.select("grid_id", "row", "col"), grid.n_cols, diagonal=True)
    area = grid.cell_area(F.col("row"))
    sizes = patch.join(low, ["grid_id", "row", "col"]).groupBy("grid_id", "patch").agg(F.sum(area).alias("hollow_m2"), F.sum(area * (F.col("filled") - F.col("z"))).alias("hollow_m3"))
    return patch.join(sizes, ["grid_id", "patch"]).select("grid_id", "cell", F.col("patch").alias("hollow"), "hollow_m2", "hollow_m3")


def water_balance(catchments: DataFrame, usable: DataFrame, runoff_mm: Column) -> DataFrame:
    """Yearly runoff of each catchment against what its outlet can hold."""
    joined = catchments.join(usable, ["grid_id", "outlet"])
    volume = scalars.runoff_volume_m3(runoff_mm, F.col("area_m2"))
    ratio = F.when(F.col("usable_m3") > 0, volume / F.col("usable_m3")).otherwise(F.lit(float("inf")))
    made = joined.withColumn("runoff_m3", volume).withColumn("fill_ratio", ratio).withColumn("verdict", scalars.fill_verdict(ratio))
    return made.withColumn("concentration_min", F.when(F.col("length_m") > 0, scalars.concentration_minutes(F.when(F.col("length_m") > 0, F.col("length_m")).otherwise(1.0), F.col("path_relief_m"))))


def flow_summary(lattice: DataFrame, filled: DataFrame, flow: DataFrame, accumulation: DataFrame, grid: Grid) -> DataFrame:
    """One row for each grid: cells, cells raised, greatest and total fill, outlets, and the largest accumulation."""
    raised = F.col("filled") - F.col("z")
    fills = filled.groupBy("grid_id").agg(F.count("*").alias("cells"), F.count_if(raised > 0).alias("raised"), F.max(raised).alias("max_fill_m"), F.sum(raised * grid.cell_area(F.col("row"))).alias("fill_m3"), F.count_if(raised > grid.interval_m).alias("raised_over_interval"))
    outlets = flow.groupBy("grid_id").agg(F.count_if(F.col("receiver").isNull()).alias("outlets"))
    most = accumulation.groupBy("grid_id").agg(F.max("accumulation").alias("max_accumulation"))
    return fills.join(outlets, "grid_id").join(most, "grid_id")


def touches_gap(lattice: DataFrame) -> DataFrame:
    """Cells with data next to a gap or the border."""
    wide = with_neighbours(lattice, "z")
    return wide.where(F.col("z").isNotNull() & F.exists("near", lambda v: v.isNull())).drop("near")
