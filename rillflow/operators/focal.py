"""Neighbourhood operators on dense lattices.

A lattice is a DataFrame with one row for each cell of a rectangle: ``grid_id``, ``row``,
``col`` and values that are null where there is no data. Row 0 is the south edge. A
neighbourhood takes two window passes, one along rows and one along columns, so a lattice
is shuffled twice whatever the size of the neighbourhood, and no cell is copied to its
neighbours. Window partitions are single rows and columns of one grid; they spill.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import settings

#: Steps (row, col) to the eight neighbours; the order decides between equally steep ones.
NEIGHBOURS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def along_row(grid: str = "grid_id"):
    return W.partitionBy(grid, "row").orderBy("col")


def along_col(grid: str = "grid_id"):
    return W.partitionBy(grid, "col").orderBy("row")


def with_extremes(lattice: DataFrame, **extremes: Column) -> DataFrame:
    """Adds aggregates of each grid to its cells; they are combined before they are shuffled, so no task needs a whole grid."""
    per_grid = lattice.groupBy(F.col("grid_id").alias("_grid")).agg(*(c.alias(n) for n, c in extremes.items()))
    return lattice.join(per_grid, F.col("grid_id").eqNullSafe(F.col("_grid"))).drop("_grid")


def with_neighbours(lattice: DataFrame, value: str, name: str = "near") -> DataFrame:
    """Adds the 3 x 3 values around each cell as an array, row by row from the south-west; null where there are none."""
    triple = F.array(F.lag(value).over(along_row()), F.col(value), F.lead(value).over(along_row()))
    wide = lattice.withColumn("_triple", triple)
    none = F.array(*[F.lit(None).cast(lattice.schema[value].dataType)] * 3)
    both = F.concat(F.coalesce(F.lag("_triple").over(along_col()), none), F.col("_triple"), F.coalesce(F.lead("_triple").over(along_col()), none))
    return wide.withColumn(name, both).drop("_triple")


def at(near: Column, d_row: int, d_col: int) -> Column:
    return F.get(near, 3 * (d_row + 1) + d_col + 1)


def steepest_descent(lattice: DataFrame, n_cols: int, resolution_m: float, value: str = "z") -> DataFrame:
    """(grid_id, row, col, cell, value, receiver, gradient): the lower neighbour with the steepest drop, null at outlets and pits."""
    wide = with_neighbours(lattice, value)
    cell = F.col("row").cast("long") * n_cols + F.col("col")
    options = []
    for rank, (d_row, d_col) in enumerate(NEIGHBOURS):
        distance = resolution_m * (settings.flow.diagonal if d_row and d_col else 1.0)
        drop = (F.col(value) - at(F.col("near"), d_row, d_col)) / distance
        options.append(F.when(drop > 0, F.struct(drop.alias("gradient"), F.lit(-rank).alias("rank"), (cell + d_row * n_cols + d_col).alias("receiver"))))
    best = F.array_max(F.array(*options))
    return wide.where(F.col(value).isNotNull()).select("grid_id", "row", "col", cell.alias("cell"), value, best["receiver"].alias("receiver"), best["gradient"].alias("gradient"))


def horn_slope(lattice: DataFrame, resolution_m: float, value: str = "z", name: str = "slope") -> DataFrame:
    """Adds the weighted 3 x 3 gradient as rise over run; a missing neighbour counts as level ground."""

    def v(d_row: int, d_col: int) -> Column:
        return F.coalesce(at(F.col("near"), d_row, d_col), F.col(value))

    dx = ((v(-1, 1) + 2 * v(0, 1) + v(1, 1)) - (v(-1, -1) + 2 * v(0, -1) + v(1, -1))) / (8 * resolution_m)
    dy = ((v(-1, -1) + 2 * v(-1, 0) + v(-1, 1)) - (v(1, -1) + 2 * v(1, 0) + v(1, 1))) / (8 * resolution_m)
    wide = with_neighbours(lattice, value)
    return wide.withColumn(name, F.when(F.col(value).isNotNull(), F.hypot(dx, dy))).drop("near")


def hillshade(lattice: DataFrame, resolution_m: float, value: str = "z", azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Adds ``shade`` between 0 and 1; gradients are central differences, one-sided at the edge of the lattice."""
    lowest = with_extremes(lattice, _lowest=F.min(value))
    wide = with_neighbours(lowest.withColumn("_v", F.coalesce(F.col(value), F.col("_lowest"))).drop("_lowest"), "_v")

    def slope(before: Column, after: Column) -> Column:
        here = F.col("_v")
        steps = F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0)
        return (F.coalesce(after, here) - F.coalesce(before, here)) / (steps * resolution_m)

    near = F.col("near")
    dx, dy = slope(at(near, 0, -1), at(near, 0, 1)), slope(at(near, -1, 0), at(near, 1, 0))
    steep, aspect = F.atan(F.hypot(dx, dy)), F.atan2(-dx, dy)
    az, alt = math.radians(azimuth), math.radians(altitude)
    shade = math.sin(alt) * F.cos(steep) + math.cos(alt) * F.sin(steep) * F.cos(F.lit(az) - aspect)
    return wide.withColumn("shade", F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0))).drop("near", "_v")


def _padded(lattice: DataFrame, axis: str, before: int, after: int, mode: str) -> DataFrame:
    """The lattice with copies of cells beyond both ends of an axis: the end cell again (nearest) or mirrored (reflect)."""
    other = "row" if axis == "col" else "col"
    span = W.partitionBy("grid_id", other)
    sized = lattice.withColumn("_first", F.min(axis).over(span)).withColumn("_last", F.max(axis).over(span))
    low, high = F.col(axis) - F.col("_first"), F.col("_last") - F.col(axis)
    if mode == "nearest":
        left = F.when(low == 0, F.transform(F.sequence(F.lit(1), F.lit(max(before, 1))), lambda k: F.col("_first") - k))
        right = F.when(high == 0, F.transform(F.sequence(F.lit(1), F.lit(max(after, 1))), lambda k: F.col("_last") + k))
    else:
        left = F.when(low < before, F.array(F.col("_first") - 1 - low))
        right = F.when(high < after, F.array(F.col("_last") + 1 + high))
    none = F.array().cast("array<int>")
    places = F.concat(F.array(F.col(axis)), F.coalesce(left.cast("array<int>"), none), F.coalesce(right.cast("array<int>"), none))
    return sized.withColumn("_own", F.col(axis)).withColumn(axis, F.explode(places))


def _weighted(lattice: DataFrame, axis: str, values: Sequence[str], weights: Sequence[float], before: int, mode: str) -> DataFrame:
    after = len(weights) - 1 - before
    order = along_row() if axis == "col" else along_col()
    taps = F.array(*(F.lit(float(w)) for w in weights))
    wide = _padded(lattice, axis, before, after, mode)
    for v in values:
        frame = F.collect_list(v).over(order.rowsBetween(-before, after))
        wide = wide.withColumn(f"_{v}", F.aggregate(F.zip_with(frame, taps, lambda a, w: a * w), F.lit(0.0), lambda s, x: s + x))
    inside = wide.where(F.col(axis) == F.col("_own"))
    return inside.select(*(c for c in lattice.columns if c not in values), *(F.col(f"_{v}").alias(v) for v in values))


def convolve(lattice: DataFrame, values: Sequence[str], weights: Sequence[float], before: int, mode: str = "nearest") -> DataFrame:
    """Values weighted along columns and then along rows with the same weights; the first weight is ``before`` cells back."""
    return _weighted(_weighted(lattice, "row", values, weights, before, mode), "col", values, weights, before, mode)


def gaussian_weights(sigma_cells: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma_cells + 0.5)
    raw = [math.exp(-0.5 * (k / sigma_cells) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smooth(lattice: DataFrame, sigma_cells: float, value: str = "z", name: str = "smoothed", mode: str = "nearest") -> DataFrame:
    """Adds the Gaussian mean of the cells that have data; cells without stay without."""
    if sigma_cells <= 0:
        return lattice.withColumn(name, F.col(value))
    weights = gaussian_weights(sigma_cells)
    prepared = lattice.withColumn("num", F.coalesce(F.col(value), F.lit(0.0))).withColumn("den", F.col(value).isNotNull().cast("double"))
    made = convolve(prepared, ["num", "den"], weights, len(weights) // 2, mode)
    mean = F.when(F.col(value).isNotNull() & (F.col("den") > settings.sheet.least_weight), F.col("num") / F.col("den"))
    return made.withColumn(name, mean).drop("num", "den")


def box_weights(size: int) -> tuple[list[float], int]:
    """Equal weights, and how many lie before the cell; an even box reaches one further back."""
    return [1.0 / size] * size, size // 2


def relative_elevation(lattice: DataFrame, resolution_m: float, spacing_m: float, value: str = "z") -> DataFrame:
    """Adds the height above the mean of the cells with data in a box around each cell."""
    radius = spacing_m * settings.sites.relief_spacings
    size = max(3, round(2 * radius / resolution_m) | 1)
    weights, before = box_weights(size)
    prepared = lattice.withColumn("num", F.coalesce(F.col(value), F.lit(0.0))).withColumn("den", F.col(value).isNotNull().cast("double"))
    made = convolve(prepared, ["num", "den"], weights, before, "nearest")
    return made.withColumn("relative", F.col(value) - F.col("num") / F.greatest(F.col("den"), F.lit(1e-6))).drop("num", "den")


def local_std(lattice: DataFrame, value: str, size: int, name: str = "texture") -> DataFrame:
    """Adds the standard deviation in a box around each cell; beyond the edge the lattice is mirrored."""
    weights, before = box_weights(size)
    prepared = lattice.withColumn("mean", F.col(value)).withColumn("square", F.col(value) * F.col(value))
    made = convolve(prepared, ["mean", "square"], weights, before, "reflect")
    return made.withColumn(name, F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("mean", "square")


def distance_to_edge(lattice: DataFrame, resolution_m: float, cap_m: float, value: str = "z") -> DataFrame:
    """Adds the exact distance to the nearest cell without data or off the lattice, or ``cap_m`` where that is nearer.

    Along rows the nearest gap is found at any distance; columns are then searched as far as the cap.
    """
    cap = math.ceil(cap_m / resolution_m)
    gap = F.when(F.col(value).isNull(), F.col("col"))
    ahead = along_row().rowsBetween(0, W.unboundedFollowing)
    span = W.partitionBy("grid_id", "row")
    left = F.coalesce(F.last(gap, ignorenulls=True).over(along_row().rowsBetween(W.unboundedPreceding, 0)), F.min("col").over(span) - 1)
    right = F.coalesce(F.first(gap, ignorenulls=True).over(ahead), F.max("col").over(span) + 1)
    flat = lattice.withColumn("_flat", F.least(F.col("col") - left, right - F.col("col")).cast("double"))
    order, column = along_col(), W.partitionBy("grid_id", "col")
    south, north = F.col("row") - F.min("row").over(column) + 1, F.max("row").over(column) + 1 - F.col("row")
    parts = [F.lit(float(cap * cap)), (south * south).cast("double"), (north * north).cast("double")]
    for d in range(-cap, cap + 1):
        other = F.lag("_flat", -d).over(order) if d < 0 else (F.col("_flat") if d == 0 else F.lead("_flat", d).over(order))
        parts.append(other * other + float(d * d))
    return flat.withColumn("edge_m", F.sqrt(F.least(*parts)) * resolution_m).drop("_flat")


def morph(lattice: DataFrame, mask: str, grow: bool, steps: int = 1) -> DataFrame:
    """A boolean mask grown or shrunk by so many 4-neighbour steps; beyond the lattice is empty ground."""
    for _ in range(steps):
        wide = with_neighbours(lattice, mask)
        near = [F.coalesce(at(F.col("near"), a, b), F.lit(False)) for a, b in ((-1, 0), (0, -1), (0, 1), (1, 0))]
        value = F.col(mask)
        for n in near:
            value = value | n if grow else value & n
        lattice = wide.withColumn(mask, value).drop("near")
    return lattice
