"""Rings and polylines held as arrays of structs: measures and predicates as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

POINTS = "array<struct<x: double, y: double>>"
_POINTS_TYPE = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def ring(points: Sequence[tuple[float, float]]) -> Column:
    """A constant ring from (x, y) pairs; the first is repeated at the end."""
    closed = [*points, points[0]] if points and tuple(points[0]) != tuple(points[-1]) else list(points)
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in closed))


def _sides(points: Column) -> Column:
    n = F.size(points)
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def twice_area(points: Column) -> Column:
    """Twice the signed area of a closed ring, positive if it runs counter-clockwise."""
    return F.aggregate(_sides(points), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])


def length(points: Column) -> Column:
    return F.aggregate(_sides(points), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def inside(x: Column, y: Column, points: Column) -> Column:
    """Whether a point lies in a closed ring, by the parity of its crossings to the right."""

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > y) != (by > y)) & (ax + (y - ay) / (by - ay) * (bx - ax) > x)

    return F.size(F.filter(_sides(points), crosses)) % 2 == 1


def counter_clockwise(points: Column) -> Column:
    return F.when(twice_area(points) < 0, F.reverse(points)).otherwise(points)


def bounds(points: Column) -> Column:
    """Struct of west, south, east, north."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def keep_far_points(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of a polyline stay when those within the tolerance of a chord are dropped, farthest first.

    Where a chord's ends coincide, distance from that point counts.
    """
    kept = np.zeros(len(xy), bool)
    if not len(xy):
        return kept
    kept[[0, -1]] = True
    if tolerance <= 0 or len(xy) < 3:
        kept[:] = True
        return kept
    todo = [(0, len(xy) - 1)]
    while todo:
        a, z = todo.pop()
        if z - a < 2:
            continue
        off, chord = xy[a + 1 : z] - xy[a], xy[z] - xy[a]
        span = np.hypot(*chord)
        far = np.abs(chord[1] * off[:, 0] - chord[0] * off[:, 1]) / span if span else np.hypot(off[:, 0], off[:, 1])
        best = int(far.argmax())
        if far[best] > tolerance:
            kept[a + 1 + best] = True
            todo += [(a, a + 1 + best), (a + 1 + best, z)]
    return kept


@F.pandas_udf(_POINTS_TYPE)
def simplify(points: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Polylines thinned to a tolerance; Arrow batches, one polyline at a time."""

    def thin(line, t):
        if line is None:
            return None
        xy = np.array([(p["x"], p["y"]) for p in line], float).reshape(-1, 2)
        return [{"x": x, "y": y} for x, y in xy[keep_far_points(xy, t)]]

    return pd.Series([thin(line, t) for line, t in zip(points, tolerance, strict=True)])


def close_ring(points: Column) -> Column:
    first = F.element_at(points, 1)
    return F.when(F.size(points) == 0, points).when(first == F.element_at(points, -1), points).otherwise(F.concat(points, F.array(first)))


def thin_ring(points: Column, tolerance: Column) -> Column:
    """A ring thinned to a tolerance; one that would lose its area stays as it is."""
    thinned = close_ring(simplify(points, tolerance))
    return F.when(F.size(thinned) >= 4, thinned).otherwise(close_ring(points))
