"""Triangulation by tiles: the hull, what a task gets, and heights as from one triangulation of all points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillflow.operators import triangulate
from rillflow.operators.hull import convex_hulls

POINTS = "x double, y double, z double"


def table(spark, xy):
    return spark.createDataFrame([(float(x), float(y), float(np.sin(x / 90) * 30 + y * y / 4000)) for x, y in xy], POINTS)


def lattice(spark, n, step, start):
    return spark.range(n * n).select(F.col("id").alias("cell"), (F.col("id") % n * step + start).cast("double").alias("x"), (F.floor(F.col("id") / n) * step + start).cast("double").alias("y"))


@pytest.mark.parametrize("shape", ["scattered", "disc", "two lumps"])
def test_heights_are_those_of_one_triangulation(spark, monkeypatch, shape):
    rng = np.random.default_rng(8)
    xy = rng.random((500, 2)) * 1000
    if shape == "disc":
        xy = np.vstack([xy[((xy - 500) ** 2).sum(1) < 480**2], [(500 + 490 * np.cos(t), 500 + 490 * np.sin(t)) for t in np.linspace(0, 6.2, 60)]])
    if shape == "two lumps":
        xy = np.vstack([xy[:250] * 0.3, xy[250:] * 0.3 + 650])
    margins, filler = [], triangulate._filler
    monkeypatch.setattr(triangulate, "_filler", lambda tile_m, margin, outline: margins.append(margin) or filler(tile_m, margin, outline))
    cells = lattice(spark, 24, 50, -50)
    made = {r.cell: r.z for r in triangulate.triangulated(cells, table(spark, xy), 125.0).collect()}
    wanted_cells = cells.toPandas()
    points = pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "z": np.sin(xy[:, 0] / 90) * 30 + xy[:, 1] ** 2 / 4000})
    want = triangulate._tile_heights(points, wanted_cells, None, np.empty((0, 2)))
    assert len(made) == 576 and 0 < np.isnan(want).sum() < 576
    for cell, z in zip(wanted_cells["cell"], want, strict=True):
        assert (made[cell] is None and np.isnan(z)) or made[cell] == pytest.approx(z, abs=1e-6)
    if shape != "two lumps":  # where points are dense no task gets them all, although many cells lie outside the hull
        assert None not in margins and max(margins) < 1000


def test_no_points_few_points_and_points_on_a_line(spark):
    cells = lattice(spark, 3, 10, 0)
    for xy in ([], [(0, 0)], [(0, 0), (20, 20)], [(0, 0), (10, 10), (20, 20)], [(0, 0), (0, 0), (0, 0)]):
        made = triangulate.triangulated(cells, table(spark, xy), 15.0).collect()
        assert len(made) == 9 and all(r.z is None for r in made)
    lost = spark.createDataFrame([(None, 1.0, 1.0), (0.0, 0.0, 1.0), (20.0, 0.0, 1.0), (0.0, 20.0, 1.0), (0.0, 20.0, 1.0)], POINTS)
    made = {r.cell: r.z for r in triangulate.triangulated(cells, lost, 15.0).collect()}
    assert sum(z is not None for z in made.values()) == 6  # corners and sides of the hull belong to it


def test_hull_membership_against_all_sides(spark):
    rng = np.random.default_rng(2)
    xy = rng.normal(size=(4000, 2)) * (300, 100) @ np.array([[0.8, 0.6], [-0.6, 0.8]])
    hull = convex_hulls(table(spark, xy).select(F.lit(0).alias("path"), "x", "y"))
    corners = np.array([(r.x, r.y) for r in hull.orderBy("nth").collect()])
    step = np.roll(corners, -1, 0) - corners
    spots = rng.random((1500, 2)) * 3000 - 1500
    cells = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(spots)], "cell long, x double, y double")
    inside = {r.cell for r in triangulate.within_hull(cells, hull.select("x", "y", "nth"), 40.0).collect()}
    off = spots[:, None] - corners[None]
    assert inside == set(np.flatnonzero((step[:, 0] * off[..., 1] - step[:, 1] * off[..., 0] >= 0).all(1)).tolist()) and len(inside) > 50


def test_a_hull_of_many_corners_is_answered_by_a_polygon_around_it(spark):
    turns = np.linspace(0, 2 * np.pi, 700, endpoint=False)
    hull = spark.createDataFrame([(float(np.cos(t)), float(np.sin(t)), k) for k, t in enumerate(turns)], "x double, y double, nth long")
    outline = triangulate.outline_of(hull)
    assert len(outline) == triangulate.MOST_CORNERS // 2
    step, off = np.roll(outline, -1, 0) - outline, np.column_stack([np.cos(turns), np.sin(turns)])[:, None] - outline[None]
    assert (step[:, 0] * off[..., 1] - step[:, 1] * off[..., 0] >= -1e-12).all() and np.abs(outline).max() < 1.01


def test_circles_and_what_lies_beyond_a_box():
    square = np.array([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])
    box = (-1.0, -1.0, 9.0, 11.0)  # lacks a strip of the square, right of x = 9
    cases = {
        (5.0, 5.0, 1.0): True,  # inside the box
        (5.0, 5.0, 16.5): False,  # reaches into the strip
        (9.5, 5.0, 0.01): False,  # inside the strip
        (1.0, 5.0, 63.0): True,  # leaves the box to the west, where the square is not
        (5.0, -90.0, 8200.0): False,  # from far below up to the strip's corner
        (1.0, -90.0, 8150.0): True,  # from far below, but not as far east as the strip
        (np.inf, 0.0, np.inf): False,  # corners on a line
    }
    assert triangulate._certain(np.array(list(cases)), box, square).tolist() == list(cases.values())
