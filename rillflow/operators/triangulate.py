"""Heights of a lattice from scattered points, by Delaunay triangles.

Cells outside the hull of all points have no height and are left out first, by a join with
the hull's sides. Points are dealt to square tiles with a margin, and every tile
triangulates its own. A triangle is one of the whole set too if no point outside the tile
and its margin can lie in its circumcircle: the circle must not reach the part of the
points' outline beyond. Only such triangles give heights, so results don't depend on the
tiles. Cells that find none go into the next round with a wider margin; a task gets all
points only for cells in a void about as wide as the whole set.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled
from .hull import convex_hulls

#: Corners of the outline that every task gets; a hull of more is answered by a polygon around it.
MOST_CORNERS = 256


def delaunay(xy: np.ndarray) -> np.ndarray:
    """Triangles (n, 3) over distinct points, by inserting one point at a time."""
    n = len(xy)
    centre, size = xy.mean(0), max(float(np.ptp(xy, axis=0).max()), 1e-9)
    points = np.vstack([(xy - centre) / size, [[-60.0, -50.0], [60.0, -50.0], [0.0, 90.0]]])
    tri = np.array([[n, n + 1, n + 2]])
    circle = _circles(points, tri)
    for i in np.random.default_rng(0).permutation(n):
        bad = ((points[i] - circle[:, :2]) ** 2).sum(1) < circle[:, 2] * (1 - 1e-12)
        old = tri[bad]
        edges = np.concatenate([old[:, [0, 1]], old[:, [1, 2]], old[:, [2, 0]]])
        code = np.sort(edges, 1) @ np.array([n + 3, 1])
        _, first, times = np.unique(code, return_index=True, return_counts=True)
        rim = edges[first[times == 1]]
        new = np.column_stack([rim, np.full(len(rim), i)])
        a, b, c = points[new[:, 0]], points[new[:, 1]], points[new[:, 2]]
        new = new[np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) > 1e-14]
        tri = np.concatenate([tri[~bad], new])
        circle = np.concatenate([circle[~bad], _circles(points, new)])
    return tri[(tri < n).all(1)]


def _circles(points: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Centre and squared radius of the circle through each triangle's corners."""
    a, b, c = points[tri[:, 0]], points[tri[:, 1]], points[tri[:, 2]]
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    bb, cc = (b**2).sum(1), (c**2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.column_stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d])
    return np.column_stack([a + u, (u**2).sum(1)])


def _beyond(outline: np.ndarray, axis: int, at: float, sign: int) -> np.ndarray:
    """The part of a convex polygon on the far side of a line across an axis."""
    depth = sign * (outline[:, axis] - at)
    kept = []
    for p, q, dp, dq in zip(outline, np.roll(outline, -1, 0), depth, np.roll(depth, -1), strict=True):
        if dp >= 0:
            kept.append(p)
        if (dp > 0 > dq) or (dp < 0 < dq):
            kept.append(p + (q - p) * dp / (dp - dq))
    return np.array(kept).reshape(-1, 2)


def _clear(circle: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which circles stay clear of a convex polygon, corners counter-clockwise."""
    out = np.ones(len(circle), bool)
    if not len(part):
        return out
    step = np.roll(part, -1, 0) - part
    length = np.maximum((step**2).sum(1), 1e-300)
    for lo in range(0, len(circle), 256):
        off = circle[lo : lo + 256, None, :2] - part[None]
        along = np.clip((off * step).sum(2) / length, 0, 1)
        away = ((off - along[..., None] * step) ** 2).sum(2).min(1)
        inside = ((step[:, 0] * off[..., 1] - step[:, 1] * off[..., 0]) >= 0).all(1) & (len(part) > 2)
        out[lo : lo + 256] = ~inside & (away > circle[lo : lo + 256, 2] * (1 + 1e-9))
    return out


def _certain(circle: np.ndarray, box: tuple[float, float, float, float], outline: np.ndarray) -> np.ndarray:
    """Which circles hold no point outside a box, if all points lie in the outline."""
    sure = np.isfinite(circle).all(1)
    circle = np.where(sure[:, None], circle, 0.0)
    r = np.sqrt(circle[:, 2])
    for axis, at, sign in ((0, box[0], -1), (1, box[1], -1), (0, box[2], 1), (1, box[3], 1)):
        crosses = sure & (sign * (circle[:, axis] - at) + r >= 0)
        if crosses.any():
            sure[crosses] = _clear(circle[crosses], _beyond(outline, axis, at, sign))
    return sure


def _tile_heights(points: pd.DataFrame, cells: pd.DataFrame, box: tuple[float, float, float, float] | None, outline: np.ndarray) -> np.ndarray:
    """Height of each cell; NaN where no triangle that is sure to be one of the whole set covers it."""
    out = np.full(len(cells), np.nan)
    spots = points.groupby(["x", "y"], as_index=False)["z"].first()
    if len(spots) < 3:
        return out
    xy = spots[["x", "y"]].to_numpy()
    tri = delaunay(xy)
    if box is not None and len(tri):
        tri = tri[_certain(_circles(xy, tri), box, outline)]
    if not len(tri):
        return out
    z = spots["z"].to_numpy()
    a, b, c = xy[tri[:, 0]], xy[tri[:, 1]], xy[tri[:, 2]]
    det = (b[:, 1] - c[:, 1]) * (a[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (a[:, 1] - c[:, 1])
    where = cells[["x", "y"]].to_numpy()
    for lo in range(0, len(where), 256):
        p = where[lo : lo + 256, None, :] - c[None]
        u = ((b[:, 1] - c[:, 1]) * p[..., 0] + (c[:, 0] - b[:, 0]) * p[..., 1]) / det
        v = ((c[:, 1] - a[:, 1]) * p[..., 0] + (a[:, 0] - c[:, 0]) * p[..., 1]) / det
        least = np.minimum(np.minimum(u, v), 1 - u - v)
        best = least.argmax(1)
        rows = np.arange(len(best))
        hit = least[rows, best] >= -1e-9
        k = tri[best]
        made = u[rows, best] * z[k[:, 0]] + v[rows, best] * z[k[:, 1]] + (1 - u[rows, best] - v[rows, best]) * z[k[:, 2]]
        out[lo : lo + 256] = np.where(hit, made, np.nan)
    return out


def _filler(tile_m: float, margin: float | None, outline: np.ndarray):
    """What fills the cells of one tile; without a margin the tile has all points."""

    def run(cell_rows: pd.DataFrame, point_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(cell_rows):
            return pd.DataFrame({"cell": pd.Series(dtype="int64"), "x": pd.Series(dtype=float), "y": pd.Series(dtype=float), "z": pd.Series(dtype=float)})
        x, y = (cell_rows[k].iloc[0] * tile_m for k in ("tx", "ty"))
        box = None if margin is None else (x - margin, y - margin, x + tile_m + margin, y + tile_m + margin)
        return cell_rows[["cell", "x", "y"]].assign(z=_tile_heights(point_rows, cell_rows, box, outline))

    return run


def outline_of(hull: DataFrame) -> np.ndarray:
    """A convex polygon around all points, of at most ``MOST_CORNERS`` corners: their hull, or what as many half-planes leave of a square."""
    corners = hull.orderBy("nth").limit(MOST_CORNERS + 1).select("x", "y").collect()
    if len(corners) <= MOST_CORNERS:
        return np.array([(p.x, p.y) for p in corners]).reshape(-1, 2)
    turns = [2 * np.pi * k / (MOST_CORNERS // 2) for k in range(MOST_CORNERS // 2)]
    reach = hull.agg(*(F.max(F.col("x") * float(np.cos(t)) + F.col("y") * float(np.sin(t))) for t in turns)).first()
    sides = np.column_stack([np.cos(turns), np.sin(turns)])
    following = np.roll(sides, -1, 0)
    cross = sides[:, 0] * following[:, 1] - sides[:, 1] * following[:, 0]
    d, e = np.array(reach), np.roll(reach, -1)
    return np.column_stack([(d * following[:, 1] - e * sides[:, 1]) / cross, (e * sides[:, 0] - d * following[:, 0]) / cross])


def within_hull(cells: DataFrame, hull: DataFrame, tile_m: float) -> DataFrame:
    """Cells (x, y, ...) inside a hull (x, y, nth) or on it.

    Each side of the hull is dealt to the strips of ``tile_m`` that it crosses, so a cell meets those of its strip by an equi-join.
    """
    order = W.orderBy("nth")
    whole = hull.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.min("y").alias("y0"), F.min_by("x", "nth").alias("hx"), F.min_by("y", "nth").alias("hy")).first()
    if whole.x0 is None:
        return cells.limit(0)
    slack = 1e-9 * max(whole.x1 - whole.x0, whole.y1 - whole.y0, 1e-9)
    sides = hull.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.coalesce(F.lead("x").over(order), F.lit(whole.hx)).alias("bx"), F.coalesce(F.lead("y").over(order), F.lit(whole.hy)).alias("by")).where("ax <> bx")
    strip = lambda c: F.floor(c / tile_m)
    dealt = sides.withColumn("strip", F.explode(F.sequence(strip(F.least("ax", "bx") - slack), strip(F.greatest("ax", "bx") + slack))))
    at = F.col("ay") + (F.col("x") - F.col("ax")) / (F.col("bx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    spanned = F.col("x").between(F.least("ax", "bx"), F.greatest("ax", "bx"))
    # going round counter-clockwise, sides to the east lie below, those to the west above
    out = F.when(F.col("bx") > F.col("ax"), F.col("y") < at - slack).otherwise(F.col("y") > at + slack)
    across = cells.where(F.col("x").between(whole.x0 - slack, whole.x1 + slack) & F.col("y").between(whole.y0 - slack, whole.y1 + slack))
    return across.withColumn("_strip", strip(F.col("x"))).join(dealt, (F.col("_strip") == F.col("strip")) & spanned & out, "left_anti").drop("_strip")


def triangulated(cells: DataFrame, points: DataFrame, tile_m: float, margin_m: float | None = None) -> DataFrame:
    """(cell, z) of cells (cell, x, y) from points (x, y, z); null outside the hull of the points."""
    spots = points.select(*(F.col(c).cast("double").alias(c) for c in "xyz")).where("x IS NOT NULL AND y IS NOT NULL")
    hull = settled(convex_hulls(spots.select(F.lit(0).alias("path"), "x", "y")).select("x", "y", "nth"))
    outline = outline_of(hull)
    if len(outline) < 3:
        return cells.select("cell", F.lit(None).cast("double").alias("z"))
    width = float(np.ptp(outline, axis=0).max()) + 2 * tile_m
    margin = tile_m / 2 if margin_m is None else margin_m
    todo = settled(within_hull(cells.select("cell", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), hull, tile_m))
    done = None
    while True:
        last = margin >= width
        tile = lambda c: F.floor(F.col(c) / tile_m)
        if last:
            dealt = spots.withColumn("tx", F.lit(0).cast("long")).withColumn("ty", F.lit(0).cast("long"))
            placed = todo.withColumn("tx", F.lit(0).cast("long")).withColumn("ty", F.lit(0).cast("long"))
        else:
            near = lambda c: F.sequence(F.floor((F.col(c) - margin) / tile_m), F.floor((F.col(c) + margin) / tile_m))
            placed = todo.withColumn("tx", tile("x")).withColumn("ty", tile("y"))
            # tiles without cells need no points
            dealt = spots.withColumn("tx", F.explode(near("x"))).withColumn("ty", F.explode(near("y"))).join(placed.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")

        made = settled(placed.groupBy("tx", "ty").cogroup(dealt.groupBy("tx", "ty")).applyInPandas(_filler(tile_m, None if last else margin, outline), "cell long, x double, y double, z double"))
        found = made.where("z is not null and not isnan(z)").select("cell", "z")
        done = found if done is None else done.unionByName(found)
        todo = made.where("z is null or isnan(z)").select("cell", "x", "y")
        if last or not todo.limit(1).count():
            return cells.select("cell").join(done, "cell", "left")
        margin *= 4
