"""Level lines and polygons of a lattice.

Crossings and boundary sides are found cell by cell with window passes and joins. Both are
directed, high ground or the mask on their left, so that every joint has one way in and one
way out. The order along a line is then list ranking: cells of a chain look ahead twice as
far in each round, whatever the number of lines, and one sort puts them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import settings
from ..errors import AnalysisError
from ..functions import geometry
from ..functions.projection import Grid
from ..functions.scalars import round_interval
from ..session import settled, shuffled
from . import graph
from .focal import along_col, along_row


#: Bits of a joint's number within its level.
_JOINT_BITS = 40


def _squares(lattice: DataFrame, value: str) -> DataFrame:
    """(grid_id, row, col, sw, se, ne, nw, low, high) of every square with four known corners."""
    east, north = F.lead(value).over(along_row()), F.lead(F.struct(value, "_east")).over(along_col())
    square = lattice.withColumn("_east", east).withColumn("_north", north)
    corners = square.select("grid_id", "row", "col", F.col(value).alias("sw"), F.col("_east").alias("se"), F.col("_north._east").alias("ne"), F.col(f"_north.{value}").alias("nw")).where("sw + se + ne + nw is not null")
    return corners.select("*", F.least("sw", "se", "ne", "nw").alias("low"), F.greatest("sw", "se", "ne", "nw").alias("high"))


def _segments(met: DataFrame, n_cols: int | Column) -> DataFrame:
    """Directed segments of squares with ``level`` and its number ``nth``: from the side where a walk around the square goes down to that where it goes up."""
    level, row, col = F.col("level"), F.col("row"), F.col("col")

    def side(start: str, end: str, up: int, right: int, along: str):
        """Where the line crosses a side of the square, if its two corners lie on either side of the level."""
        zs, ze = F.col(start), F.col(end)
        share = (level - zs) / (ze - zs)
        number = 2 * ((row + up).cast("long") * n_cols + col + right) + int(along == "north")
        point = F.struct(
            number.alias("id"), (col + right + (share if along == "east" else 0.0)).alias("x"), (row + up + (share if along == "north" else 0.0)).alias("y")
        )
        return F.when((zs >= level) != (ze >= level), point)

    south, north_, west, east_ = side("sw", "se", 0, 0, "east"), side("nw", "ne", 1, 0, "east"), side("sw", "nw", 0, 0, "north"), side("se", "ne", 0, 1, "north")
    crossed = met.select(
        "grid_id", "level", "nth", *((F.col(c) >= level).alias(f"{c}_above") for c in ("sw", "se", "nw")), ((F.col("sw") + F.col("se") + F.col("ne") + F.col("nw")) / 4.0 >= level).alias("centre_above"),
        south.alias("s"), east_.alias("e"), north_.alias("n"), west.alias("w"),
    )
    around = F.array_compact(F.array("s", "e", "n", "w"))
    s, e, n, w = (F.col(c) for c in "senw")
    sw, se, nw = (F.col(f"{c}_above") for c in ("sw", "se", "nw"))

    def pair(a, b):
        return F.struct(a.alias("a"), b.alias("b"))

    one, two = F.get(around, F.lit(0)), F.get(around, F.lit(1))
    # counter-clockwise from the south side; the first side met goes down if the corner before it is above
    falls = F.when(s.isNotNull(), sw).when(e.isNotNull(), se).otherwise(~nw)
    # a line joins the two sides that it crosses; it crosses all four where opposite corners agree, and
    # then keeps the centre on the side of those two corners that are like it
    saddle = F.when(F.col("centre_above") == sw, F.when(sw, F.array(pair(s, e), pair(n, w))).otherwise(F.array(pair(e, s), pair(w, n)))).otherwise(F.when(sw, F.array(pair(s, w), pair(n, e))).otherwise(F.array(pair(w, s), pair(e, n))))
    lines = F.when(F.size(around) == 4, saddle).when(falls, F.array(pair(one, two))).otherwise(F.array(pair(two, one)))
    segments = crossed.select("grid_id", "level", "nth", F.explode(lines).alias("k"))
    return segments.select("grid_id", "level", "nth", *(F.col(f"k.{k}.{f}").alias(name.format(k)) for k in "ab" for f, name in (("id", "id_{}"), ("x", "{}x"), ("y", "{}y"))))


def crossings(lattice: DataFrame, levels: DataFrame, n_cols: int, value: str = "z") -> DataFrame:
    """(grid_id, level, nth, id_a, ax, ay, id_b, bx, by): segments of level lines in columns and rows of the lattice, high ground on their left.

    ``levels`` (grid_id, levels) lists each grid's levels; ``nth`` is a level's place there. A
    square looks only at the levels between its lowest and highest corner. Ids name
    lattice sides, so a segment ends at the id where the next one begins.
    """
    listed = levels.select("grid_id", F.transform("levels", lambda x, i: F.struct(x.alias("level"), i.alias("nth"))).alias("levels"))
    met = _squares(lattice, value).join(listed, "grid_id").withColumn("l", F.explode(F.filter("levels", lambda x: (x["level"] > F.col("low")) & (x["level"] <= F.col("high")))))
    return _segments(met.withColumn("level", F.col("l.level")).withColumn("nth", F.col("l.nth")), n_cols)


def level_lines(segments: DataFrame) -> DataFrame:
    """(grid_id, level, line, points, closed): directed segments joined to polylines; ``line`` is the smallest joint's id.

    A closed line begins and ends at its smallest joint, an open one begins where it enters.
    """
    joint = lambda c: F.shiftleft(F.col("nth").cast("long"), _JOINT_BITS) + F.col(c)
    segments = settled(segments)
    starts = segments.select("grid_id", "level", joint("id_a").alias("cell"), joint("id_b").alias("receiver"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    ends = segments.select("grid_id", "level", joint("id_b").alias("cell"), F.lit(None).cast("long").alias("receiver"), F.col("bx").alias("x"), F.col("by").alias("y"))
    # most ends are starts too; which of the two rows is kept does not matter but for the receiver
    joints = settled(starts.unionByName(ends).groupBy("grid_id", "cell").agg(F.max("receiver").alias("receiver"), F.first("level").alias("level"), F.first("x").alias("x"), F.first("y").alias("y")))
    ordered = graph.chains(joints.select("grid_id", "cell", "receiver")).join(shuffled(joints.drop("receiver")), ["grid_id", "cell"])
    point = F.struct("step", F.struct("x", "y").alias("p"))
    lines = ordered.groupBy("grid_id", "level", "chain").agg(F.transform(F.array_sort(F.collect_list(point)), lambda q: q["p"]).alias("points"), F.first("closed").alias("closed"))
    points = F.when(F.col("closed"), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    return lines.select("grid_id", "level", F.col("chain").bitwiseAND(F.lit((1 << _JOINT_BITS) - 1)).alias("line"), points.alias("points"), "closed")


def contours(lattice: DataFrame, grid: Grid, interval_m: float | None = None, value: str = "z", max_levels: int = 400) -> DataFrame:
    """Level lines at multiples of an interval, of a round one if none is given; more than ``max_levels`` in a grid are refused."""
    span = lattice.groupBy("grid_id").agg(F.min(value).alias("bottom"), F.max(value).alias("top"))
    relief = F.col("top") - F.col("bottom")
    step = F.lit(float(interval_m)) if interval_m else round_interval(relief)
    first = (F.floor(F.col("bottom") / step) + 1).cast("long")
    n_levels = F.ceil(F.col("top") / step) - first
    spans = settled(span.select("grid_id", "top", step.alias("step"), first.alias("first"), n_levels.alias("n"), relief.alias("relief"), round_interval(relief, max_levels // 2).alias("round")))
    over = spans.where(F.col("n") > max_levels).orderBy(F.desc("n")).first()
    if over:
        raise AnalysisError(
            "invalid_interval",
            f"A {over.step:g} m interval over {over.relief:.0f} m of relief is {over.n} lines; the limit is {max_levels}.",
            f"Ask for {over.round:g} m or more, or omit it.",
        )
    # the multiples from a square's lowest to its highest corner, one too many at either end against rounding
    squares = _squares(lattice, value).join(spans.select("grid_id", "top", "step", "first", "n"), "grid_id")
    numbers = F.expr("sequence(greatest(cast(floor(low / step) as long) - 1, first), least(cast(ceil(high / step) as long) + 1, first + n - 1))")
    some = F.expr("greatest(cast(floor(low / step) as long) - 1, first) <= least(cast(ceil(high / step) as long) + 1, first + n - 1)")
    met = squares.where(some).withColumn("k", F.explode(numbers)).withColumn("level", F.col("k") * F.col("step")).where("level > low AND level <= high")
    return level_lines(_segments(met.withColumn("nth", F.col("k") - F.col("first")), grid.n_cols))


#: Sides of a cell: the step to the cell beyond, and the corners (row, col) at start and end, the cell on the left.
_SIDES = (((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0)))


def boundary(members: DataFrame) -> DataFrame:
    """(grid_id, site, row, col, r0, c0, r1, c1): sides of mask cells (grid_id, site, row, col) that face out, walked counter-clockwise."""
    kind = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("dr", "dc", "ar", "ac", "zr", "zc"), (*d, *a, *z), strict=True))) for d, a, z in _SIDES))
    sides = members.select("grid_id", "site", "row", "col").withColumn("k", F.explode(kind))
    beyond = members.select("grid_id", "site", F.col("row").alias("n_row"), F.col("col").alias("n_col"))
    faced = sides.withColumn("n_row", F.col("row") + F.col("k.dr")).withColumn("n_col", F.col("col") + F.col("k.dc"))
    out = faced.join(shuffled(beyond), ["grid_id", "site", "n_row", "n_col"], "left_anti")
    return out.select("grid_id", "site", "row", "col", *((F.col(c) + F.col(f"k.{k}")).alias(n) for n, c, k in (("r0", "row", "ar"), ("c0", "col", "ac"), ("r1", "row", "zr"), ("c1", "col", "zc"))))


def _next_sides(sides: DataFrame) -> DataFrame:
    """Each side with the one that follows it; where two follow, the one that turns furthest left."""
    turn = lambda a: (F.col(f"{a}_r1") - F.col(f"{a}_r0"), F.col(f"{a}_c1") - F.col(f"{a}_c0"))
    a = sides.select("grid_id", "site", *(F.col(c).alias(f"a_{c}") for c in ("side", "r0", "c0", "r1", "c1")))
    b = sides.select("grid_id", "site", *(F.col(c).alias(f"b_{c}") for c in ("side", "r0", "c0", "r1", "c1")))
    met = a.join(shuffled(b.withColumn("a_r1", F.col("b_r0")).withColumn("a_c1", F.col("b_c0"))), ["grid_id", "site", "a_r1", "a_c1"])
    (ar, ac), (br, bc) = turn("a"), turn("b")
    left = ac * br - ar * bc  # 1 to the left, 0 straight on, -1 to the right
    order = W.partitionBy("grid_id", "site", "a_side").orderBy(left.desc())
    return met.withColumn("n", F.row_number().over(order)).where("n = 1").select("grid_id", "site", F.col("a_side").alias("side"), F.col("b_side").alias("follows"))


def rings(members: DataFrame, n_cols: int) -> DataFrame:
    """(grid_id, site, ring, points, area2): closed rings around masks, in corners of cells (x east, y north).

    Exteriors run counter-clockwise, holes clockwise; corners along a straight side are kept.
    Where cells touch at one corner only, their rings stay apart.
    """
    four = F.when(F.col("r1") > F.col("r0"), 1).when(F.col("r1") < F.col("r0"), 3).when(F.col("c1") > F.col("c0"), 0).otherwise(2)
    sides = boundary(members).withColumn("side", 4 * (F.col("row").cast("long") * n_cols + F.col("col")) + four)
    follow = _next_sides(sides)
    whose = F.struct("grid_id", "site")
    ordered = graph.chains(follow.select(whose.alias("grid_id"), F.col("side").alias("cell"), F.col("follows").alias("receiver")))
    placed = sides.join(shuffled(ordered.select("grid_id.grid_id", "grid_id.site", F.col("cell").alias("side"), F.col("chain").alias("ring"), "step")), ["grid_id", "site", "side"])
    point = F.struct("step", F.struct(F.col("c0").cast("double").alias("x"), F.col("r0").cast("double").alias("y")).alias("p"))
    lines = placed.groupBy("grid_id", "site", "ring").agg(F.transform(F.array_sort(F.collect_list(point)), lambda q: q["p"]).alias("points"))
    closed = lines.select("grid_id", "site", "ring", F.concat("points", F.slice("points", 1, 1)).alias("points"))
    return closed.withColumn("area2", geometry.twice_area(F.col("points")))


def hole_owners(ringed: DataFrame) -> DataFrame:
    """(grid_id, site, ring, owner): the exterior of the same mask around each hole.

    Along a row, what lies just west of a hole's westmost side is mask, up to the next side
    to the west: that side's ring bounds the same connected ground, so it is the hole's
    exterior or another hole of it. A hole looks west from its lowest row; what it meets
    then reaches a lower row or lies further west, so following the rings met ends at an
    exterior. Sides are sorted by row once, and no hole meets all exteriors.
    """
    mask = ["grid_id", "site"]
    sides = ringed.select(*mask, "ring", (F.col("area2") < 0).alias("hole"), F.explode(F.expr("transform(sequence(1, size(points) - 1), i -> struct(points[i - 1] AS p, points[i] AS q))")).alias("s"))
    upright = sides.where("s.p.x = s.q.x").select(*mask, "ring", "hole", F.least("s.p.y", "s.q.y").alias("row"), F.col("s.p.x").alias("x"))
    west = F.lag("ring").over(W.partitionBy(*mask, "row").orderBy("x"))
    seen = upright.withColumn("west", west).where("hole").groupBy(*mask, "ring").agg(F.min_by("west", F.struct("row", "x")).alias("receiver"))
    whose = F.struct(*mask).alias("grid_id")
    met = settled(seen.select(whose, F.col("ring").alias("cell"), "receiver"))
    exteriors = met.join(shuffled(met.select("grid_id", F.col("cell").alias("receiver"))), ["grid_id", "receiver"], "left_anti").select("grid_id", F.col("receiver").alias("cell"), F.lit(None).cast("long").alias("receiver")).distinct()
    led = graph.drain(met.unionByName(exteriors)).join(shuffled(met.select("grid_id", "cell")), ["grid_id", "cell"], "left_semi")
    return led.select("grid_id.grid_id", "grid_id.site", F.col("cell").alias("ring"), F.col("root").alias("owner"))


def within_budget(ringed: DataFrame, tolerance: float, most: int, doublings: int = 12) -> DataFrame:
    """``ringed`` with ``thin`` and ``over``: each ring thinned, with a tolerance that doubles for a mask until its rings have at most ``most`` corners in all.

    Only masks over the budget are thinned again; ``over`` marks those that still are after the last doubling.
    """
    mask = ["grid_id", "site"]
    todo, done = settled(ringed.withColumn("thin", geometry.thin_ring(F.col("points"), F.lit(tolerance)))), None
    for k in range(1, doublings + 2):
        heavy = todo.groupBy(*mask).agg(F.sum(F.size("thin")).alias("_n")).where(F.col("_n") > most).select(*mask)
        if k > doublings or not heavy.limit(1).count():
            break
        light = todo.join(shuffled(heavy), mask, "left_anti")
        done = light if done is None else done.unionByName(light)
        todo = settled(todo.join(shuffled(heavy), mask, "left_semi").withColumn("thin", geometry.thin_ring(F.col("points"), F.lit(tolerance * 2**k))))
    last = todo.join(shuffled(heavy.withColumn("over", F.lit(True))), mask, "left").withColumn("over", F.coalesce("over", F.lit(False)))
    return last if done is None else last.unionByName(done.withColumn("over", F.lit(False)))


def mask_geojson(members: DataFrame, grid: Grid) -> DataFrame:
    """(grid_id, site, geometry, over): each mask as GeoJSON, thinned and in degrees, holes with their exteriors; ``over`` if it keeps more corners than allowed."""
    o = settings.layers
    ringed = settled(rings(members, grid.n_cols))
    thinned = within_budget(ringed, o.thin_cells, o.most_corners)

    def degrees(p):
        lon = grid.frame.lon(grid.x(p["x"] - 0.5))
        lat = grid.frame.lat(grid.y(p["y"] - 0.5))
        return F.array(F.bround(lon, o.decimals), F.bround(lat, o.decimals))

    placed = thinned.select("grid_id", "site", "ring", "area2", "over", F.transform("thin", degrees).alias("path"))
    owners = hole_owners(ringed)
    holes = placed.join(shuffled(owners), ["grid_id", "site", "ring"]).groupBy("grid_id", "site", F.col("owner").alias("ring")).agg(F.array_sort(F.collect_list("path")).alias("holes"))
    outer = placed.where("area2 > 0").join(shuffled(holes), ["grid_id", "site", "ring"], "left")
    polygon = F.concat(F.array("path"), F.coalesce("holes", F.array().cast("array<array<array<double>>>")))
    whole = outer.groupBy("grid_id", "site").agg(F.sort_array(F.collect_list(F.struct((-F.col("area2")).alias("order"), polygon.alias("polygon")))).alias("p"), F.max("over").alias("over"))
    polygons = F.transform("p", lambda x: x["polygon"])
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(polygons, 0).alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates")))
    return whole.select("grid_id", "site", F.when(F.size("p") == 1, single).otherwise(multi).alias("geometry"), "over")
