"""Queries of the terrain operators over whole tables, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import settings
from ..functions import geometry, projection, scalars
from ..operators import contours, focal, graph, hydrology, imagery, rasters, siting, spans
from ..operators.quantiles import quantiles
from ..session import settled, shuffled
from ..sources import kml
from . import ensemble, outputs
from . import lattice as L
from .lattice import AREA_SQL, COLS, D8_SQL, GAPPY_SQL, GRID, LATTICE_SQL, RAIN_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
RING = [(3.5, 2.25), (31.2, 4.75), (36.0, 30.5), (18.5, 12.0), (6.25, 41.5)]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def drainage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid_id, row, col, cell, z, receiver, gradient) of the unfilled lattice."""
    return focal.steepest_descent(L.lattice(spark, sf_dir), COLS, GRID.resolution_m)


# rainfall and runoff


@query(f"""WITH {RAIN_SQL}, days AS (SELECT *, mm - 0.2 * (25400.0 / 75 - 254) AS excess FROM rain)
SELECT place, day, mm, round(CASE WHEN excess > 0 THEN excess * excess / (excess + 25400.0 / 75 - 254) ELSE 0 END, 6) AS runoff_mm FROM days WHERE mm >= 1""")
def daily_runoff(spark, sf_dir):
    daily = hydrology.wet_days(L.rain(spark, sf_dir))
    return rounded(daily.withColumn("runoff_mm", scalars.runoff_mm(F.col("mm"), scalars.retention_mm(F.lit(75.0)))))


@query(f"""WITH {RAIN_SQL}, y AS (SELECT place, count(DISTINCT year(day)) AS years FROM rain GROUP BY place),
d AS (SELECT place, mm, mm - 0.2 * (25400.0 / 75 - 254) AS e FROM rain WHERE mm >= 1),
s AS (SELECT place, sum(mm) AS rain, sum(CASE WHEN e > 0 THEN e * e / (e + 25400.0 / 75 - 254) ELSE 0 END) AS depth, count(*) AS n, count(*) FILTER (e > 0) AS c FROM d GROUP BY place),
a AS (SELECT place, rain / years AS rain, depth / years AS depth, n / years AS n, c / years AS c FROM s JOIN y USING (place)),
o AS (SELECT *, rain - 0.2 * (25400.0 / 75 - 254) AS e FROM a), q AS (SELECT *, CASE WHEN e > 0 THEN e * e / (e + 25400.0 / 75 - 254) ELSE 0 END AS one FROM o)
SELECT place, round(rain, 6) AS rainfall_mm, round(depth, 6) AS runoff_mm, CAST(round_even(n, 0) AS BIGINT) AS rain_days, CAST(round_even(c, 0) AS BIGINT) AS contributing_days,
round(depth / rain, 6) AS coefficient, round(one, 6) AS single_event_mm, round(one / rain, 6) AS single_event_coefficient FROM q""")
def annual_runoff(spark, sf_dir):
    return rounded(hydrology.runoff(L.rain(spark, sf_dir)))


@query(ORACLE_SQL["annual_runoff"].partition("SELECT place, round(rain, 6)")[0] + "SELECT place, round(CASE WHEN depth > 0 THEN one / depth ELSE 'inf'::DOUBLE END, 6) AS factor FROM q")
def overestimates(spark, sf_dir):
    made = hydrology.runoff(L.rain(spark, sf_dir))
    return rounded(made.select("place", scalars.overestimate(F.col("single_event_mm"), F.col("runoff_mm")).alias("factor")))


@query(f"""WITH {RAIN_SQL}, y AS (SELECT place, count(DISTINCT year(day)) AS years FROM rain GROUP BY place)
SELECT place, CAST(month(day) AS INTEGER) AS month, round(sum(mm) / any_value(years), 1) AS mm FROM rain JOIN y USING (place) GROUP BY place, month(day)""")
def monthly_climatology(spark, sf_dir):
    return hydrology.monthly_means(L.rain(spark, sf_dir))


@query(f"WITH {RAIN_SQL} SELECT place, CAST(year(day) AS INTEGER) AS year, round(sum(mm), 1) AS mm FROM rain GROUP BY place, year(day)")
def annual_totals(spark, sf_dir):
    return hydrology.annual_totals(L.rain(spark, sf_dir))


@query(f"""WITH {RAIN_SQL}, y AS (SELECT place, count(DISTINCT year(day)) AS years FROM rain GROUP BY place)
SELECT place, any_value(years) AS years, round(sum(mm) / any_value(years), 6) AS annual_mm, round(count(*) / any_value(years), 6) AS rain_days, max(mm) AS wettest_mm
FROM rain JOIN y USING (place) WHERE mm >= 1 GROUP BY place""")
def rainfall_measures(spark, sf_dir):
    return rounded(hydrology.rainfall_measures(L.rain(spark, sf_dir)))


@query("""SELECT o_orderkey, round(0.01947 * pow(100 + o_totalprice / 100, 0.77) * pow(greatest((o_orderkey % 50) / (100 + o_totalprice / 100), 0.0001), -0.385), 6) AS minutes,
CASE WHEN o_totalprice / 100000 < 0.8 THEN 'oversized' WHEN o_totalprice / 100000 <= 1.2 THEN 'matched' WHEN o_totalprice / 100000 <= 3 THEN 'fills' ELSE 'overflows' END AS verdict FROM orders""")
def concentration_times(spark, sf_dir):
    o = L.table(spark, sf_dir, "orders")
    minutes = scalars.concentration_minutes(100 + F.col("o_totalprice") / 100, (F.col("o_orderkey") % 50).cast("double"))
    return rounded(o.select("o_orderkey", minutes.alias("minutes"), scalars.fill_verdict(F.col("o_totalprice") / 100000).alias("verdict")))


# projections and lattices


@query(f"""WITH {LATTICE_SQL}, p AS (SELECT cell, row, col, 8.3 + col * 10.0 / (111320.0 * cos(radians(46.25))) AS lon, 46.25 + row * 10.0 / 110540.0 AS lat FROM lat)
SELECT cell, round(lon, 9) AS lon, round(lat, 9) AS lat, round((lon + 180) / 360, 9) AS fx, round(0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi()), 9) AS fy,
CAST(floor((lon + 180) / 360 * 8192) AS BIGINT) AS tile_x, CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 8192) AS BIGINT) AS tile_y,
round(2 * pi() * 6378137.0 * cos(radians(lat)) / (256 * 8192), 6) AS tile_m, row AS back_row, col AS back_col FROM p""")
def projected_cells(spark, sf_dir):
    cells = L.lattice(spark, sf_dir).select("cell", GRID.lon(F.col("col")).alias("lon"), GRID.lat(F.col("row")).alias("lat"))
    fx, fy = projection.mercator_x(F.col("lon")), projection.mercator_y(F.col("lat"))
    wide = cells.select(
        "cell", "lon", "lat", fx.alias("fx"), fy.alias("fy"), projection.tile_index(fx, 13).alias("tile_x"), projection.tile_index(fy, 13).alias("tile_y"),
        F.round(projection.tile_resolution(13, F.col("lat")), 6).alias("tile_m"), GRID.row(GRID.frame.y(F.col("lat"))).alias("back_row"), GRID.col(GRID.frame.x(F.col("lon"))).alias("back_col"),
    )
    return rounded(wide, 9)


@query("""WITH b AS (SELECT c_custkey, 80 + c_custkey * 0.001 AS west, 80 + c_custkey * 0.001 + c_acctbal / 1e5 AS east, 20.0 + c_nationkey AS south, 20.5 + c_nationkey AS north FROM customer)
SELECT c_custkey, round(abs(east - west) * 111320.0 * cos(radians((south + north) / 2)), 4) AS span_m FROM b""")
def ground_spans(spark, sf_dir):
    west, south = 80 + F.col("c_custkey") * 0.001, 20.0 + F.col("c_nationkey")
    span = projection.ground_span(west, south, west + F.col("c_acctbal") / 1e5, south + 0.5)
    return rounded(L.table(spark, sf_dir, "customer").select("c_custkey", span.alias("span_m")), 4)


@query("""WITH u AS (SELECT c_custkey, CAST(round_even((c_acctbal + 32768) * 256, 0) AS BIGINT) AS u FROM customer)
SELECT c_custkey, CAST(u // 65536 AS INTEGER) AS r, CAST(u // 256 % 256 AS INTEGER) AS g, CAST(u % 256 AS INTEGER) AS b, u / 256.0::DOUBLE - 32768 AS height FROM u""")
def tile_codec(spark, sf_dir):
    coded = L.table(spark, sf_dir, "customer").select("c_custkey", scalars.terrarium_bytes(F.col("c_acctbal")).alias("p")).select("c_custkey", "p.*")
    return coded.withColumn("height", scalars.terrarium_height(F.col("r"), F.col("g"), F.col("b")).cast("double"))


@query("""WITH box AS (SELECT s_nationkey AS grid_id, min(s_acctbal) AS west, max(s_acctbal) AS east, min(s_suppkey) AS south, max(s_suppkey) AS north FROM supplier GROUP BY 1)
SELECT c_custkey, CASE WHEN c_acctbal BETWEEN west AND east AND c_custkey / 20.0 BETWEEN south AND north THEN NULL ELSE 'pour_point_outside_map' END AS code FROM customer LEFT JOIN box ON grid_id = c_nationkey""")
def pour_points(spark, sf_dir):
    boxes = L.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("grid_id")).agg(F.min("s_acctbal").alias("west"), F.max("s_acctbal").alias("east"), F.min("s_suppkey").alias("south"), F.max("s_suppkey").alias("north"))
    points = L.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("grid_id"), F.col("c_acctbal").alias("lon"), (F.col("c_custkey") / 20).alias("lat"))
    return siting.placed_points(points, boxes).select("c_custkey", "code")


@query(f"WITH {GAPPY_SQL} SELECT grid_id, round(sum({AREA_SQL}), 4) AS mapped_m2 FROM lat WHERE z IS NOT NULL GROUP BY grid_id")
def mask_area(spark, sf_dir):
    return rounded(siting.mapped_area(L.lattice(spark, sf_dir, True), GRID), 4)


@query(f"""WITH {GAPPY_SQL} SELECT grid_id, round(sum(CASE WHEN z IS NULL THEN 0 ELSE {AREA_SQL} END), 4) AS mapped_m2, round(avg(CASE WHEN z IS NULL THEN 1.0 ELSE 0.0 END), 6) AS gap_fraction,
round(min(z), 6) AS low, round(max(z), 6) AS high, round(max(abs(z - round(z, 0))), 6) AS max_shift, round(quantile_cont(abs(z - round(z, 0)), 0.999), 6) AS p999_shift,
count(*) FILTER (abs(z - round(z, 0)) > 1) AS over_interval FROM lat GROUP BY grid_id""")
def surface_summary(spark, sf_dir):
    return rounded(rasters.surface_summary(L.lattice(spark, sf_dir, True).withColumn("raw", F.round("z", 0)), GRID, raw="raw").withColumn("mapped_m2", F.round("mapped_m2", 4)))


# neighbourhoods


@query(f"WITH RECURSIVE {GAPPY_SQL}, {D8_SQL} SELECT cell, receiver, round(g, 6) AS gradient FROM d8")
def d8_receivers(spark, sf_dir):
    made = focal.steepest_descent(L.lattice(spark, sf_dir, True), COLS, GRID.resolution_m)
    return rounded(made.select("cell", "receiver", "gradient"))


_NEAR = ", ".join(f"coalesce(n{k}.z, a.z) AS v{k}" for k in range(9) if k != 4)
_NEAR_JOINS = " ".join(f"LEFT JOIN lat n{k} ON n{k}.row = a.row + {k // 3 - 1} AND n{k}.col = a.col + {k % 3 - 1}" for k in range(9) if k != 4)


@query(f"""WITH {GAPPY_SQL}, w AS (SELECT a.cell, {_NEAR} FROM lat a {_NEAR_JOINS} WHERE a.z IS NOT NULL),
g AS (SELECT cell, ((v2 + 2 * v5 + v8) - (v0 + 2 * v3 + v6)) / 80 AS dx, ((v0 + 2 * v1 + v2) - (v6 + 2 * v7 + v8)) / 80 AS dy FROM w)
SELECT cell, round(sqrt(dx * dx + dy * dy), 6) AS slope FROM g""")
def horn_slope(spark, sf_dir):
    made = focal.horn_slope(L.lattice(spark, sf_dir, True), GRID.resolution_m)
    return rounded(made.where("z is not null").select("cell", "slope"))


@query(f"""WITH {GAPPY_SQL}, m AS (SELECT max(row) AS last FROM lat),
t AS (SELECT a.cell, a.z, coalesce(b.z, 0) AS v, CASE WHEN b.z IS NULL THEN 0.0 ELSE 1.0 END AS w FROM lat a, m, unnest(range(-12, 13)) AS i(dr), unnest(range(-12, 13)) AS j(dc), lat b
  WHERE b.row = least(greatest(a.row + dr, 0), last) AND b.col = least(greatest(a.col + dc, 0), 39) AND a.z IS NOT NULL)
SELECT cell, round(any_value(z) - sum(v) / sum(w), 6) AS relative FROM t GROUP BY cell""")
def relative_elevation(spark, sf_dir):
    made = focal.relative_elevation(L.lattice(spark, sf_dir, True), GRID.resolution_m, GRID.spacing_m)
    return rounded(made.where("z is not null").select("cell", "relative"))


_G = focal.gaussian_weights(1.5)
_TAPS = ", ".join(f"({k - len(_G) // 2}, {w!r}::DOUBLE)" for k, w in enumerate(_G))


@query(f"""WITH {GAPPY_SQL}, m AS (SELECT max(row) AS last FROM lat), taps(d, w) AS (VALUES {_TAPS}),
t AS (SELECT a.cell, i.w * j.w * coalesce(b.z, 0) AS v, CASE WHEN b.z IS NULL THEN 0.0 ELSE i.w * j.w END AS w FROM lat a, m, taps i, taps j, lat b
  WHERE b.row = least(greatest(a.row + i.d, 0), last) AND b.col = least(greatest(a.col + j.d, 0), 39) AND a.z IS NOT NULL)
SELECT cell, round(sum(v) / sum(w), 6) AS smoothed FROM t GROUP BY cell""")
def gaussian_smooth(spark, sf_dir):
    made = focal.smooth(L.lattice(spark, sf_dir, True), 1.5)
    return rounded(made.where("z is not null").select("cell", "smoothed"))


@query(f"""WITH {LATTICE_SQL}, m AS (SELECT max(row) AS last FROM lat),
t AS (SELECT a.cell, b.z FROM lat a, m, unnest(range(-2, 3)) AS i(dr), unnest(range(-2, 3)) AS j(dc), lat b
  WHERE b.row = CASE WHEN a.row + dr < 0 THEN -1 - a.row - dr WHEN a.row + dr > last THEN 2 * last + 1 - a.row - dr ELSE a.row + dr END
    AND b.col = CASE WHEN a.col + dc < 0 THEN -1 - a.col - dc WHEN a.col + dc > 39 THEN 79 - a.col - dc ELSE a.col + dc END)
SELECT cell, round(stddev_pop(z), 4) AS texture FROM t GROUP BY cell""")
def local_texture(spark, sf_dir):
    return rounded(focal.local_std(L.lattice(spark, sf_dir), "z", 5).select("cell", "texture"), 4)


@query(f"""WITH {LATTICE_SQL}, g AS (SELECT a.cell,
  (coalesce(e.z, a.z) - coalesce(w.z, a.z)) / (CASE WHEN e.z IS NULL OR w.z IS NULL THEN 10.0 ELSE 20.0 END) AS dx,
  (coalesce(n.z, a.z) - coalesce(s.z, a.z)) / (CASE WHEN n.z IS NULL OR s.z IS NULL THEN 10.0 ELSE 20.0 END) AS dy
  FROM lat a LEFT JOIN lat e ON e.row = a.row AND e.col = a.col + 1 LEFT JOIN lat w ON w.row = a.row AND w.col = a.col - 1
  LEFT JOIN lat n ON n.row = a.row + 1 AND n.col = a.col LEFT JOIN lat s ON s.row = a.row - 1 AND s.col = a.col),
h AS (SELECT cell, atan(sqrt(dx * dx + dy * dy)) AS steep, atan2(-dx, dy) AS aspect FROM g)
SELECT cell, round(least(greatest(sin(radians(45)) * cos(steep) + cos(radians(45)) * sin(steep) * cos(radians(315) - aspect), 0), 1), 6) AS shade FROM h""")
def hillshade(spark, sf_dir):
    return rounded(focal.hillshade(L.lattice(spark, sf_dir), GRID.resolution_m).select("cell", "shade"))


@query(f"""WITH {GAPPY_SQL}, m AS (SELECT max(row) AS last FROM lat),
gaps AS (SELECT row, col FROM lat WHERE z IS NULL UNION ALL SELECT CAST(r AS INTEGER), c FROM m, unnest(range(-1, last + 2)) AS x(r), (VALUES (-1), (40)) AS y(c)
  UNION ALL SELECT r, CAST(c AS INTEGER) FROM m, (SELECT -1 AS r UNION ALL SELECT last + 1 FROM m), unnest(range(0, 40)) AS y(c))
SELECT a.cell, round(least(50.0, min(10 * sqrt(pow(a.row - g.row, 2) + pow(a.col - g.col, 2)))), 6) AS edge_m FROM lat a, gaps g WHERE a.z IS NOT NULL GROUP BY a.cell""")
def distance_to_edge(spark, sf_dir):
    made = focal.distance_to_edge(L.lattice(spark, sf_dir, True), GRID.resolution_m, 50.0)
    return rounded(made.where("z is not null").select("cell", "edge_m"))


# drainage


@query(f"WITH RECURSIVE {LATTICE_SQL}, {D8_SQL} SELECT cell, CAST(n AS DOUBLE) AS accumulation FROM acc")
def flow_accumulation(spark, sf_dir):
    return graph.accumulate(drainage(spark, sf_dir)).select("cell", "accumulation")


@query(f"WITH RECURSIVE {LATTICE_SQL}, {D8_SQL} SELECT w.loc AS cell, round(sum(lat.z), 4) AS accumulation FROM walk w JOIN lat ON lat.cell = w.cell GROUP BY w.loc")
def weighted_accumulation(spark, sf_dir):
    return rounded(graph.accumulate(drainage(spark, sf_dir), "z").select("cell", "accumulation"), 4)


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {D8_SQL}
SELECT w.cell, w.loc AS root, CAST(straight AS BIGINT) AS straight, CAST(diagonal AS BIGINT) AS diagonal FROM walk w JOIN d8 ON d8.cell = w.loc WHERE d8.receiver IS NULL""")
def terminal_outlets(spark, sf_dir):
    return graph.drain(drainage(spark, sf_dir), n_cols=COLS).select("cell", "root", "straight", "diagonal")


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {D8_SQL} SELECT w.loc AS root, count(*) AS cells, round(sum({AREA_SQL}), 4) AS area_m2
FROM walk w JOIN d8 ON d8.cell = w.loc JOIN lat ON lat.cell = w.cell WHERE receiver IS NULL GROUP BY w.loc""".replace(AREA_SQL, AREA_SQL.replace("row", "lat.row")))
def basin_mass_balance(spark, sf_dir):
    flow = drainage(spark, sf_dir)
    joined = graph.drain(flow).join(flow.select("grid_id", "cell", "row"), ["grid_id", "cell"])
    return rounded(joined.groupBy("root").agg(F.count("*").alias("cells"), F.sum(GRID.cell_area(F.col("row"))).alias("area_m2")), 4)


_OUTLETS = "outlets AS (SELECT cell FROM acc WHERE n >= 12)"
#: Each outlet alone: all cells whose walk passes it, whatever other outlets lie between.
_CATCH = f"{_OUTLETS}, firsts AS (SELECT w.cell, w.loc, straight, diagonal FROM walk w JOIN outlets o ON o.cell = w.loc)"
#: The first outlet on each cell's walk.
_FIRST = f"{_OUTLETS}, firsts AS (SELECT w.cell, w.loc FROM walk w JOIN outlets o ON o.cell = w.loc QUALIFY row_number() OVER (PARTITION BY w.cell ORDER BY straight + diagonal) = 1)"


def _outlets(spark, sf_dir):
    flow = drainage(spark, sf_dir)
    return flow, graph.accumulate(flow).where("accumulation >= 12")


@query(f"WITH RECURSIVE {LATTICE_SQL}, {D8_SQL}, {_CATCH} SELECT cell, loc AS outlet, CAST(straight AS BIGINT) AS straight, CAST(diagonal AS BIGINT) AS diagonal FROM firsts")
def catchment_members(spark, sf_dir):
    flow, outlets = _outlets(spark, sf_dir)
    return graph.upstream(flow, outlets, COLS).select("cell", "outlet", "straight", "diagonal")


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {D8_SQL}, {_CATCH}, l AS (SELECT loc, cell, (straight + diagonal * sqrt(2.0)) * 10 AS m FROM firsts)
SELECT loc AS outlet, round(m, 6) AS length_m, cell AS remote_cell FROM l QUALIFY row_number() OVER (PARTITION BY loc ORDER BY round(m, 9) DESC, cell) = 1""")
def longest_flow_path(spark, sf_dir):
    flow, outlets = _outlets(spark, sf_dir)
    return rounded(graph.longest_path(graph.upstream(flow, outlets, COLS), GRID.resolution_m).select("outlet", "length_m", "remote_cell"))


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {D8_SQL}, {_CATCH}, sizes AS (SELECT loc, count(*) AS members FROM firsts GROUP BY loc)
SELECT loc AS outlet, members, CAST(n AS DOUBLE) AS accumulation FROM sizes JOIN acc ON acc.cell = loc""")
def nested_catchments(spark, sf_dir):
    """Outlets that lie above one another: each has as many members as water passes it."""
    flow, outlets = _outlets(spark, sf_dir)
    sizes = graph.upstream(flow, outlets).groupBy("grid_id", "outlet").agg(F.count("*").alias("members"))
    return sizes.join(shuffled(outlets.withColumnRenamed("cell", "outlet")), ["grid_id", "outlet"]).select("outlet", "members", "accumulation")


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {D8_SQL}, {_CATCH},
far AS (SELECT loc, cell, straight + diagonal AS steps FROM firsts QUALIFY row_number() OVER (PARTITION BY loc ORDER BY round((straight + diagonal * sqrt(2.0)) * 10, 9) DESC, cell) = 1)
SELECT far.loc AS outlet, CAST(w.straight + w.diagonal AS BIGINT) AS step, w.loc AS cell FROM far JOIN walk w ON w.cell = far.cell WHERE w.straight + w.diagonal <= far.steps""")
def flow_paths(spark, sf_dir):
    flow, outlets = _outlets(spark, sf_dir)
    toured = graph.tour(flow, COLS)
    starts = graph.longest_path(graph.members_of(toured, outlets), GRID.resolution_m).select("grid_id", "outlet", F.col("remote_cell").alias("cell"))
    return graph.flow_paths(toured, starts).select("outlet", "step", "cell")


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {D8_SQL}, {_FIRST} SELECT lat.cell, round(lat.z - o.z, 6) AS above, f.loc IS NULL AS leaves_map
FROM lat LEFT JOIN firsts f USING (cell) LEFT JOIN lat o ON o.cell = f.loc""")
def height_above_trunk(spark, sf_dir):
    flow, outlets = _outlets(spark, sf_dir)
    made = graph.height_above(flow, outlets)
    finite = F.abs("above") < float("inf")
    return made.select("cell", F.when(finite, F.round("above", 6)).alias("above"), (~finite).alias("leaves_map"))


_SIDES_SQL = "sides(sr, sc) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1))"


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {D8_SQL}, {_CATCH}, {_SIDES_SQL},
facing AS (SELECT f.loc, lat.row + sr AS row, lat.col + sc AS col FROM firsts f JOIN lat USING (cell), sides),
outward AS (SELECT x.loc, x.row, x.col FROM facing x WHERE NOT EXISTS (SELECT 1 FROM firsts f JOIN lat USING (cell) WHERE f.loc = x.loc AND lat.row = x.row AND lat.col = x.col)),
contact AS (SELECT loc, avg(CASE WHEN lat.cell IS NULL THEN 1.0 ELSE 0.0 END) AS c FROM outward o LEFT JOIN lat ON lat.row = o.row AND lat.col = o.col GROUP BY loc),
far AS (SELECT loc, cell, (straight + diagonal * sqrt(2.0)) * 10 AS m FROM firsts QUALIFY row_number() OVER (PARTITION BY loc ORDER BY round((straight + diagonal * sqrt(2.0)) * 10, 9) DESC, cell) = 1),
sums AS (SELECT f.loc, count(*) AS cells, sum({AREA_SQL}) AS area, max(z) AS top FROM firsts f JOIN lat USING (cell) GROUP BY f.loc)
SELECT s.loc AS outlet, cells, round(area, 4) AS area_m2, round(top - o.z, 6) AS relief_m, round(m, 6) AS length_m, far.cell AS remote_cell, round(r.z - o.z, 6) AS path_relief_m,
round(c, 6) AS edge_contact, c > 0.15 AS lower_bound FROM sums s JOIN contact USING (loc) JOIN far USING (loc) JOIN lat o ON o.cell = s.loc JOIN lat r ON r.cell = far.cell""")
def catchment_summary(spark, sf_dir):
    flow, outlets = _outlets(spark, sf_dir)
    made = siting.catchment_summary(graph.upstream(flow, outlets, COLS), L.lattice(spark, sf_dir), GRID)
    return rounded(made.withColumn("area_m2", F.round("area_m2", 4)).drop("grid_id"))


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {D8_SQL}, area AS (SELECT sum({AREA_SQL}) AS a FROM lat)
SELECT cell, CAST(n AS DOUBLE) AS accumulation, round(n * {AREA_SQL}, 4) AS upstream_m2 FROM acc JOIN lat USING (cell), area WHERE n * {AREA_SQL} >= a * 0.005""")
def stream_cells(spark, sf_dir):
    flow = drainage(spark, sf_dir)
    cells = flow.select("grid_id", "row", "col", "cell").join(graph.accumulate(flow), ["grid_id", "cell"])
    made = siting.stream_cells(cells, siting.mapped_area(L.lattice(spark, sf_dir), GRID), GRID)
    return made.select("cell", "accumulation", F.round(siting.upstream_area(GRID), 4).alias("upstream_m2"))


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {D8_SQL}, {_OUTLETS}, free AS (SELECT o.cell FROM outlets o WHERE NOT EXISTS (SELECT 1 FROM walk w JOIN outlets p ON p.cell = w.loc WHERE w.cell = o.cell AND w.loc <> o.cell))
SELECT cell, CAST(n AS DOUBLE) AS accumulation, CAST(row_number() OVER (ORDER BY n DESC, cell) AS INTEGER) AS rank FROM free JOIN acc USING (cell) ORDER BY rank LIMIT 10""")
def site_selection(spark, sf_dir):
    flow, outlets = _outlets(spark, sf_dir)
    return siting.choose_sites(flow, outlets, 10).select("cell", "accumulation", "rank")


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {D8_SQL}, p AS (SELECT c_custkey AS point_id, CAST(c_custkey % (SELECT max(row) + 1 FROM lat) AS INTEGER) AS row, CAST(c_custkey * 7 % 40 AS INTEGER) AS col FROM customer),
near AS (SELECT point_id, p.row AS p_row, p.col AS p_col, lat.row, lat.col, n FROM p JOIN lat ON abs(lat.row - p.row) <= 12 AND abs(lat.col - p.col) <= 12 JOIN acc USING (cell)
  QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY n DESC, lat.row, lat.col) = 1)
SELECT point_id, row, col, CAST(n AS DOUBLE) AS accumulation, round(sqrt(pow(row - p_row, 2) + pow(col - p_col, 2)) * 10, 6) AS moved_m FROM near""")
def snap_outlets(spark, sf_dir):
    flow = drainage(spark, sf_dir)
    cells = flow.select("grid_id", "row", "col", "cell").join(shuffled(graph.accumulate(flow)), ["grid_id", "cell"])
    last = F.expr("max(row) + 1")
    rows = L.lattice(spark, sf_dir).agg(last.alias("rows"))
    points = L.table(spark, sf_dir, "customer").crossJoin(F.broadcast(rows)).select(F.lit(0).alias("grid_id"), F.col("c_custkey").alias("point_id"), F.expr("cast(c_custkey % rows as int)").alias("row"), F.expr("cast(c_custkey * 7 % 40 as int)").alias("col"))
    return rounded(siting.snap(cells, points, GRID).select("point_id", "row", "col", "accumulation", "moved_m"))


_SPACINGS = (10.0, 12.5, 14.0)
_ENSEMBLE = f"""{LATTICE_SQL}, gr AS (
  SELECT g, res, CAST(floor((SELECT max(row) FROM lat) * 10.0 / res + 1e-9) AS INTEGER) + 1 AS n_rows, CAST(floor(39 * 10.0 / res + 1e-9) AS INTEGER) + 1 AS n_cols
  FROM (VALUES {", ".join(f"({g}, {r}::DOUBLE)" for g, r in enumerate(_SPACINGS))}) AS s(g, res)
),
pos AS (SELECT g, res, n_cols, row, unnest(range(n_cols)) AS col FROM (SELECT *, unnest(range(n_rows)) AS row FROM gr)),
k AS (SELECT g, res, n_cols, row, col, floor(pr) + a AS kr, floor(pc) + b AS kc, (CASE WHEN a = 1 THEN pr - floor(pr) ELSE 1 - (pr - floor(pr)) END) * (CASE WHEN b = 1 THEN pc - floor(pc) ELSE 1 - (pc - floor(pc)) END) AS w
  FROM (SELECT *, row * res / 10.0::DOUBLE AS pr, col * res / 10.0::DOUBLE AS pc FROM pos), (VALUES (0), (1)) AS x(a), (VALUES (0), (1)) AS y(b)),
surf AS (SELECT g, any_value(res) AS res, any_value(n_cols) AS n_cols, k.row, k.col, round(sum(w * z), 6) AS z FROM k JOIN lat ON lat.row = kr AND lat.col = kc WHERE w > 0 GROUP BY g, k.row, k.col),
offs(dr, dc, rank) AS (VALUES (-1, -1, 0), (-1, 0, 1), (-1, 1, 2), (0, -1, 3), (0, 1, 4), (1, -1, 5), (1, 0, 6), (1, 1, 7)),
drops AS (
  SELECT a.g, a.row, a.col, b.row AS nr, b.col AS nc, rank, (a.z - b.z) / (a.res * CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0) ELSE 1.0 END) AS s
  FROM surf a, offs, surf b WHERE b.g = a.g AND b.row = a.row + dr AND b.col = a.col + dc
),
best AS (SELECT g, row, col, nr, nc FROM drops WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY g, row, col ORDER BY s DESC, rank) = 1),
walk(g, row, col, at_row, at_col) AS (
  SELECT g, row, col, row, col FROM surf UNION ALL SELECT w.g, w.row, w.col, nr, nc FROM walk w JOIN best b ON b.g = w.g AND b.row = w.at_row AND b.col = w.at_col
),
acc AS (
  SELECT w.g, at_row AS row, at_col AS col, count(*) AS n, sum(res * res * cos(radians(46.25 + w.row * res / 110540.0)) / cos(radians(46.25))) AS area FROM walk w JOIN gr USING (g) GROUP BY w.g, at_row, at_col
),
p AS (SELECT c_custkey AS point_id, CAST(c_custkey % (SELECT max(row) + 1 FROM lat) AS INTEGER) * 10.0 AS y, CAST(c_custkey * 7 % 40 AS INTEGER) * 10.0 AS x FROM customer),
q AS (SELECT g, res, point_id, round_even(y / res, 0) AS row, round_even(x / res, 0) AS col, greatest(1, round_even(120 / res, 0)) AS reach FROM p, gr),
snapped AS (
  SELECT q.point_id, q.g, acc.area, acc.n, sqrt(pow(acc.row - q.row, 2) + pow(acc.col - q.col, 2)) * res AS moved FROM q JOIN acc ON acc.g = q.g AND abs(acc.row - q.row) <= reach AND abs(acc.col - q.col) <= reach
  QUALIFY row_number() OVER (PARTITION BY q.point_id, q.g ORDER BY n DESC, acc.row, acc.col) = 1
)"""


def _ensemble(spark, sf_dir):
    surface = L.lattice(spark, sf_dir)
    n_rows = surface.agg(F.max("row")).first()[0] + 1
    routed = ensemble.route(surface, GRID, ensemble.spacings(GRID, n_rows, _SPACINGS), fill=False, decimals=6)
    at = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.expr(f"cast(c_custkey % {n_rows} as int)").alias("row"), F.expr("cast(c_custkey * 7 % 40 as int)").alias("col"))
    return routed, ensemble.delineate(routed, at.select("point_id", GRID.lon(F.col("col")).alias("lon"), GRID.lat(F.col("row")).alias("lat")))


@query(f"WITH RECURSIVE {_ENSEMBLE} SELECT point_id, g AS grid_id, CAST(n AS DOUBLE) AS accumulation, round(area, 4) AS area_m2, round(moved, 6) AS moved_m FROM snapped")
def grids_of_points(spark, sf_dir):
    """Every point on every grid: where it snaps to, and what drains through there."""
    _, found = _ensemble(spark, sf_dir)
    return rounded(found.withColumn("area_m2", F.round("area_m2", 4)).drop("outlet"))


@query(f"""WITH RECURSIVE {_ENSEMBLE}, m AS (SELECT point_id, count(*) AS n_grids, arg_min(area, g) AS area, avg(area) AS mean, stddev_pop(area) AS std FROM snapped GROUP BY point_id)
SELECT point_id, n_grids, round(area, 3) AS area_m2, round(mean, 3) AS mean_m2, round(std, 3) AS std_m2, round(std / mean, 6) AS cv, CASE WHEN std / mean <= 0.1 THEN 'high' WHEN std / mean <= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM m""")
def resolution_ensemble(spark, sf_dir):
    _, found = _ensemble(spark, sf_dir)
    made = ensemble.summarise(found)
    return made.select("point_id", "n_grids", *(F.round(c, 3).alias(c) for c in ("area_m2", "mean_m2", "std_m2")), F.round("cv", 6).alias("cv"), "confidence")


#: The least levels at which water leaves each cell: levels only fall, from the cells that changed last to those around them.
_FILL_SQL = f"""around(dr, dc) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)),
ground AS (SELECT cell, row, col, z FROM lat WHERE z IS NOT NULL),
near AS (SELECT a.cell, b.cell AS other FROM ground a, around, ground b WHERE b.row = a.row + dr AND b.col = a.col + dc),
open_to AS (SELECT cell, count(other) < 8 AS seed FROM ground LEFT JOIN near USING (cell) GROUP BY cell),
flood(cell, level) USING KEY (cell) AS (
  SELECT cell, CASE WHEN seed THEN z ELSE 'inf'::DOUBLE END FROM ground JOIN open_to USING (cell)
  UNION
  SELECT n.cell, n.level FROM (SELECT near.cell, greatest(any_value(g.z), min(f.level) + {settings.flow.fill_step_m}::DOUBLE) AS level FROM flood f JOIN near ON near.other = f.cell JOIN ground g ON g.cell = near.cell GROUP BY near.cell) n
    JOIN recurring.flood w ON w.cell = n.cell WHERE n.level < w.level
),
filled AS (SELECT cell, row, col, z, level AS filled FROM ground JOIN flood USING (cell))"""


@query(f"WITH RECURSIVE {GAPPY_SQL}, {_FILL_SQL} SELECT row, col, round(z, 6) AS z, round(filled, 6) AS filled FROM filled")
def fill_depressions(spark, sf_dir):
    return rounded(graph.fill_depressions(L.lattice(spark, sf_dir, True)).select("row", "col", "z", "filled"))


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {D8_SQL}, stream AS (SELECT cell FROM acc WHERE n >= 4),
links AS (SELECT s.cell, t.cell AS next FROM stream s JOIN d8 USING (cell) LEFT JOIN stream t ON t.cell = d8.receiver),
heads AS (SELECT l.cell, l.next, (SELECT count(*) FROM links m WHERE m.next = l.cell) <> 1 AS is_head FROM links l),
way(head, step, cell, going) AS (
  SELECT cell, 0::BIGINT, cell, true FROM heads WHERE is_head
  UNION ALL
  SELECT w.head, w.step + 1, h.next, NOT t.is_head FROM way w JOIN heads h ON h.cell = w.cell JOIN heads t ON t.cell = h.next WHERE w.going
)
SELECT head, step, cell FROM way WHERE head IN (SELECT head FROM way WHERE step = 1)""")
def stream_reaches(spark, sf_dir):
    flow = drainage(spark, sf_dir)
    stream = graph.accumulate(flow).where("accumulation >= 4")
    return graph.reaches(flow, stream).select("head", "step", "cell")


#: What the ground above each outlet holds: its catchment is flooded from the outlet alone, and every stage read off.
_STORAGE_SQL = f"""{D8_SQL}, {_CATCH}, {_FILL_SQL},
pool(outlet, cell, level) USING KEY (outlet, cell) AS (
  SELECT f.loc, f.cell, CASE WHEN f.cell = f.loc THEN g.z ELSE 'inf'::DOUBLE END FROM firsts f JOIN ground g ON g.cell = f.cell
  UNION
  SELECT n.outlet, n.cell, n.level FROM (SELECT p.outlet, near.cell, greatest(any_value(g.z), min(p.level)) AS level FROM pool p JOIN near ON near.other = p.cell JOIN ground g ON g.cell = near.cell GROUP BY p.outlet, near.cell) n
    JOIN recurring.pool w ON w.outlet = n.outlet AND w.cell = n.cell WHERE n.level < w.level
),
wet AS (SELECT p.outlet, p.cell, p.level, g.z, o.filled AS datum, {AREA_SQL.replace("row", "g.row")} AS area FROM pool p JOIN ground g ON g.cell = p.cell JOIN filled o ON o.cell = p.outlet),
curve AS (
  SELECT outlet, step, stage_m, sum(CASE WHEN level <= datum + stage_m THEN area ELSE 0 END) AS area_m2, sum(CASE WHEN level <= datum + stage_m THEN area * greatest(datum + stage_m - z, 0) ELSE 0 END) AS volume_m3
  FROM wet, (VALUES {", ".join(f"({k}, {s}::DOUBLE)" for k, s in enumerate(hydrology.stages()))}) AS st(step, stage_m) GROUP BY outlet, step, stage_m
)"""


@query(f"WITH RECURSIVE {LATTICE_SQL}, {_STORAGE_SQL} SELECT outlet, step, round(stage_m, 4) AS stage_m, round(area_m2, 4) AS area_m2, round(volume_m3, 4) AS volume_m3 FROM curve")
def stage_storage(spark, sf_dir):
    flow, outlets = _outlets(spark, sf_dir)
    members = graph.upstream(flow, outlets)
    filled = graph.fill_depressions(L.lattice(spark, sf_dir))
    return rounded(hydrology.stage_storage(members, filled, GRID).drop("grid_id"), 4)


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {_STORAGE_SQL},
jumps AS (SELECT outlet, min(step) - 1 AS spill_step FROM (SELECT *, lag(area_m2) OVER (PARTITION BY outlet ORDER BY step) AS before FROM curve) WHERE area_m2 > {settings.water.spill_jump} * before AND before >= 100 GROUP BY outlet),
ends AS (SELECT outlet, arg_max(area_m2, step) AS s, arg_max(volume_m3, step) AS c, arg_min(area_m2, step) AS n, arg_min(volume_m3, step) AS v, max(stage_m) AS d, max(step) AS last FROM curve GROUP BY outlet)
SELECT outlet, spill_step, round(stage_m, 4) AS usable_depth_m, round(area_m2, 4) AS usable_m2, round(volume_m3, 4) AS usable_m3, round(s, 4) AS surface_m2, round(c, 4) AS capacity_m3, round(n, 4) AS natural_m2, round(v, 4) AS natural_m3,
  round(d, 4) AS depth_m, round(d / 3 * (s + n + sqrt(s * n)), 4) AS frustum_m3 FROM ends LEFT JOIN jumps USING (outlet) JOIN curve USING (outlet) WHERE step = coalesce(spill_step, last)""")
def usable_storage(spark, sf_dir):
    flow, outlets = _outlets(spark, sf_dir)
    curve = hydrology.stage_storage(graph.upstream(flow, outlets), graph.fill_depressions(L.lattice(spark, sf_dir)), GRID)
    return rounded(hydrology.spill(curve, 10.0).drop("grid_id"), 4)


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {_FILL_SQL}, low AS (SELECT * FROM filled WHERE filled > z),
joined(cell, other) AS (SELECT cell, cell FROM low UNION SELECT j.cell, near.other FROM joined j JOIN near ON near.cell = j.other JOIN low ON low.cell = near.other),
patch AS (SELECT cell, min(other) AS hollow FROM joined GROUP BY cell),
sizes AS (SELECT hollow, sum({AREA_SQL}) AS m2, sum({AREA_SQL} * (filled - z)) AS m3 FROM patch JOIN low USING (cell) GROUP BY hollow)
SELECT cell, hollow, round(m2, 4) AS hollow_m2, round(m3, 4) AS hollow_m3 FROM patch JOIN sizes USING (hollow)""")
def hollows(spark, sf_dir):
    return rounded(hydrology.hollows(graph.fill_depressions(L.lattice(spark, sf_dir)), GRID).drop("grid_id"), 4)


# rasters and polygons


@query(f"""WITH {GAPPY_SQL}, m AS (SELECT max(row) AS last FROM lat),
p AS (SELECT l_orderkey * 10 + l_linenumber AS point_id, l_quantity * 0.83 - 0.4 AS r, l_discount * 380 + 0.37 AS c, last FROM lineitem, m),
q AS (SELECT DISTINCT point_id, r < -0.5 OR r > last + 0.5 OR c < -0.5 OR c > 39.5 AS outside, least(greatest(r, 0), last) AS r, least(greatest(c, 0), 39) AS c FROM p),
k AS (SELECT point_id, outside, floor(r) + a AS row, floor(c) + b AS col, (CASE WHEN a = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) * (CASE WHEN b = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) AS w
  FROM q, (VALUES (0), (1)) AS x(a), (VALUES (0), (1)) AS y(b))
SELECT point_id, round(CASE WHEN NOT bool_or(outside) AND sum(CASE WHEN z IS NULL THEN w ELSE 0 END) <= 1e-6 THEN sum(w * coalesce(z, 0)) END, 6) AS height
FROM k LEFT JOIN lat ON lat.row = k.row AND lat.col = k.col WHERE w > 0 OR outside GROUP BY point_id""")
def bilinear_sample(spark, sf_dir):
    points = L.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), (F.col("l_quantity") * 0.83 - 0.4).alias("prow"), (F.col("l_discount") * 380 + 0.37).alias("pcol")).distinct()
    pixels = L.lattice(spark, sf_dir, True).select(F.col("row").alias("prow"), F.col("col").alias("pcol"), "z")
    return rounded(rasters.bilinear(points, pixels))


_CORNERS = [*RING, RING[0]]
_EDGES = ", ".join(f"({ax}, {ay}, {bx}, {by})" for (ax, ay), (bx, by) in zip(_CORNERS[:-1], _CORNERS[1:], strict=True))
_INSIDE = f"""(SELECT count(*) FROM (VALUES {_EDGES}) AS e(x0, y0, x1, y1) WHERE (y0 > y) <> (y1 > y) AND x0 + (y - y0) / (y1 - y0) * (x1 - x0) > x) % 2 = 1"""


@query(f"WITH {LATTICE_SQL} SELECT cell, {_INSIDE} AS inside FROM (SELECT cell, col + 0.25 AS x, row + 0.125 AS y FROM lat)")
def point_in_polygon(spark, sf_dir):
    cells = L.lattice(spark, sf_dir)
    return cells.select("cell", geometry.inside(F.col("col") + 0.25, F.col("row") + 0.125, geometry.ring(RING)).alias("inside"))


@query(f"WITH {LATTICE_SQL} SELECT cell FROM (SELECT cell, CAST(col AS DOUBLE) AS x, CAST(row AS DOUBLE) AS y FROM lat) WHERE {_INSIDE}")
def polygon_mask(spark, sf_dir):
    return rasters.polygon_mask(L.lattice(spark, sf_dir), RING).select("cell")


@query(f"""WITH {LATTICE_SQL}, land AS (SELECT CAST(vec_id // 20 AS INTEGER) AS row, CAST(vec_id % 20 AS INTEGER) AS col, CASE WHEN label % 5 = 4 THEN NULL ELSE label % 4 END AS class FROM embeddings),
s AS (SELECT cell, CAST(round_even((lat.row * 10.0 + dy) / 7.0, 0) AS INTEGER) AS lr, CAST(round_even((lat.col * 10.0 + dx) / 7.0, 0) AS INTEGER) AS lc FROM lat, (VALUES (-10.0/3), (0.0), (10.0/3)) AS a(dy), (VALUES (-10.0/3), (0.0), (10.0/3)) AS b(dx))
SELECT cell, coalesce(avg(CASE WHEN class IN (1, 2, 3) THEN 1.0 WHEN class IS NOT NULL THEN 0.0 END), 0) > 0.5 AS excluded FROM s LEFT JOIN land ON land.row = lr AND land.col = lc GROUP BY cell""")
def class_majority(spark, sf_dir):
    land = L.table(spark, sf_dir, "embeddings").select(F.expr("cast(vec_id div 20 as int)").alias("row"), F.expr("cast(vec_id % 20 as int)").alias("col"), F.expr("case when label % 5 <> 4 then label % 4 end").alias("class"))
    land_grid = projection.Grid(GRID.frame, 7.0, 20)
    made = rasters.class_majority(L.lattice(spark, sf_dir), land, GRID, land_grid, (1, 2, 3))
    return made.select(GRID.cell(F.col("row"), F.col("col")).alias("cell"), "excluded")


@query(f"""WITH {LATTICE_SQL}, a AS (SELECT CAST(z AS INTEGER) % 7 AS site, row, col FROM lat), b AS (SELECT CAST(z AS INTEGER) % 5 AS site, row, col FROM lat),
n AS (SELECT a.site AS site_a, b.site AS site_b, count(*) AS shared FROM a JOIN b USING (row, col) GROUP BY ALL)
SELECT CAST(site_a AS INTEGER) AS site_a, CAST(site_b AS INTEGER) AS site_b, shared, round(shared / ((SELECT count(*) FROM a WHERE site = site_a) + (SELECT count(*) FROM b WHERE site = site_b) - shared), 6) AS iou FROM n""")
def catchment_overlap(spark, sf_dir):
    cells = L.lattice(spark, sf_dir)
    a = cells.select("grid_id", F.expr("cast(rint(z) as int) % 7").alias("site"), "row", "col")
    b = cells.select("grid_id", F.expr("cast(rint(z) as int) % 5").alias("site"), "row", "col")
    return rounded(rasters.overlap(a, b).drop("grid_id"))


_MASKS = f"""{LATTICE_SQL}, two AS (SELECT CAST(cell % 3 = 0 AS INTEGER) AS grid_id, CAST(p_size % 4 AS INTEGER) AS site, CAST(p_partkey // 120 AS INTEGER) AS row, CAST(p_partkey // 3 % 40 AS INTEGER) AS col, p_size, p_retailprice AS price
  FROM part JOIN lat ON cell = p_partkey),
a AS (SELECT DISTINCT grid_id, site, row, col FROM two WHERE p_size < 40), b AS (SELECT DISTINCT grid_id, site, row, col FROM two WHERE CAST(round(price, 2) * 100 AS BIGINT) % 5 < 3)"""


def _masks(spark, sf_dir):
    """Masks on two grids that lie over one another, four sites in each."""
    part = L.table(spark, sf_dir, "part")
    cells = part.select(
        F.expr("cast(p_partkey % 3 = 0 as int)").alias("grid_id"), F.expr("cast(p_size % 4 as int)").alias("site"), F.expr("cast(p_partkey div 120 as int)").alias("row"), F.expr("cast(p_partkey div 3 % 40 as int)").alias("col"), "p_size", F.round("p_retailprice", 2).alias("price")
    )
    return spans.from_cells(cells.where("p_size < 40")), spans.from_cells(cells.where("cast(rint(price * 100) as bigint) % 5 < 3"))


def _runs(cells: str) -> str:
    """SQL of the spans of a table of cells."""
    return f"(SELECT grid_id, site, row, min(col) AS first, max(col) AS last FROM (SELECT *, col - row_number() OVER (PARTITION BY grid_id, site, row ORDER BY col) AS run FROM {cells}) GROUP BY grid_id, site, row, run)"


@query(f"""WITH {_MASKS}, u AS (SELECT * FROM a UNION SELECT * FROM b), i AS (SELECT * FROM a INTERSECT SELECT * FROM b), d AS (SELECT * FROM a EXCEPT SELECT * FROM b)
SELECT 'union' AS op, * FROM {_runs("u")} UNION ALL SELECT 'intersection', * FROM {_runs("i")} UNION ALL SELECT 'difference', * FROM {_runs("d")}""")
def mask_sets(spark, sf_dir):
    """Union, intersection and difference of masks as row spans; grids that lie over one another stay apart."""
    a, b = (settled(mask) for mask in _masks(spark, sf_dir))
    made = {"union": spans.union(a, b), "intersection": spans.intersection(a, b), "difference": spans.difference(a, b)}
    named = [df.select(F.lit(op).alias("op"), "grid_id", "site", "row", "first", "last") for op, df in made.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(f"""WITH {_MASKS}, n AS (SELECT grid_id, a.site AS site_a, b.site AS site_b, count(*) AS shared FROM a JOIN b USING (grid_id, row, col) GROUP BY ALL),
na AS (SELECT grid_id, site AS site_a, count(*) AS na FROM a GROUP BY ALL), nb AS (SELECT grid_id, site AS site_b, count(*) AS nb FROM b GROUP BY ALL)
SELECT grid_id, site_a, site_b, shared, round(shared / (na + nb - shared), 6) AS iou FROM n JOIN na USING (grid_id, site_a) JOIN nb USING (grid_id, site_b)""")
def span_overlap(spark, sf_dir):
    """Shared cells of masks on two grids, from their spans."""
    return rounded(spans.overlap(*_masks(spark, sf_dir)))


_PATCHES = f"""{LATTICE_SQL}, area AS (SELECT max(row) AS last FROM lat),
pos AS (SELECT unnest(range(-1, last + 2)) AS row, c.col AS col FROM area, (SELECT unnest(range(-1, 41)) AS col) AS c),
m AS (SELECT pos.row, pos.col, (pos.row + 2) * 100 + pos.col + 2 AS id, coalesce(CAST(z * 10 AS BIGINT) % 3 <> 0, false) AS held FROM pos LEFT JOIN lat ON lat.row = pos.row AND lat.col = pos.col),
-- ground meets along sides, gaps along corners too
near AS (SELECT a.id, b.id AS other FROM m a JOIN m b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.held = b.held AND (NOT a.held OR abs(a.row - b.row) + abs(a.col - b.col) = 1)),
r(id, other) AS (SELECT id, id FROM m UNION SELECT r.id, near.other FROM r JOIN near ON near.id = r.other),
part_of AS (SELECT id, min(other) AS part FROM r GROUP BY id),
sides AS (SELECT p.part AS ground, q.part AS gap, 4 * (a.row * 40 + a.col) + k AS side FROM m a JOIN part_of p ON p.id = a.id AND a.held,
  (VALUES (-1, 0, 0), (0, 1, 1), (1, 0, 2), (0, -1, 3)) AS s(dr, dc, k), m b JOIN part_of q ON q.id = b.id WHERE b.row = a.row + dr AND b.col = a.col + dc AND NOT b.held),
edges AS (SELECT ground, gap, min(side) AS ring, count(*) AS n_sides FROM sides GROUP BY ground, gap),
outer_gap AS (SELECT p.part AS ground, q.part AS gap FROM part_of p JOIN m a ON a.id = p.id AND a.held AND p.part = p.id JOIN m b ON b.row = a.row AND b.col = a.col - 1 JOIN part_of q ON q.id = b.id)"""


@query(f"""WITH RECURSIVE {_PATCHES}
SELECT e.ring, e.n_sides, o.ring AS owner FROM edges e JOIN outer_gap g ON g.ground = e.ground AND g.gap <> e.gap JOIN edges o ON o.ground = g.ground AND o.gap = g.gap""")
def hole_owners(spark, sf_dir):
    """Every hole of a mask with many: its smallest side, its length, and the smallest side of the exterior around it."""
    ringed = _ringed(spark, sf_dir)
    lengths = ringed.select("grid_id", "site", "ring", (F.size("points") - 1).cast("long").alias("n_sides"))
    return contours.hole_owners(ringed).join(lengths, ["grid_id", "site", "ring"]).select("ring", "n_sides", "owner")


def _ringed(spark, sf_dir):
    cells = L.lattice(spark, sf_dir).where("cast(rint(z * 10) as bigint) % 3 <> 0")
    return settled(contours.rings(cells.select("grid_id", F.lit(0).alias("site"), "row", "col"), COLS))


@query(f"WITH RECURSIVE {_PATCHES} SELECT e.ring, e.n_sides, g.gap <> e.gap AS is_hole FROM edges e JOIN outer_gap g USING (ground)")
def mask_rings(spark, sf_dir):
    """The rings around a mask: exteriors and holes with their lengths."""
    return _ringed(spark, sf_dir).select("ring", (F.size("points") - 1).cast("long").alias("n_sides"), (F.col("area2") < 0).alias("is_hole"))


@query(f"""WITH {LATTICE_SQL}, m AS (SELECT z AS za, round(z, 0) AS zb FROM lat)
SELECT count(*) AS cells, round(sqrt(avg(pow(za - zb, 2))), 6) AS rmse, round(avg(za - zb), 6) AS bias, round(quantile_cont(abs(za - zb), 0.95), 6) AS p95, round(corr(za, zb), 6) AS correlation FROM m""")
def surface_agreement(spark, sf_dir):
    cells = L.lattice(spark, sf_dir)
    return rounded(rasters.agreement(cells, cells.withColumn("z", F.round("z", 0))).drop("grid_id"))


@query("""WITH a AS (SELECT c_custkey % 100 AS point_id, 1000 + c_acctbal AS area_m2 FROM customer), s AS (SELECT point_id, avg(area_m2) AS mean, stddev_pop(area_m2) AS std FROM a GROUP BY point_id)
SELECT point_id, round(mean, 6) AS mean_m2, round(std, 6) AS std_m2, round(CASE WHEN mean > 0 THEN std / mean END, 6) AS cv,
CASE WHEN mean <= 0 THEN 'low' WHEN std / mean <= 0.1 THEN 'high' WHEN std / mean <= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM s""")
def ensemble_statistics(spark, sf_dir):
    c = L.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("point_id"), (1000 + F.col("c_acctbal")).alias("area_m2"))
    return rounded(siting.ensemble(c))


@query("""WITH a AS (SELECT c_custkey % 100 AS point_id, 20000 + c_acctbal * (c_custkey % 100 / 25.0) AS area_m2 FROM customer),
s AS (SELECT CAST(point_id % 5 AS INTEGER) AS grid_id, CAST(point_id AS INTEGER) AS rank, avg(area_m2) AS mean, stddev_pop(area_m2) AS std FROM a GROUP BY point_id),
k AS (SELECT *, CASE WHEN mean <= 0 THEN 'low' WHEN std / mean <= 0.1 THEN 'high' WHEN std / mean <= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM s)
SELECT grid_id, rank, confidence, rank = min(rank) OVER (PARTITION BY grid_id) AS best FROM k WHERE confidence <> 'low'""")
def recommended_sites(spark, sf_dir):
    areas = L.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("point_id"), (20000 + F.col("c_acctbal") * (F.col("c_custkey") % 100 / 25.0)).alias("area_m2"))
    sites = siting.ensemble(areas).select(F.expr("cast(point_id % 5 as int)").alias("grid_id"), F.col("point_id").cast("int").alias("rank"), "confidence")
    return siting.recommended(sites)


@query("""WITH s AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank, count(*) OVER (PARTITION BY c_nationkey) AS sites FROM customer)
SELECT CAST(c_nationkey AS INTEGER) AS grid_id, CAST(c_custkey AS BIGINT) AS cell, CAST(c_custkey / 4.0 AS DOUBLE) AS area_ha, CAST(c_custkey * 3 AS DOUBLE) AS runoff_m3, CASE WHEN c_acctbal > 0 THEN CAST(c_custkey AS DOUBLE) END AS usable_m3,
CASE WHEN c_acctbal > 0 THEN CAST(c_custkey // 2 AS DOUBLE) ELSE -1.0 END AS fill_ratio, CASE WHEN c_acctbal > 0 THEN 'fills' ELSE 'overflows' END AS verdict, CAST(sites AS BIGINT) AS sites FROM s WHERE rank = 1""")
def saved_summaries(spark, sf_dir):
    c, gains = F.col("c_custkey").cast("double"), F.col("c_acctbal") > 0
    infinite = F.lit(float("inf"))
    sites = L.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("int").alias("grid_id"), F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).alias("rank"), F.col("c_custkey").cast("long").alias("outlet"), (c * 2500).alias("area_m2"), c.alias("relief_m"), c.alias("length_m"),
        F.lit(0.25).alias("edge_contact"), (c * 3).alias("runoff_m3"), F.when(gains, c).otherwise(infinite).alias("usable_m3"), F.when(gains, F.floor(c / 2).cast("double")).otherwise(infinite).alias("fill_ratio"), F.when(gains, "fills").otherwise("overflows").alias("verdict"),
        c.alias("concentration_min"), F.lit(True).alias("lower_bound"),
    )
    return outputs.summary(outputs.site_response(sites))


@query("""WITH named AS (SELECT c_nationkey AS path, c_custkey % 3 AS level FROM customer WHERE c_acctbal > 0), known AS (SELECT DISTINCT p_size % 25 AS path, p_partkey % 4 AS level FROM part WHERE p_size % 25 > 4)
SELECT CAST(n.path AS BIGINT) AS path, bool_and(k.level IS NOT NULL) AS consistent FROM named n LEFT JOIN known k USING (path, level) GROUP BY n.path""")
def label_levels(spark, sf_dir):
    name = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Level: "), F.col("c_custkey") % 3, F.lit(" m"))).otherwise(F.col("c_name"))
    labels = L.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("path"), name.alias("name"))
    levels = L.table(spark, sf_dir, "part").where("p_size % 25 > 4").select(F.expr("cast(p_size % 25 as bigint)").alias("path"), F.expr("cast(p_partkey % 4 as double)").alias("level"))
    return kml.label_check(labels, levels)


_LEVELS = f"""{GAPPY_SQL}, b AS (SELECT min(z) AS bottom, max(z) AS top FROM lat),
sq AS (SELECT a.row, a.col, a.z AS sw, e.z AS se, n.z AS nw, d.z AS ne FROM lat a JOIN lat e ON e.row = a.row AND e.col = a.col + 1 JOIN lat n ON n.row = a.row + 1 AND n.col = a.col JOIN lat d ON d.row = a.row + 1 AND d.col = a.col + 1
  WHERE a.z + e.z + n.z + d.z IS NOT NULL),
met AS (SELECT sq.*, k * 5.0::DOUBLE AS level FROM sq, (SELECT unnest(range(CAST(floor(bottom / 5) AS BIGINT) + 1, CAST(ceil(top / 5) AS BIGINT))) AS k FROM b)
  WHERE k * 5.0::DOUBLE > least(sw, se, nw, ne) AND k * 5.0::DOUBLE <= greatest(sw, se, nw, ne)),
ends AS (SELECT *, (sw + se + ne + nw) / 4.0 >= level AS mid, sw >= level AS asw, se >= level AS ase, nw >= level AS anw, ne >= level AS ane,
  (level - sw) / (se - sw) AS s, (level - nw) / (ne - nw) AS n, (level - sw) / (nw - sw) AS w, (level - se) / (ne - se) AS e FROM met),
joined AS (
  SELECT level, list_filter([CASE WHEN asw <> ase THEN {{'x': s, 'y': 0.0::DOUBLE, 'id': 2 * (row * 40 + col)}} END, CASE WHEN ase <> ane THEN {{'x': 1.0::DOUBLE, 'y': e, 'id': 2 * (row * 40 + col + 1) + 1}} END,
    CASE WHEN anw <> ane THEN {{'x': n, 'y': 1.0::DOUBLE, 'id': 2 * (row * 40 + 40 + col)}} END, CASE WHEN asw <> anw THEN {{'x': 0.0::DOUBLE, 'y': w, 'id': 2 * (row * 40 + col) + 1}} END], lambda p: p IS NOT NULL) AS p, mid = asw AS near FROM ends
),
parts AS (
  SELECT level, p[1] AS a, CASE WHEN len(p) = 2 OR near THEN p[2] ELSE p[4] END AS b FROM joined UNION ALL SELECT level, CASE WHEN near THEN p[3] ELSE p[2] END, CASE WHEN near THEN p[4] ELSE p[3] END FROM joined WHERE len(p) = 4
)"""


#: Joints of the same line have the same least joint: it is handed on from those that learned of a lesser one last.
_LINES = f"""{_LEVELS}, segs AS (SELECT level, CAST(a.id AS BIGINT) AS i, CAST(b.id AS BIGINT) AS j, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS m FROM parts),
links AS (SELECT level, i, j FROM segs UNION ALL SELECT level, j, i FROM segs),
known(level, id, low) USING KEY (level, id) AS (
  SELECT DISTINCT level, i, i FROM links
  UNION
  SELECT n.level, n.id, n.low FROM (SELECT l.level, l.j AS id, min(x.low) AS low FROM known x JOIN links l ON l.level = x.level AND l.i = x.id GROUP BY l.level, l.j) n
    JOIN recurring.known w ON w.level = n.level AND w.id = n.id WHERE n.low < w.low
),
joints AS (SELECT level, low AS line, count(*) AS n FROM known GROUP BY level, low)"""


@query(f"""WITH RECURSIVE {_LINES}, sums AS (SELECT s.level, low AS line, count(*) AS n, sum(m) AS length FROM segs s JOIN known k ON k.level = s.level AND k.id = s.i GROUP BY s.level, low)
SELECT s.level, s.line, CAST(s.n + 1 AS INTEGER) AS n_points, s.n = j.n AS closed, round(length, 6) AS length FROM sums s JOIN joints j USING (level, line)""")
def contour_lines(spark, sf_dir):
    lines = contours.contours(L.lattice(spark, sf_dir, True), GRID, 5.0)
    return rounded(lines.select("level", "line", F.size("points").alias("n_points"), "closed", geometry.length(F.col("points")).alias("length")))


@query(f"WITH {_LEVELS} SELECT level, count(*) AS segments, round(sum(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2))), 4) AS length FROM parts GROUP BY level")
def contour_lengths(spark, sf_dir):
    """What the lines of each level hold: every segment of every square once."""
    lines = contours.contours(L.lattice(spark, sf_dir, True), GRID, 5.0)
    made = lines.groupBy("level").agg(F.sum(F.size("points") - 1).cast("long").alias("segments"), F.sum(geometry.length(F.col("points"))).alias("length"))
    return rounded(made, 4)


@query()
def mask_polygons(spark, sf_dir):
    flow, outlets = _outlets(spark, sf_dir)
    members = graph.upstream(flow, outlets).join(shuffled(flow.select("grid_id", "cell", "row", "col")), ["grid_id", "cell"])
    return contours.mask_geojson(members.select("grid_id", F.col("outlet").alias("site"), "row", "col"), GRID).drop("grid_id", "over")


# imagery


@query("""WITH e AS (SELECT vec_id AS cell, least(greatest(round(CAST(embedding[1] AS DOUBLE) + 0.5, 4), 0), 1) AS r, least(greatest(round(CAST(embedding[2] AS DOUBLE) + 0.5, 4), 0), 1) AS g, least(greatest(round(CAST(embedding[3] AS DOUBLE) + 0.5, 4), 0), 1) AS b FROM embeddings)
SELECT cell, round((r + g + b + 1e-6) / 3, 6) AS brightness, round((greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + 1e-6), 6) AS saturation,
round((2 * g - r - b) / (r + g + b + 1e-6), 6) AS exg, round(b / (r + g + b + 1e-6), 6) AS blue_share FROM e""")
def colour_indices(spark, sf_dir):
    made = imagery.colour_indices(L.colours(spark, sf_dir))
    return rounded(made.select((F.col("row") * 20 + F.col("col")).cast("long").alias("cell"), "brightness", "saturation", "exg", "blue_share"))


@query()
def land_classes(spark, sf_dir):
    return imagery.classify(L.colours(spark, sf_dir), 20, 10.0).select("row", "col", "class")


@query(f"""WITH RECURSIVE {LATTICE_SQL}, m AS (SELECT cell, row, col FROM lat WHERE CAST(z * 10 AS BIGINT) % 3 = 0),
r(cell, other) AS (SELECT cell, cell FROM m UNION SELECT r.cell, b.cell FROM r JOIN m a ON a.cell = r.other JOIN m b ON abs(a.row - b.row) + abs(a.col - b.col) = 1)
SELECT cell, min(other) AS patch FROM r GROUP BY cell""")
def connected_patches(spark, sf_dir):
    cells = L.lattice(spark, sf_dir).where("cast(rint(z * 10) as bigint) % 3 = 0")
    return graph.patches(cells, COLS).select("cell", "patch")


@query("""WITH l AS (SELECT 0 AS grid_id, CASE WHEN label % 5 = 4 THEN NULL ELSE label % 4 END AS class FROM embeddings)
SELECT CAST(class AS INTEGER) AS class, CAST(count(*) * 100.0 AS DOUBLE) AS area_m2, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM l WHERE class IS NOT NULL GROUP BY class""")
def land_availability(spark, sf_dir):
    land = L.table(spark, sf_dir, "embeddings").select(F.lit(0).alias("grid_id"), F.expr("case when label % 5 <> 4 then label % 4 end").alias("class"))
    return imagery.land_availability(land, 10.0).drop("grid_id")


# labels, sorting, paging and sets


_UNITS_SQL = ", ".join("('{}', '{}')".format(word.replace("'", "''"), unit) for word, unit in scalars.UNITS.items())


@query(f"""WITH t AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Elevation: ' || c_nationkey || ' m' WHEN 1 THEN c_name WHEN 2 THEN CAST(c_acctbal AS VARCHAR) || 'ft' WHEN 3 THEN 'contour-' || c_nationkey WHEN 4 THEN '+' || c_nationkey || 'e1 Feet' ELSE c_nationkey || '.5' END AS label FROM customer),
u AS (SELECT c_custkey, label, lower(trim(label)) AS l, arg_max(word, length(word)) AS word, arg_max(unit, length(word)) AS unit FROM t LEFT JOIN (VALUES {_UNITS_SQL}) AS units(word, unit) ON ends_with(lower(trim(label)), word) GROUP BY c_custkey, label),
b AS (SELECT *, rtrim(l[:length(l) - length(coalesce(word, ''))]) AS body FROM u),
n AS (SELECT *, string_split_regex(body, '[ :=]')[-1] AS number FROM b),
v AS (SELECT *, CASE WHEN NOT regexp_matches(body[:length(body) - length(number)], '[0-9+-]') AND regexp_matches(number, '^[+-]?[0-9]') AND NOT regexp_matches(number, '[^0-9.e+-]|[.]([^0-9]|$)|e.*[.]') THEN TRY_CAST(number AS DOUBLE) END AS value FROM n)
SELECT c_custkey, label, value, CASE WHEN value IS NOT NULL THEN unit END AS unit FROM v""")
def labelled_numbers(spark, sf_dir):
    label = F.expr("""case c_custkey % 6 when 0 then 'Elevation: ' || c_nationkey || ' m' when 1 then c_name when 2 then cast(c_acctbal as string) || 'ft'
        when 3 then 'contour-' || c_nationkey when 4 then '+' || c_nationkey || 'e1 Feet' else c_nationkey || '.5' end""")
    wide = L.table(spark, sf_dir, "customer").select("c_custkey", label.alias("label")).withColumn("n", scalars.labelled_number(F.col("label")))
    return wide.select("c_custkey", "label", "n.value", "n.unit")


@query(f"""WITH {LATTICE_SQL}, s AS (SELECT max(z) - min(z) AS span, min(z) AS low, max(z) AS high FROM lat)
SELECT level, abs(level - round_even(level / 25, 0) * 25) < 1.25 AS is_index FROM (SELECT unnest(range(CAST(floor(low / 5) AS BIGINT) + 1, CAST(ceil(high / 5) AS BIGINT))) * 5.0::DOUBLE AS level FROM s)""")
def contour_levels(spark, sf_dir):
    span = L.lattice(spark, sf_dir).agg(F.min("z").alias("low"), F.max("z").alias("high"))
    levels = span.select(F.explode(scalars.level_multiples(F.col("low"), F.col("high"), F.lit(5.0))).alias("level"))
    return levels.select("level", scalars.is_index_level(F.col("level"), F.lit(5.0)).alias("is_index"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged_listing(spark, sf_dir):
    return L.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("SELECT DISTINCT round(p_retailprice, 0) AS level FROM part")
def distinct_levels(spark, sf_dir):
    return L.table(spark, sf_dir, "part").select(F.round("p_retailprice", 0).alias("level")).distinct()


@query("SELECT p_partkey FROM part WHERE p_size > 20 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def unclaimed_cells(spark, sf_dir):
    claimed = L.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return L.table(spark, sf_dir, "part").where("p_size > 20").select("p_partkey").distinct().join(claimed, "p_partkey", "left_anti")


@query("SELECT l_partkey AS cell FROM lineitem WHERE l_discount > 0.08 UNION SELECT p_partkey FROM part WHERE p_size < 5")
def excluded_cells(spark, sf_dir):
    a = L.table(spark, sf_dir, "lineitem").where("l_discount > 0.08").select(F.col("l_partkey").alias("cell"))
    return a.union(L.table(spark, sf_dir, "part").where("p_size < 5").select("p_partkey")).distinct()


@query("""SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
round(avg(value), 6) AS mean, round(avg(value) FILTER (value > 50), 6) AS mean_large FROM events GROUP BY event_type""")
def latency_summary(spark, sf_dir):
    e = L.table(spark, sf_dir, "events")
    means = e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(F.when(F.col("value") > 50, F.col("value"))).alias("mean_large"))
    far = quantiles(e, ["event_type"], F.col("value"), [0.5, 0.95, 0.99])
    return rounded(means.join(far, "event_type", "left").select("event_type", "n", *(F.col(f"q{i}").alias(c) for i, c in enumerate(("p50", "p95", "p99"))), "mean", "mean_large"))


@query("""SELECT event_id, substr(sha256('{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}'), 1, 32) AS request_key FROM events""")
def request_keys(spark, sf_dir):
    e = L.table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("type")))
    return e.select("event_id", scalars.request_key(body).alias("request_key"))
