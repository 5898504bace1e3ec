"""A sheet with a known valley, from its text to its sites."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.errors import AnalysisError
from rillflow.functions import resolution
from rillflow.operators import hull
from rillflow.plans import analysis, outputs, terrain
from rillflow.sources import kml, rainfall
from rillflow.sources import rasters as raster_files

LON, LAT = 8.3, 46.25


def valley_kml():
    """Contours of z = 0.05 |x| + 0.01 y over a kilometre, one metre apart."""
    kx, ky = 111320 * math.cos(math.radians(LAT)), 110540
    marks = []
    for level in range(0, 36):
        for side in (-1, 1):
            points = [(side * (level - 0.01 * y) / 0.05, y) for y in range(0, 1001, 20)]
            points = [(x, y) for x, y in points if 0 <= side * x <= 500]
            if len(points) > 1:
                text = " ".join(f"{LON + x / kx:.9f},{LAT + y / ky:.9f}" for x, y in points)
                marks.append(f"<Placemark><name>{level}</name><LineString><coordinates>{text}</coordinates></LineString></Placemark>")
    return f"<kml><Document>{''.join(marks)}</Document></kml>"


@pytest.fixture(scope="module")
def surface(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("valley") / "valley.kml"
    path.write_text(valley_kml())
    marks = kml.read_placemarks(spark, str(path))
    return analysis.sheet_surface(kml.vertices(marks), 20.0)


def test_surface_is_the_valley(surface):
    grid, lattice, warnings = surface
    kx = grid.frame.metres_per_lon
    x = grid.x(F.col("col")) + (grid.frame.lon0 - LON) * kx
    y = grid.y(F.col("row")) + (grid.frame.lat0 - LAT) * grid.frame.metres_per_lat
    inner = lattice.where("raw is not null").withColumn("want", 0.05 * F.abs(x) + 0.01 * y).where(F.abs(x).between(60, 400) & y.between(100, 800))
    assert inner.count() > 500 and inner.where("abs(raw - want) > 0.11").count() == 0
    assert grid.interval_m == 1.0 and len(warnings) == 1  # 20 m is coarser than the contours


def test_routing_follows_the_channel(surface):
    grid, lattice, _ = surface
    drained = terrain.route(lattice, grid)
    cells = drained.cells
    most = cells.orderBy(F.desc("accumulation")).first()
    lon = grid.frame.lon0 + (grid.x0 + most.col * 20) / grid.frame.metres_per_lon
    assert abs((lon - LON) * grid.frame.metres_per_lon) <= 40
    assert most.accumulation >= 0.8 * cells.count()
    layer = outputs.stream_layer(drained.flow, cells, grid, 20_000.0)
    made = json.loads(outputs.collection(layer, ["nth"]).first().geojson)
    assert made["features"][0]["properties"]["role"] == "stream"


def test_analysis_gives_sites_and_balances(spark, surface):
    grid, lattice, _ = surface
    gentle = lattice.withColumn("z", F.col("z") * 0.4)
    found = analysis.analyse(grid, gentle, rainfall.climatology(spark), 2)
    rows = found["balances"].collect()
    assert rows and {r.rank for r in rows} <= {1, 2}
    for r in rows:
        assert r.runoff_m3 == pytest.approx(r.area_m2 * 0.1915, rel=0.01)
    made = json.loads(found["geojson"].first().geojson)
    roles = [f["properties"]["role"] for f in made["features"]]
    wet = {r.outlet: r.n for r in found["ponds"].groupBy("outlet").agg(F.count("*").alias("n")).collect()}
    want = [role for r in sorted(rows, key=lambda r: r.rank) for role in ["catchment", "pond"][: 1 + (wet[r.outlet] >= 2)]]
    assert roles == want + ["flow_path"] + ["outlet"] * len(rows)
    surface_m2 = {r.outlet: r.m2 for r in found["ponds"].groupBy("outlet").agg(F.sum(grid.cell_area(F.col("row"))).alias("m2")).collect()}
    for r in rows:
        assert surface_m2[r.outlet] == pytest.approx(r.usable_m2)
    path = next(f for f in made["features"] if f["properties"]["role"] == "flow_path")["geometry"]["coordinates"]
    first = next(f for f in made["features"] if f["properties"]["role"] == "outlet")["geometry"]["coordinates"]
    kx, ky = 111320 * math.cos(math.radians(LAT)), 110540
    length = sum(math.hypot((a[0] - b[0]) * kx, (a[1] - b[1]) * ky) for a, b in zip(path, path[1:]))
    assert path[-1] == first and length == pytest.approx(next(r.length_m for r in rows if r.rank == 1), rel=0.01)
    response = json.loads(outputs.site_response(found["balances"]).first().response)
    assert [s["rank"] for s in response["sites"]] == sorted(r.rank for r in rows)
    assert analysis.two_surfaces((grid, lattice), (grid, lattice)).first().rmse == pytest.approx(0, abs=1e-9)


def test_contour_layer_is_coloured(spark, surface):
    from rillflow.operators import contours

    grid, lattice, _ = surface
    lines = contours.contours(lattice, grid, 5.0)
    rows = [json.loads(r.feature) for r in outputs.contour_layer(lines, grid, 5.0).collect()]
    assert rows and any(f["properties"]["index"] for f in rows) and all(f["properties"]["stroke"].startswith("#") for f in rows)


def test_hull_of_hulls(spark):
    rng = np.random.default_rng(2)
    xy = rng.random((500, 2))
    rows = [("a", float(x), float(y)) for x, y in xy] + [("b", 0.0, 0.0), ("b", 4.0, 0.0), ("b", 4.0, 3.0), ("b", 0.0, 3.0), ("b", 2.0, 1.0)]
    made = hull.convex_hulls(spark.createDataFrame(rows, "path string, x double, y double"))
    assert made.where("path = 'b'").first().hull_m2 == 12 and made.where("path = 'b'").count() == 4
    want = hull.hull([(float(x), float(y)) for x, y in xy])
    assert {(r.x, r.y) for r in made.where("path = 'a'").collect()} == set(want)


def test_resolution_rules():
    assert resolution.sheet_resolution(12.52, 8.3e6) == (pytest.approx(3.13), "derived", [])
    assert resolution.sheet_resolution(400.0, 8.3e6)[:2] == (20.0, "clamped")
    coarse, source, warnings = resolution.sheet_resolution(8.0, 1e9)
    assert source == "coarsened" and 1e9 / coarse**2 <= 12_000_000 and warnings
    assert resolution.area_resolution(17.8, 8e6)[:2] == (17.8, "derived")
    assert resolution.area_resolution(17.8, 8e6, 10.0)[1] == "coarsened"
    with pytest.raises(AnalysisError):
        resolution.sheet_resolution(10.0, 1e6, -1.0)
    assert all(r >= 5 for r in resolution.ensemble_resolutions(6.0, 1e6))


def test_texts(spark):
    one = spark.range(1).select(outputs.warning_header(F.array(F.lit("a"), F.lit("bЖ"), F.lit("a"))).alias("v")).first().v
    assert one == "a | b?"
    long = spark.range(1).select(outputs.warning_header(F.array(F.lit("x" * 2000))).alias("v")).first().v
    assert len(long) == 900 and long.endswith("...")
    rows = [("k1", "one", "", 2.0, '{"lon": 8.3, "lat": 46.25}', "{}"), ("k2", "two", "", 3.0, '{"lon": 8.4, "lat": 46.2}', "{}")]
    saved = spark.createDataFrame(rows, "id string, name string, notes string, created double, summary string, body string")
    made = json.loads(outputs.saved_layer(saved).first().geojson)
    assert [f["properties"]["id"] for f in made["features"]] == ["k2", "k1"]


def test_no_site_has_a_reason(spark, surface):
    grid, lattice, _ = surface
    everywhere = lattice.select("grid_id", "cell")
    with pytest.raises(AnalysisError) as e:
        analysis.analyse(grid, lattice.withColumn("z", F.col("z") * 0.4), rainfall.climatology(spark), 2, excluded=everywhere)
    assert e.value.code == "no_available_ground"
    with pytest.raises(AnalysisError) as e:
        analysis.analyse(grid, lattice.withColumn("z", F.col("z") * 40), rainfall.climatology(spark), 2)
    assert e.value.code == "no_buildable_ground"


def test_pour_point_lies_on_the_sheet():
    box = (8.0, 46.0, 8.5, 46.5)
    analysis.check_pour_point(8.5, 46.0, box)
    with pytest.raises(AnalysisError) as e:
        analysis.check_pour_point(8.6, 46.0, box)
    assert e.value.code == "pour_point_outside_map"


def test_labels_of_a_sheet(spark, tmp_path):
    mark = "<Placemark><name>{0}</name><LineString><coordinates>8,46 8.1,46 8.1,46.1</coordinates></LineString></Placemark>"
    spot = "<Placemark><name>{0}</name><Point><coordinates>81,21</coordinates></Point></Placemark>"
    for stem, labels in (("good", ["10 m", "20", "well"]), ("bad", ["10 m", "15"])):
        (tmp_path / f"{stem}.kml").write_text("<kml><Document>" + "".join(mark.format(v) for v in (10, 20, 30)) + "".join(spot.format(v) for v in labels) + "</Document></kml>")
    made = {r.path.rsplit("/", 1)[1]: r.consistent for r in kml.sheet_labels(kml.read_placemarks(spark, str(tmp_path))).collect()}
    assert made == {"good.kml": True, "bad.kml": False}


def test_codes_of_heights_round_trip(spark):
    from rillflow.functions import scalars

    heights = [0.0, -32768.0, 8848.86, 254.999, 255.9999, 511.9999, -0.001, 1e6]
    coded = spark.createDataFrame([(h,) for h in heights], "z double").select("z", scalars.terrarium_bytes(F.col("z")).alias("p"))
    for r in coded.select("z", "p.*", scalars.terrarium_height(F.col("p.r"), F.col("p.g"), F.col("p.b")).alias("back")).collect():
        assert all(0 <= v <= 255 for v in (r.r, r.g, r.b))
        assert r.back == pytest.approx(min(r.z, 32768 - 1 / 256), abs=1 / 512)


def test_sites_that_grids_contradict(spark):
    from rillflow.operators import siting

    rows = [(0, 1, "low"), (0, 2, "high"), (0, 3, None), (1, 1, "low")]
    made = siting.recommended(spark.createDataFrame(rows, "grid_id int, rank int, confidence string"))
    assert {(r.grid_id, r.rank, r.best) for r in made.collect()} == {(0, 2, True), (0, 3, False)}


def test_area_from_tiles_to_sites(spark, tmp_path):
    """A valley in elevation tiles, one of which is there only at a coarser zoom, from files to sites inside the area."""
    from test_sources import png

    from rillflow.functions import projection

    zoom = 13
    kx, ky = 111320 * math.cos(math.radians(LAT)), 110540
    half = 0.0065
    ring = [(LON - half, LAT - half), (LON + half, LAT - half), (LON + half, LAT + half), (LON - half, LAT + half), (LON - half, LAT - half)]
    box = projection.buffered((LON - half, LAT - half, LON + half, LAT + half))
    wanted = [(r.x, r.y) for r in raster_files.wanted_tiles(spark, box, zoom).collect()]

    def write(z, x, y):
        px, py = np.meshgrid(np.arange(256), np.arange(256))
        n = 2**z
        lon = (x * 256 + px + 0.5) / (256 * n) * 360 - 180
        lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (y * 256 + py + 0.5) / (256 * n)))))
        height = 500 + 0.02 * np.abs((lon - LON) * kx) + 0.004 * (lat - LAT) * ky + 32768
        whole = np.floor(height)
        path = tmp_path / f"{z}/{x}/{y}.png"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png(np.stack([whole // 256, whole % 256, np.floor((height - whole) * 256)], -1).astype(np.uint8)))

    for x, y in wanted[1:]:
        write(zoom, x, y)
    write(zoom - 1, wanted[0][0] // 2, wanted[0][1] // 2)
    found = analysis.analyse_area(spark, [str(tmp_path)], ring, rainfall.climatology(spark), top_n=2)
    rows = found["balances"].collect()
    assert rows and {r.rank for r in rows} <= {1, 2}
    assert sum(r.n for r in found["origins"].collect()) == len(wanted) and {r.up for r in found["origins"].collect()} <= {0, 1}
    for feature in json.loads(found["geojson"].first().geojson)["features"]:
        if feature["properties"]["role"] == "outlet":
            lon, lat = feature["geometry"]["coordinates"]
            assert abs(lon - LON) <= half and abs(lat - LAT) <= half and abs(lon - LON) * kx < 120
    with pytest.raises(AnalysisError) as refused:
        analysis.analyse_area(spark, [str(tmp_path)], [(x + 3, y) for x, y in ring], rainfall.climatology(spark))
    assert refused.value.code == "elevation_unavailable"


def test_what_drains_through_a_point(spark):
    """The point snaps to the channel of a small valley and gets all that drains through there."""
    from rillflow.functions.projection import Grid, LocalFrame
    from rillflow.operators import focal, graph

    row, col = np.mgrid[0:30, 0:21]
    z = 0.05 * abs(col - 10) * 10 + 0.01 * row * 10
    grid = Grid(LocalFrame(LON, LAT), 10.0, 21, spacing_m=10.0)
    lattice = spark.createDataFrame([(0, r, c, float(z[r, c])) for r in range(30) for c in range(21)], "grid_id int, row int, col int, z double")
    toured = graph.tour(focal.steepest_descent(lattice, 21, 10.0), 21)
    lon, lat = LON + 115 / grid.frame.metres_per_lon, LAT + 110 / grid.frame.metres_per_lat
    got = analysis.drained_through({"tour": toured}, grid, lattice, lon, lat).collect()
    sizes = {r.cell: r["size"] for r in toured.collect()}
    near = [r * 21 + c for r in range(8, 15) for c in range(21) if abs(c - 11.5) <= 3.5]
    assert len(got) == 1 and got[0].cells == sizes[got[0].outlet] == max(sizes[c] for c in near) and got[0].relief_m > 0
    analysis.check_pour_point(lon, lat, (LON, LAT, LON + 1, LAT + 1))


def test_a_sheet_from_its_file_to_sites_and_a_pour_point(spark, tmp_path):
    (tmp_path / "valley.kml").write_text(valley_kml())
    found = analysis.analyse_sheet(spark, str(tmp_path / "valley.kml"), rainfall.climatology(spark), 20.0, (LON, LAT + 0.001), top_n=2)
    sites = found["sites"].collect()
    assert 1 <= len(sites) <= 2 and {r.rank for r in sites} == set(range(1, len(sites) + 1))
    (through,) = found["pour_point"].collect()
    # the valley drains south along its middle: nearly all of it passes a point near its mouth
    assert through.cells >= 0.8 * found["tour"].count() and through.lower_bound
    assert through.cells == found["tour"].where(F.col("cell") == through.outlet).first()["size"]
    made = json.loads(found["geojson"].first().geojson)
    assert [f["properties"]["role"] for f in made["features"]].count("outlet") == len(sites)
    west, south, east, north = made["bbox"]
    assert west < LON < east and south < LAT + 0.005 < north
    balances = {r["rank"]: r for r in found["balances"].collect()}
    for f in made["features"]:
        p = f["properties"]
        if p["role"] == "catchment":
            assert p["longest_flow_path_m"] > 0 and p["confidence"] is None and p["resolution_m"] == 20.0
        if p["role"] == "outlet":
            b = balances[p["rank"]]
            assert p["recommended"] and p["slope_pct"] >= 0 and (p["annual_runoff_m3"], p["verdict"]) == (round(b.runoff_m3), b.verdict)
            assert west <= f["geometry"]["coordinates"][0] <= east and south <= f["geometry"]["coordinates"][1] <= north
