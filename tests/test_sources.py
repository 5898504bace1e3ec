"""Sheets, tiles, grids, rain, selections and the store."""

import json
import math
import struct
import zipfile
import zlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow import config
from rillflow.errors import AnalysisError
from rillflow.functions import geometry, projection, scalars
from rillflow.operators import rasters
from rillflow.operators.triangulate import delaunay, triangulated
from rillflow.sources import kml, rainfall, selection, store
from rillflow.sources import rasters as raster_files
from rillflow.streaming.rain import daily_runoff


def square(level, z=False):
    k = 0.004 * (1 - level / 100)
    points = [(8.3 + a * k, 46.25 + b * k) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    return " ".join(f"{x:.6f},{y:.6f}" + (f",{level}" if z else "") for x, y in points)


def mark(level, name="x", z=False, data=""):
    return f"<Placemark><name>{name}</name>{data}<LineString><coordinates>{square(level, z)}</coordinates></LineString></Placemark>"


def sheet(*inner, ns=' xmlns="http://www.opengis.net/kml/2.2"'):
    return f"\n<kml{ns}><Document><name>sheet</name>{''.join(inner)}</Document></kml>"


LEVELS = (10, 20, 30)
SHEETS = {
    "z.kml": sheet(*(mark(k, z=True) for k in LEVELS)),
    "data.kml": sheet(*(mark(k, data=f'<ExtendedData><SimpleData name="ELEV">{k}</SimpleData></ExtendedData>') for k in LEVELS)),
    "named.kml": sheet(*(mark(k, f"Elevation: {k} m") for k in LEVELS), ns=""),
    "folder.kml": sheet(*(f"<Folder><name>999</name><Folder><name>{k}</name>{mark(k)}</Folder></Folder>" for k in LEVELS)),
    "labels.kml": sheet(*(mark(k, str(k)) for k in LEVELS), "<Folder><name>Labels</name><Placemark><name>5</name><Point><coordinates>81,21</coordinates></Point></Placemark></Folder>"),
    "feet.kml": sheet(*(mark(k, f"{k} ft") for k in (100, 105, 110))),
    "bad.kml": "<kml><Document>",
    "points.kml": sheet("<Placemark><name>5</name><Point><coordinates>81,21</coordinates></Point></Placemark>"),
    "unlabelled.kml": sheet(*(mark(k) for k in LEVELS)),
    "single.kml": sheet(mark(10, "10"), mark(11, "10")),
    "broken.kml": sheet("<Placemark><LineString><coordinates>1,2 x,3</coordinates></LineString></Placemark>"),
}


@pytest.fixture(scope="module")
def sheets(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sheets")
    for name, text in SHEETS.items():
        (folder / name).write_text(text)
    with zipfile.ZipFile(folder / "packed.kmz", "w") as z:
        z.writestr("a.png", b"no")
        z.writestr("deep/other.kml", "<kml/>")
        z.writestr("doc.kml", SHEETS["named.kml"])
    (folder / "torn.kmz").write_bytes(b"PK\x03\x04 torn")
    return str(folder)


def test_sheets(spark, sheets):
    marks = kml.read_placemarks(spark, sheets)
    name = F.regexp_extract("path", "([^/]+)$", 1).alias("name")
    ways = {r.name: r.strategy for r in kml.heights(marks).select(name, "strategy").distinct().collect()}
    assert ways == {"z.kml": "z_coordinate", "data.kml": "extended_data", "named.kml": "placemark_name", "packed.kmz": "placemark_name", "folder.kml": "folder_name", "labels.kml": "placemark_name", "feet.kml": "placemark_name"}
    codes = {r.name: r.code for r in kml.problems(marks).select(name, "code").collect()}
    assert codes == {"bad.kml": "unparseable_xml", "torn.kmz": "unreadable_file", "broken.kml": "unparseable_geometry", "points.kml": "no_contours", "unlabelled.kml": "no_elevations", "single.kml": "too_few_levels"}
    made = {r.name: r for r in kml.sheet_summary(marks).select(name, "*").collect()}
    assert all(made[n].levels == [10, 20, 30] and made[n].n_vertices == 15 and made[n].interval == 10 for n in ("z.kml", "data.kml", "named.kml", "folder.kml", "packed.kmz"))
    assert made["feet.kml"].maybe_feet and not made["z.kml"].maybe_feet


def test_contour_length_leaves_out_jumps(spark):
    rows = [("a", 1, k, float(k), 0.0) for k in range(4)] + [("a", 2, k, 100.0 + k, 50.0) for k in range(3)]
    made = kml.contour_lengths(spark.createDataFrame(rows, "path string, line_id int, seq int, x double, y double"))
    assert made.first().length_m == 5.0


def png(rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[r].tobytes() for r in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_tiles_give_heights(spark, tmp_path):
    z = np.fromfunction(lambda r, c: 250 + 0.5 * c + 0.25 * r, (256, 256))
    whole = np.floor(z + 32768)
    rgb = np.stack([whole // 256, whole % 256, np.floor((z + 32768 - whole) * 256)], -1).astype(np.uint8)
    for root, tile, data in (("seed", "13/5950/3580", png(rgb)), ("cache", "13/5950/3580", png(rgb * 0)), ("cache", "13/5951/3580", png(rgb)), ("cache", "13/5952/3580", b"no image"), ("cache", "13/5953/3580", png(rgb[:9, :9]))):
        path = tmp_path / root / f"{tile}.png"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    tiles = raster_files.read_tiles(spark, str(tmp_path / "seed"), str(tmp_path / "cache"))
    pixels = raster_files.tile_heights(tiles)
    got = {(r.prow, r.pcol): r.z for r in pixels.where("prow % 64 = 3 and pcol % 64 = 7").collect()}
    assert len(got) == 2 * 16 and all(v == pytest.approx(z[p % 256, q % 256], abs=1 / 256) for (p, q), v in got.items())
    wanted = spark.createDataFrame([(13, x, 3580) for x in range(5950, 5954)], "zoom int, x long, y long")
    assert {r.source: r.n for r in raster_files.source_counts(tiles, wanted).collect()} == {0: 1, 1: 1, None: 2}
    assert raster_files.tile_colours(tiles).where("r < 0 or g > 1").count() == 0
    with pytest.raises(AnalysisError, match="more tiles"):
        raster_files.wanted_tiles(spark, (7, 45, 9, 47), 13)
    assert raster_files.wanted_tiles(spark, (8.2814, 46.2398, 8.3126, 46.2636), 13).count() in (1, 2, 4)


def test_a_missing_tile_is_answered_by_a_coarser_one(spark, tmp_path):
    z = np.fromfunction(lambda r, c: 300 + c + 2 * r, (256, 256))
    rgb = np.stack([(z + 32768) // 256, (z + 32768) % 256, z * 0], -1).astype(np.uint8)
    for tile in ("13/5950/3580", "12/2975/1790", "10/743/447"):
        path = tmp_path / f"{tile}.png"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png(rgb))
    tiles = raster_files.read_tiles(spark, str(tmp_path))
    wanted = spark.createDataFrame([(13, 5950, 3580), (13, 5951, 3581), (13, 5948, 3583), (13, 100, 100)], "zoom int, x long, y long")
    got = raster_files.answered(wanted, tiles)
    assert {(r.x, r.y): r.up for r in got.collect()} == {(5950, 3580): 0, (5951, 3581): 1, (5948, 3583): 3}
    heights = {(r.prow, r.pcol): r.z for r in raster_files.tile_heights(got).where("prow % 61 = 3 and pcol % 67 = 5").collect()}
    assert len(heights) > 20
    for (row, col), v in heights.items():
        up = {(5950, 3580): 0, (5951, 3581): 1, (5948, 3583): 3}[col // 256, row // 256]
        assert v == z[(row >> up) % 256, (col >> up) % 256]


def test_the_zoom_falls_until_the_tiles_are_few():
    box = (8.28, 46.24, 8.31, 46.26)
    assert raster_files.budget_zoom(box, 144) == 13 and raster_files.budget_zoom((7, 45, 9, 47), 144) < 13
    counts = [raster_files.budget_zoom((7, 45, 9, 47), n) for n in (1, 10, 100, 1000, 10**6)]
    assert counts == sorted(counts) and counts[0] == 8 and counts[-1] == 13


def test_bilinear_next_to_holes(spark):
    pixels = spark.createDataFrame([(r, c, None if (r, c) == (0, 0) else float(10 * r + c)) for r in range(4) for c in range(4)], "prow long, pcol long, z double")
    points = spark.createDataFrame([(0, 1.5, 2.25), (1, 0.5, 0.5), (2, 3.4, 3.0), (3, 3.6, 3.0), (4, 0.0, 1.0), (5, -0.4, 2.0)], "point_id int, prow double, pcol double")
    got = {r.point_id: r.height for r in rasters.bilinear(points, pixels).collect()}
    assert got == {0: 17.25, 1: None, 2: 33.0, 3: None, 4: 1.0, 5: 2.0}


def test_ascii_grid(spark, tmp_path):
    text = "ncols 3\nnrows 2\nxllcorner 8\nyllcorner 46\ncellsize 0.5\nNODATA_value -9\n1 2 3\n4 -9 6\n"
    (tmp_path / "g.asc").write_text(text)
    rows = {(r.lon, r.lat): r.z for r in raster_files.read_ascii_grids(spark, str(tmp_path)).collect()}
    assert rows[8.25, 46.75] == 1 and rows[8.75, 46.25] is None and rows[9.25, 46.25] == 6
    with pytest.raises(AnalysisError):
        raster_files.parse_ascii_grid(text.replace("nrows 2", "nrows 3"))


def test_rain_archive_and_stand_in(spark, tmp_path):
    body = {"latitude": 46.25, "longitude": 8.3, "daily": {"time": ["2014-01-01", "2014-01-02", "2015-03-01"], "precipitation_sum": [12.0, None, 0.4]}}
    (tmp_path / "rain.json").write_text(json.dumps(body, indent=1))
    rain = rainfall.read_rain(spark, str(tmp_path))
    assert [(r.place, str(r.day), r.mm) for r in rain.orderBy("day").collect()] == [("46.25,8.30", "2014-01-01", 12.0), ("46.25,8.30", "2014-01-02", 0.0), ("46.25,8.30", "2015-03-01", 0.4)]
    made = rainfall.climatology(spark)
    assert made.count() == 55 and made.agg(F.sum("mm")).first()[0] == pytest.approx(1200)
    assert rainfall.record_window(date(2024, 5, 1)) == (date(2014, 1, 1), date(2023, 12, 31))
    assert rainfall.first_of(None, rain, made, made).groupBy("place").count().count() == 2


def test_selections():
    ring = selection.from_bbox("8.2814,46.2398,8.3126,46.2636")
    assert selection.area_m2(ring, signed=True) > 0 and selection.check_size(ring) is ring
    assert selection.from_polygon([(0, 0), (0, 1), (1, 1), (1, 1), (0, 0)])[0] == (1, 1)
    assert selection.from_geojson({"type": "Feature", "geometry": selection.to_geojson(ring)}) == [(round(x, 6), round(y, 6)) for x, y in ring]
    for bad in ([1, 2, 3], [3, 1, 2, 4], [0, 0, float("nan"), 1]):
        with pytest.raises(AnalysisError):
            selection.from_bbox(bad)
    with pytest.raises(AnalysisError):
        selection.check_size(selection.from_bbox([8, 46, 9, 47]))
    west, south, east, north = projection.buffered((8.28, 46.24, 8.31, 46.26))
    assert west < 8.28 - 0.0074 and north > 46.26


def test_store(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "saved")
    keys = [store.save(spark, folder, f" site {k} ", "{}", created=float(k)) for k in range(4)]
    assert [r.id for r in store.listing(spark, folder, 2, 1).collect()] == [keys[2], keys[1]]
    assert store.delete(spark, folder, keys[3]) and not store.delete(spark, folder, keys[3])
    monkeypatch.setattr(store, "settings", config.made({}, layers={"most_saved": 2}))
    assert [r.name for r in store.listing(spark, folder).collect()] == ["site 2", "site 1"]


def test_settings_from_the_environment():
    made = config.made({"RILL_SITES_N_SITES": "5", "RILL_AREA_ENSEMBLE_STEPS": "8, 4"}, flow={"diagonal": 1.5})
    assert made.sites.n_sites == 5 and made.area.ensemble_steps == (8.0, 4.0) and made.flow.diagonal == 1.5 and made.sites.most_sites == 10


def test_scalar_rules(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    number = lambda t: (lambda n: n and (n.value, n.unit))(value(scalars.labelled_number(F.lit(t))))
    assert [number(t) for t in ("277.0", "270 m", "Elevation: 270 m", "contour-12", "contours_1.0m", "land", "-3 feet", "1e2'")] == [(277.0, None), (270.0, "m"), (270.0, "m"), None, None, None, (-3.0, "ft"), (100.0, "ft")]
    assert [round(value(scalars.retention_mm(F.lit(float(c)))), 3) for c in (75, 98)] == [84.667, 5.184]
    assert value(scalars.runoff_mm(F.lit(100.0), scalars.retention_mm(F.lit(75.0)))) == pytest.approx(41.14, abs=0.01)
    assert value(scalars.concentration_minutes(F.lit(4660.0), F.lit(19.7))) == pytest.approx(107, abs=1)
    assert [value(scalars.round_interval(F.lit(float(s)))) for s in (38, 3, 400, 1200, 0)] == [2.0, 0.5, 20.0, 50.0, 1.0]
    assert value(scalars.ramp_colour(F.lit(0.5))) == "#e08b1e" and value(scalars.ramp_colour(F.lit(9.0))) == "#ffd166"
    assert value(scalars.safe_stem(F.lit("a/b c?.kml"))) == "b_c_"
    assert value(scalars.height_from_z(F.array(F.lit(3.0), F.lit(3.5), F.lit(3.25)))) == 3.25
    assert value(scalars.height_from_z(F.array(F.lit(3.0), F.lit(5.0)))) is None
    ring = geometry.ring([(0, 0), (4, 0), (4, 3), (0, 3)])
    assert value(geometry.twice_area(ring)) == 24 and value(geometry.length(ring)) == 14
    assert value(geometry.inside(F.lit(1.0), F.lit(1.0), ring)) and not value(geometry.inside(F.lit(5.0), F.lit(1.0), ring))
    line = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0.0), (1, 0.1), (2, 0.0), (3, 2.0), (4, 0.0))))
    assert [p.x for p in value(geometry.simplify(line, F.lit(0.5)))] == [0, 2, 3, 4]
    zoom, left, top = projection.fit_view((8.28, 46.24, 8.31, 46.26), 1200, 900)
    world = 256 * 2**zoom
    assert 0 < zoom <= 18 and left / world < (8.28 + 180) / 360


def test_projection_round_trip(spark):
    frame = projection.LocalFrame(8.3, 46.25)
    rows = spark.range(50).select((F.col("id") * 0.01 + 8).alias("lon"), (F.col("id") * 0.01 + 46).alias("lat"))
    back = rows.select((frame.lon(frame.x(F.col("lon"))) - F.col("lon")).alias("a"), (projection.mercator_lat(projection.mercator_y(F.col("lat"))) - F.col("lat")).alias("b"))
    assert back.where("abs(a) > 1e-12 or abs(b) > 1e-10").count() == 0
    assert projection.fit_frame(rows).lon0 == pytest.approx(8.245)
    with pytest.raises(AnalysisError):
        projection.LocalFrame(0, 86)


def test_triangles_are_delaunay_and_tiles_do_not_matter(spark):
    rng = np.random.default_rng(3)
    xy = rng.random((300, 2)) * 1000
    tri = delaunay(xy)
    from rillflow.operators.triangulate import _circles

    c = _circles(xy, tri)
    assert all(((xy - k[:2]) ** 2).sum(1).min() >= k[2] * (1 - 1e-9) for k in c)
    points = spark.createDataFrame([(float(x), float(y), float(2 * x - y + 5)) for x, y in xy], "x double, y double, z double")
    cells = spark.range(400).select(F.col("id").alias("cell"), (F.col("id") % 20 * 50 + 20).alias("x"), (F.floor(F.col("id") / 20) * 50 + 20).alias("y"))
    made = {t: {r.cell: r.z for r in triangulated(cells, points, t).collect()} for t in (200.0, 5000.0)}
    assert {k for k, v in made[200.0].items() if v is None} == {k for k, v in made[5000.0].items() if v is None}
    for cell, z in made[200.0].items():
        assert z is None or z == pytest.approx(2 * (cell % 20 * 50 + 20) - (cell // 20 * 50 + 20) + 5)
    assert sum(v is not None for v in made[200.0].values()) > 300


def test_streamed_rain(spark, tmp_path):
    rows = [("a", f"2024-01-0{d} 0{h}:00:00", 30.0) for d in (1, 2) for h in (1, 5)] + [("a", "2024-01-09 00:00:00", 0.2)]
    source = spark.createDataFrame(rows, "place string, ts string, mm double").selectExpr("place", "to_timestamp(ts) as ts", "mm")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = daily_runoff(stream).writeStream.outputMode("complete").format("memory").queryName("streamed_rain").start()
    q.processAllAvailable()
    q.stop()
    got = {str(r.day): (r.mm, round(r.runoff_mm, 3)) for r in spark.table("streamed_rain").collect()}
    e = 60 - 0.2 * (25400 / 75 - 254)
    assert got["2024-01-01"] == (60.0, round(e * e / (e + 25400 / 75 - 254), 3)) and got["2024-01-09"][1] == 0
    assert math.isclose(got["2024-01-02"][0], 60.0)
