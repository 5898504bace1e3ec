"""Elevation tiles, imagery tiles and ASCII grids as DataFrames of pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import settings
from ..errors import AnalysisError
from ..functions import projection

TILE = projection.TILE_PX


def budget_zoom(bbox: tuple[float, float, float, float], most_tiles: int, finest: int | None = None, coarsest: int | None = None) -> int:
    """The finest zoom at which a box needs at most so many tiles, or the coarsest allowed."""
    finest = settings.area.finest_zoom if finest is None else finest
    coarsest = settings.area.coarsest_zoom if coarsest is None else coarsest
    west, south, east, north = bbox
    down = lambda lat: 0.5 - math.asinh(math.tan(math.radians(lat))) / (2 * math.pi)
    for zoom in range(finest, coarsest, -1):
        n = 2**zoom
        across = math.floor((east + 180) / 360 * n) - math.floor((west + 180) / 360 * n) + 1
        if across * (math.floor(down(south) * n) - math.floor(down(north) * n) + 1) <= most_tiles:
            return zoom
    return coarsest


def answered(wanted: DataFrame, tiles: DataFrame, coarsest: int | None = None) -> DataFrame:
    """(zoom, x, y, source, channels, data, up) of the wanted tiles (zoom, x, y): the tile itself, or the nearest of those that hold it at coarser zooms.

    ``up`` counts the zooms between. A tile of which no coarser one is there either has no row.
    Candidates meet the tiles by an equi-join on their own addresses; the bytes are joined
    only to the one that is chosen.
    """
    coarsest = settings.area.coarsest_zoom if coarsest is None else coarsest
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("zoom") - coarsest))
    tried = wanted.select("zoom", "x", "y", F.explode(steps).alias("up")).select("zoom", "x", "y", "up", (F.col("zoom") - F.col("up")).alias("at_zoom"), F.expr("shiftright(x, up)").alias("at_x"), F.expr("shiftright(y, up)").alias("at_y"))
    there = tiles.select(F.col("zoom").alias("at_zoom"), F.col("x").alias("at_x"), F.col("y").alias("at_y"))
    near = tried.join(there, ["at_zoom", "at_x", "at_y"], "left_semi").groupBy("zoom", "x", "y").agg(F.min("up").alias("up"))
    held = tiles.select(F.col("zoom").alias("at_zoom"), F.col("x").alias("at_x"), F.col("y").alias("at_y"), "source", "channels", "data")
    chosen = near.withColumn("at_zoom", F.col("zoom") - F.col("up")).withColumn("at_x", F.expr("shiftright(x, up)")).withColumn("at_y", F.expr("shiftright(y, up)"))
    return chosen.join(held, ["at_zoom", "at_x", "at_y"]).select("zoom", "x", "y", "source", "channels", "data", "up")


def wanted_tiles(spark: SparkSession, bbox: tuple[float, float, float, float], zoom: int) -> DataFrame:
    """(zoom, x, y) of the tiles that cover a box; refuses a box that needs more than allowed."""
    west, south, east, north = (F.lit(float(v)) for v in bbox)
    span = spark.range(1).select(
        projection.tile_index(projection.mercator_x(west), zoom).alias("x0"), projection.tile_index(projection.mercator_x(east), zoom).alias("x1"),
        projection.tile_index(projection.mercator_y(north), zoom).alias("y0"), projection.tile_index(projection.mercator_y(south), zoom).alias("y1"),
    )
    row = span.first()
    if (row.x1 - row.x0 + 1) * (row.y1 - row.y0 + 1) > settings.area.most_tiles:
        raise AnalysisError("aoi_too_large", "The area needs more tiles than allowed at this zoom.")
    xs = span.select("y0", "y1", F.explode(F.sequence("x0", "x1")).alias("x"))
    return xs.select(F.lit(zoom).alias("zoom"), "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def read_tiles(spark: SparkSession, *roots: str) -> DataFrame:
    """(zoom, x, y, source, width, height, data): PNG tiles at ``<root>/<zoom>/<x>/<y>.png``; of equal tiles that of the first root stays.

    Spark's image source decodes them; files that are no images drop out.
    """
    parts = []
    for rank, root in enumerate(roots):
        images = spark.read.format("image").option("dropInvalid", True).load(f"{root}/*/*/*.png")
        place = F.regexp_extract("image.origin", r"(\d+)/(\d+)/(\d+)\.png$", 0)
        bits = F.split(F.regexp_replace(place, r"\.png$", ""), "/")
        parts.append(images.select(bits[0].cast("int").alias("zoom"), bits[1].cast("long").alias("x"), bits[2].cast("long").alias("y"), F.lit(rank).alias("source"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    whole = every.where((F.col("width") == TILE) & (F.col("height") == TILE) & (F.col("channels") >= 3))
    best = whole.groupBy("zoom", "x", "y").agg(F.min_by(F.struct("source", "channels", "data"), "source").alias("t"))
    return best.select("zoom", "x", "y", "t.source", "t.channels", "t.data")


def _pixels(tiles: DataFrame, columns: list[tuple[str, str]], of) -> DataFrame:
    """Explodes tiles to pixels addressed on the whole map; the source's bytes are in blue, green, red order.

    A tile that a coarser one answers (``up`` above 0) gets that one's part, each pixel as often as it covers pixels of the tile.
    """
    up = F.col("up") if "up" in tiles.columns else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.arange(TILE * TILE)
        for b in batches:
            for zoom, x, y, channels, data, n_up in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                row = ((y * TILE + inside // TILE) >> n_up) - (y >> n_up) * TILE
                col = ((x * TILE + inside % TILE) >> n_up) - (x >> n_up) * TILE
                bgr = np.frombuffer(data, np.uint8).reshape(-1, channels)[row * TILE + col, :3].astype(np.float32)
                made = of(bgr[:, 2], bgr[:, 1], bgr[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(TILE * TILE, zoom, np.int32)), pa.array(y * TILE + inside // TILE), pa.array(x * TILE + inside % TILE), *(pa.array(m) for m in made)], names=["zoom", "prow", "pcol", *(c for c, _ in columns)])

    return tiles.select("zoom", "x", "y", "channels", "data", up.cast("int").alias("up")).mapInArrow(run, "zoom int, prow long, pcol long, " + ", ".join(f"{c} {t}" for c, t in columns))


def tile_heights(tiles: DataFrame) -> DataFrame:
    """(zoom, prow, pcol, z): heights coded in three colour bytes, rows from north to south."""
    return _pixels(tiles, [("z", "float")], lambda r, g, b: (r * np.float32(256) + g + b / np.float32(256) - np.float32(32768),))


def tile_colours(tiles: DataFrame) -> DataFrame:
    """(zoom, prow, pcol, r, g, b) between 0 and 1."""
    return _pixels(tiles, [("r", "float"), ("g", "float"), ("b", "float")], lambda r, g, b: (r / np.float32(255), g / np.float32(255), b / np.float32(255)))


def source_counts(tiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, n): how many wanted tiles each root gave; null for those that none had."""
    return wanted.join(tiles.select("zoom", "x", "y", "source"), ["zoom", "x", "y"], "left").groupBy("source").agg(F.count("*").alias("n"))


def lattice_places(cells: DataFrame, grid: projection.Grid, zoom: int) -> DataFrame:
    """(point_id, prow, pcol): where the cells of a grid lie among the pixels of a zoom."""
    lon, lat = grid.lon(F.col("col")), grid.lat(F.col("row"))
    return cells.select(F.col("cell").alias("point_id"), projection.tile_pixel(projection.mercator_y(lat), zoom).alias("prow"), projection.tile_pixel(projection.mercator_x(lon), zoom).alias("pcol"))


def parse_ascii_grid(text: str) -> tuple[dict[str, float], np.ndarray]:
    """Header and values of an ASCII grid, rows from north to south, NaN where there is no data."""
    lines = text.splitlines()
    header: dict[str, float] = {}
    while lines and len(header) < 7 and len(parts := lines[0].split()) == 2 and not parts[0].lstrip("-").replace(".", "").isdigit():
        header[parts[0].lower()] = float(parts[1])
        lines.pop(0)
    try:
        cell, shape = header["cellsize"], (int(header["nrows"]), int(header["ncols"]))
    except KeyError as e:
        raise AnalysisError("elevation_unavailable", f"The grid has no {e.args[0]}.", status=503) from None
    values = np.array(" ".join(lines).split(), float)
    if values.size != shape[0] * shape[1]:
        raise AnalysisError("elevation_unavailable", "The grid's rows don't fit its header.", status=503)
    for axis in "xy":
        header.setdefault(f"{axis}llcenter", header.get(f"{axis}llcorner", 0.0) + cell / 2)
    values[values == header.get("nodata_value", -9999.0)] = np.nan
    return header, values.reshape(shape)


def read_ascii_grids(spark: SparkSession, path: str) -> DataFrame:
    """(path, prow, pcol, lon, lat, z) of all grids under a path; a file that is no grid fails the read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head, z = parse_ascii_grid(text)
                for row in range(z.shape[0]):
                    n = z.shape[1]
                    lat = head["yllcenter"] + (z.shape[0] - 1 - row) * head["cellsize"]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.full(n, row)), pa.array(np.arange(n)), pa.array(head["xllcenter"] + np.arange(n) * head["cellsize"]), pa.array(np.full(n, lat)), pa.array(z[row], mask=np.isnan(z[row]))], names=["path", "prow", "pcol", "lon", "lat", "z"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInArrow(run, "path string, prow long, pcol long, lon double, lat double, z double")
