"""Projections and grid coordinates as column expressions: nothing here shuffles or leaves the JVM."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import settings
from ..errors import AnalysisError

EARTH_RADIUS_M = 6378137.0
TILE_PX = 256
MERCATOR_MAX_LAT = 85.05112878


@dataclass(frozen=True)
class LocalFrame:
    """Equirectangular metres east and north of an origin; exactly invertible."""

    lon0: float
    lat0: float

    def __post_init__(self):
        if abs(self.lat0) > 85:
            raise AnalysisError("origin_out_of_range", "A frame needs an origin within 85 degrees of the equator.")

    @property
    def metres_per_lon(self) -> float:
        return settings.earth.lon_m * math.cos(math.radians(self.lat0))

    @property
    def metres_per_lat(self) -> float:
        return settings.earth.lat_m

    def x(self, lon: Column) -> Column:
        return (lon - F.lit(self.lon0)) * F.lit(self.metres_per_lon)

    def y(self, lat: Column) -> Column:
        return (lat - F.lit(self.lat0)) * F.lit(self.metres_per_lat)

    def lon(self, x: Column) -> Column:
        return F.lit(self.lon0) + x / F.lit(self.metres_per_lon)

    def lat(self, y: Column) -> Column:
        return F.lit(self.lat0) + y / F.lit(self.metres_per_lat)

    def area_factor(self, lat: Column) -> Column:
        return F.cos(F.radians(lat)) / F.lit(math.cos(math.radians(self.lat0)))


def fit_frame(points: DataFrame, lon: str = "lon", lat: str = "lat") -> LocalFrame:
    """Frame about the centre of the bounding box."""
    row = points.agg(((F.min(lon) + F.max(lon)) / 2).alias("lon"), ((F.min(lat) + F.max(lat)) / 2).alias("lat")).first()
    if row is None or row.lon is None:
        raise AnalysisError("no_geometry", "There are no points to fit a frame to.")
    return LocalFrame(row.lon, row.lat)


@dataclass(frozen=True)
class Grid:
    """A lattice of square cells; row 0 is the south edge, positions are cell centres."""

    frame: LocalFrame
    resolution_m: float
    n_cols: int
    x0: float = 0.0
    y0: float = 0.0
    spacing_m: float = 40.0
    interval_m: float = 1.0

    def x(self, col: Column) -> Column:
        return F.lit(self.x0) + col * F.lit(self.resolution_m)

    def y(self, row: Column) -> Column:
        return F.lit(self.y0) + row * F.lit(self.resolution_m)

    def lon(self, col: Column) -> Column:
        return self.frame.lon(self.x(col))

    def lat(self, row: Column) -> Column:
        return self.frame.lat(self.y(row))

    def col(self, x: Column) -> Column:
        """Nearest column; a tie goes to the even one."""
        return F.rint((x - F.lit(self.x0)) / F.lit(self.resolution_m)).cast("int")

    def row(self, y: Column) -> Column:
        return F.rint((y - F.lit(self.y0)) / F.lit(self.resolution_m)).cast("int")

    def cell(self, row: Column, col: Column) -> Column:
        return row.cast("long") * self.n_cols + col

    def cell_area(self, row: Column) -> Column:
        """Ground area of a cell of the row in square metres."""
        return F.lit(self.resolution_m**2) * self.frame.area_factor(self.lat(row))


def mercator_x(lon: Column) -> Column:
    """Place on the unit square of web maps, eastward."""
    return (lon + 180.0) / 360.0


def mercator_y(lat: Column) -> Column:
    """Place on the unit square of web maps, southward."""
    s = F.sin(F.radians(F.least(F.greatest(lat, F.lit(-MERCATOR_MAX_LAT)), F.lit(MERCATOR_MAX_LAT))))
    return F.lit(0.5) - F.log((1 + s) / (1 - s)) / F.lit(4 * math.pi)


def mercator_lon(fx: Column) -> Column:
    return fx * 360.0 - 180.0


def mercator_lat(fy: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * fy))))


def tile_index(f: Column, zoom: Column | int) -> Column:
    """Index of the tile at a place on the unit square, clamped to the map."""
    n = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    return F.least(F.greatest(F.floor(f * n), F.lit(0)), (n - 1).cast("long")).cast("long")


def tile_resolution(zoom: Column | int, lat: Column) -> Column:
    """Metres that one pixel of a tile covers at a latitude."""
    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    return F.lit(2 * math.pi * EARTH_RADIUS_M) * F.cos(F.radians(lat)) / (F.lit(float(TILE_PX)) * F.pow(F.lit(2.0), z))


def zoom_for(resolution_m: Column, lat: Column) -> Column:
    """Coarsest zoom whose pixels are no larger than asked for, within the source's range."""
    e = settings.area
    need = F.ceil(F.log2(tile_resolution(0, lat) / resolution_m) - 1e-9)
    return F.least(F.greatest(need, F.lit(e.coarsest_zoom)), F.lit(e.finest_zoom)).cast("int")


def tile_pixel(f: Column, zoom: int) -> Column:
    """Fractional pixel index on the whole map; pixel centres are integers."""
    return f * F.lit(float(TILE_PX * 2**zoom)) - 0.5


def buffered(bbox: tuple[float, float, float, float], fraction: float | None = None, min_buffer_m: float | None = None) -> tuple[float, float, float, float]:
    """A box grown on each side by a share of its span, at least by so many metres."""
    fraction = settings.area.margin_share if fraction is None else fraction
    least = settings.area.margin_m if min_buffer_m is None else min_buffer_m
    west, south, east, north = bbox
    frame = LocalFrame((west + east) / 2, (south + north) / 2)
    dx = max((east - west) * fraction, least / frame.metres_per_lon)
    dy = max((north - south) * fraction, least / frame.metres_per_lat)
    return west - dx, south - dy, east + dx, north + dy


def ground_span(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Metres from west to east of a box, along its middle latitude."""
    return F.abs(east - west) * settings.earth.lon_m * F.cos(F.radians((south + north) / 2))


def fit_view(bbox: tuple[float, float, float, float], width: int, height: int, padding: int = 40, max_zoom: float = 18.0) -> tuple[float, float, float]:
    """(zoom, left, top): fractional zoom at which the box fills the padded canvas, and the canvas corner in world pixels."""

    def my(lat: float) -> float:
        s = math.sin(math.radians(max(-MERCATOR_MAX_LAT, min(MERCATOR_MAX_LAT, lat))))
        return 0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)

    west, south, east, north = bbox
    x0, x1, y0, y1 = (west + 180) / 360, (east + 180) / 360, my(north), my(south)
    span = max((x1 - x0) * TILE_PX / max(1, width - 2 * padding), (y1 - y0) * TILE_PX / max(1, height - 2 * padding), 1e-12)
    zoom = min(max_zoom, -math.log2(span))
    world = TILE_PX * 2**zoom
    return zoom, (x0 + x1) / 2 * world - width / 2, (y0 + y1) / 2 * world - height / 2
