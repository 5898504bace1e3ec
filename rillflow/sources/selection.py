"""Areas that a caller selects: boxes, polygons and GeoJSON, checked on the driver."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from ..config import settings
from ..errors import AnalysisError
from ..functions.projection import LocalFrame

Ring = list[tuple[float, float]]


def _invalid(why: str) -> AnalysisError:
    return AnalysisError("invalid_aoi", why, "Give longitude before latitude, in degrees.")


def from_bbox(bbox: Sequence[float] | str) -> Ring:
    """A box given as west, south, east, north, or as text of four numbers."""
    try:
        values = [float(v) for v in (json.loads(bbox) if bbox.strip().startswith("[") else bbox.split(","))] if isinstance(bbox, str) else [float(v) for v in bbox]
    except ValueError:
        raise _invalid("A box is four numbers.") from None
    if len(values) != 4 or not all(map(math.isfinite, values)):
        raise _invalid("A box is four numbers.")
    west, south, east, north = values
    if west >= east or south >= north:
        raise _invalid("A box runs from south-west to north-east.")
    return from_polygon([(west, south), (east, south), (east, north), (west, north)])


def from_polygon(points: Sequence[Sequence[float]]) -> Ring:
    """An open ring, counter-clockwise, without repeated corners."""
    ring: Ring = []
    for p in points:
        if len(p) < 2 or not all(math.isfinite(v) for v in p[:2]) or abs(p[0]) > 180 or abs(p[1]) > 85:
            raise _invalid("A corner is a longitude and a latitude.")
        corner = (float(p[0]), float(p[1]))
        if not ring or ring[-1] != corner:
            ring.append(corner)
    if len(ring) > 1 and ring[0] == ring[-1]:
        ring.pop()
    if not 3 <= len(ring) <= 2000:
        raise _invalid("A polygon has between 3 and 2000 corners.")
    return ring if area_m2(ring, signed=True) > 0 else ring[::-1]


def from_geojson(shape: str | dict) -> Ring:
    """The exterior of a GeoJSON polygon, or of a feature that is one."""
    made = json.loads(shape) if isinstance(shape, str) else shape
    made = made.get("geometry") if made.get("type") == "Feature" else made
    if not made or made.get("type") != "Polygon" or not made.get("coordinates"):
        raise _invalid("Only polygons can be selected.")
    return from_polygon(made["coordinates"][0])


def bbox_of(ring: Ring) -> tuple[float, float, float, float]:
    xs, ys = zip(*ring, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def union_of(a: Sequence[float], b: Sequence[float]) -> tuple[float, float, float, float]:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def area_m2(ring: Ring, signed: bool = False) -> float:
    west, south, east, north = bbox_of(ring)
    f = LocalFrame((west + east) / 2, (south + north) / 2)
    xy = [((lon - f.lon0) * f.metres_per_lon, (lat - f.lat0) * f.metres_per_lat) for lon, lat in ring]
    twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(xy, [*xy[1:], xy[0]], strict=True))
    return twice / 2 if signed else abs(twice) / 2


def check_size(ring: Ring) -> Ring:
    e = settings.area
    area = area_m2(ring)
    if area > e.largest_km2 * 1e6:
        raise AnalysisError("aoi_too_large", f"The area is {area / 1e6:.1f} square kilometres; at most {e.largest_km2:g} are analysed.")
    if area < e.smallest_ha * 1e4:
        raise AnalysisError("aoi_too_small", f"The area is {area / 1e4:.2f} hectares; at least {e.smallest_ha:g} are needed.")
    return ring


def to_geojson(ring: Ring) -> dict:
    digits = settings.layers.decimals
    return {"type": "Polygon", "coordinates": [[[round(x, digits), round(y, digits)] for x, y in [*ring, ring[0]]]]}
