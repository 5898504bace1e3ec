"""How fine a grid to make: small rules on the driver over one-row aggregates."""

from __future__ import annotations

import math

from ..config import settings
from ..errors import AnalysisError


def sheet_resolution(spacing_m: float, area_m2: float, requested: float | None = None) -> tuple[float, str, list[str]]:
    """(metres, where it comes from, warnings) for a contour sheet with so many metres between its lines."""
    s, warnings = settings.sheet, []
    if requested is not None:
        if not requested > 0 or not math.isfinite(requested):
            raise AnalysisError("invalid_resolution", "A resolution is a positive number of metres.")
        resolution, source = float(requested), "requested"
        if resolution > spacing_m:
            warnings.append(f"{resolution:g} m is coarser than the {spacing_m:.1f} m between contours.")
    else:
        wished = spacing_m / s.cells_per_spacing
        resolution, source = min(max(wished, s.finest_m), s.coarsest_m), "derived"
        if resolution != wished:
            source = "clamped"
    for _ in range(8):
        cells = area_m2 / resolution**2
        if cells <= s.most_cells:
            break
        resolution *= math.sqrt(cells / s.most_cells) * 1.001
        source = "coarsened"
    else:
        raise AnalysisError("sheet_too_large", "The sheet needs more cells than allowed.", status=413)
    if source == "coarsened":
        warnings.append(f"The grid was coarsened to {resolution:.2f} m to stay within {s.most_cells} cells.")
    return resolution, source, warnings


def area_resolution(native_m: float, area_m2: float, requested: float | None = None) -> tuple[float, str, list[str]]:
    """The same for an area over an elevation raster with pixels of ``native_m``."""
    e, warnings = settings.area, []
    floor = max(native_m, math.sqrt(area_m2 / e.wished_cells), e.finest_m)
    if requested is None:
        return min(floor, e.coarsest_m), "derived", warnings
    if not e.finest_m <= requested <= e.coarsest_m:
        raise AnalysisError("invalid_resolution", f"A resolution lies between {e.finest_m:g} and {e.coarsest_m:g} m.")
    if requested < floor:
        warnings.append(f"{requested:g} m is finer than the source; {floor:.1f} m is used.")
        return floor, "coarsened", warnings
    return float(requested), "requested", warnings


def ensemble_resolutions(resolution_m: float, area_m2: float) -> list[float]:
    """Resolutions around the one in use, none with more cells than an ensemble may have."""
    e = settings.area
    least = math.sqrt(area_m2 / e.ensemble_cells)
    made = [min(max(resolution_m * f, least, e.finest_m), e.coarsest_m) for f in e.ensemble_steps]
    return list(dict.fromkeys(round(m, 3) for m in made))
