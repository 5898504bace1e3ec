"""Rain as it comes in: runoff by day from a stream of readings.

Late readings are kept back to a watermark, so the state holds days of that span only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import settings
from ..functions import scalars


def daily_runoff(readings: DataFrame, curve_number: float | None = None, late: str = "2 days") -> DataFrame:
    """(place, day, mm, runoff_mm) of a stream of readings (place, ts, mm)."""
    cn = settings.water.curve_number if curve_number is None else float(curve_number)
    days = readings.withWatermark("ts", late).groupBy("place", F.window("ts", "1 day").alias("span")).agg(F.sum("mm").alias("mm"))
    wet = F.when(F.col("mm") >= settings.rain.wet_mm, F.col("mm")).otherwise(0.0)
    return days.select("place", F.to_date("span.start").alias("day"), "mm", scalars.runoff_mm(wet, scalars.retention_mm(F.lit(cn))).alias("runoff_mm"))
