"""Daily rain from saved archive answers, or a stand-in where there is none."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import settings

PAYLOAD = "latitude double, longitude double, daily struct<time: array<string>, precipitation_sum: array<double>>"


def read_rain(spark: SparkSession, path: str) -> DataFrame:
    """(place, day, mm) of JSON answers with parallel arrays of days and depths; a null depth is a dry day."""
    p = settings.rain.decimals
    answers = spark.read.schema(PAYLOAD).option("multiLine", True).json(path)
    place = F.concat_ws(",", F.format_number(F.round("latitude", p), p), F.format_number(F.round("longitude", p), p))
    days = answers.select(place.alias("place"), F.inline(F.arrays_zip(F.col("daily.time").alias("time"), F.col("daily.precipitation_sum").alias("mm"))))
    return days.select("place", F.to_date("time").alias("day"), F.coalesce("mm", F.lit(0.0)).alias("mm"))


def record_window(today: date | None = None, years: int | None = None) -> tuple[date, date]:
    """First and last day of the last complete calendar years."""
    n = settings.rain.years if years is None else years
    last = (today or date.today()).year - 1
    return date(last - n + 1, 1, 1), date(last, 12, 31)


def in_window(day: Column, today: date | None = None) -> Column:
    first, last = record_window(today)
    return day.between(F.lit(first), F.lit(last))


def climatology(spark: SparkSession, place: str = "climatology", annual_mm: float | None = None, rain_days: int | None = None, year: int = 2024) -> DataFrame:
    """(place, day, mm): one year of wet days drawn from a gamma distribution and scaled to an exact yearly total."""
    h = settings.water
    n = h.year_days if rain_days is None else rain_days
    total = h.year_mm if annual_mm is None else annual_mm
    drawn = np.random.default_rng(h.day_seed).gamma(h.day_shape, 1.0, n)
    depths = drawn * (total / drawn.sum())
    rows = [(place, float(mm), k) for k, mm in enumerate(depths)]  # one row for each of at most 366 days
    return spark.createDataFrame(rows, "place string, mm double, k int").select("place", F.date_add(F.lit(date(year, 1, 1)), F.col("k")).alias("day"), "mm")


def first_of(*sources: DataFrame | None) -> DataFrame:
    """Rain of each place from the first source that knows it."""
    known = [s for s in sources if s is not None]
    out = known[0]
    for s in known[1:]:
        out = out.unionByName(s.join(out.select("place").distinct(), "place", "left_anti"))
    return out
