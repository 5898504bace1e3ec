"""Convex hulls of any number of points: each task keeps the hull of its own, and hulls of hulls are exact."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners counter-clockwise, by the monotone chain."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(order: Iterator[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(iter(points)) + half(reversed(points))


def convex_hulls(points: DataFrame, key: str = "path") -> DataFrame:
    """(key, x, y, nth, hull_m2) of points (key, x, y): corners in order, with the area they enclose."""
    kind = points.schema[key].dataType.simpleString()

    def corners(k: Any, pdf: pd.DataFrame) -> pd.DataFrame:
        made = hull(list(zip(pdf["x"], pdf["y"], strict=True)))
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(made, [*made[1:], made[0]], strict=True))) / 2
        return pd.DataFrame({key: k[0], "x": [p[0] for p in made], "y": [p[1] for p in made], "nth": range(len(made)), "hull_m2": area})

    schema = f"`{key}` {kind}, x double, y double, nth long, hull_m2 double"
    dealt = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("bucket", F.pmod(F.xxhash64("x", "y"), F.lit(BUCKETS)))
    partial = dealt.groupBy(key, "bucket").applyInPandas(corners, schema)
    return partial.select(key, "x", "y").groupBy(key).applyInPandas(corners, schema)
