"""Saved analyses in a folder of Parquet files: one file for each, so that saving never rewrites what is there.

Deleting writes a mark; a listing leaves out marked analyses and, past the limit, the oldest.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import settings

SCHEMA = "id string, name string, notes string, created double, summary string, body string, deleted boolean"


def save(spark: SparkSession, folder: str, name: str, body: str, summary: str = "{}", notes: str = "", created: float | None = None) -> str:
    """Appends one analysis and returns its id."""
    key = uuid.uuid4().hex[:12]
    row = (key, (name.strip() or "Untitled")[: settings.layers.longest_name], notes[:2000], time.time() if created is None else created, summary, body, False)
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return key


def delete(spark: SparkSession, folder: str, key: str) -> bool:
    """Marks an analysis as deleted; false if there is none."""
    if not saved(spark, folder).where(F.col("id") == key).limit(1).count():
        return False
    spark.createDataFrame([(key, None, None, time.time(), None, None, True)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return True


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """Analyses that are neither deleted nor pushed out by newer ones."""
    rows = spark.read.schema(SCHEMA).parquet(folder)
    alive = rows.where("not deleted").join(rows.where("deleted").select("id"), "id", "left_anti")
    newest = alive.orderBy(F.desc("created"), "id").limit(settings.layers.most_saved)
    return newest.drop("deleted")


def listing(spark: SparkSession, folder: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of analyses without their bodies, the newest first."""
    return saved(spark, folder).drop("body").orderBy(F.desc("created"), "id").offset(offset).limit(max(1, min(500, limit)))
