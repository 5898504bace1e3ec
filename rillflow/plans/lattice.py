"""The driver's tables read as lattices, rain records and rasters; the SQL of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projection import Grid, LocalFrame

COLS = 40
GRID = Grid(LocalFrame(8.3, 46.25), 10.0, COLS)

#: A dense lattice with a trend, ridges and pits; cells whose size is 13 are gaps where asked for.
LATTICE_SQL = """lat AS (
  SELECT 0 AS grid_id, CAST(p_partkey // 40 AS INTEGER) AS row, CAST(p_partkey % 40 AS INTEGER) AS col, p_partkey AS cell,
    (p_retailprice - 900) + 0.1 * p_size AS z FROM part
)"""
GAPPY_SQL = LATTICE_SQL.replace("(p_retailprice - 900) + 0.1 * p_size AS z", "CASE WHEN p_size = 13 THEN NULL ELSE (p_retailprice - 900) + 0.1 * p_size END AS z")
RAIN_SQL = "rain AS (SELECT o_orderpriority AS place, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice) / 20000, 3) AS mm FROM orders GROUP BY 1, 2)"
AREA_SQL = "(100.0 * cos(radians(46.25 + row * 10.0 / 110540.0)) / cos(radians(46.25)))"
D8_SQL = """offs(dr, dc, rank) AS (VALUES (-1, -1, 0), (-1, 0, 1), (-1, 1, 2), (0, -1, 3), (0, 1, 4), (1, -1, 5), (1, 0, 6), (1, 1, 7)),
drops AS (
  SELECT a.cell, b.cell AS receiver, rank, (a.z - b.z) / (10.0 * CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0) ELSE 1.0 END) AS g
  FROM lat a, offs, lat b WHERE b.row = a.row + dr AND b.col = a.col + dc
),
best AS (SELECT cell, receiver, g FROM drops WHERE g > 0 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY g DESC, rank) = 1),
d8 AS (SELECT lat.cell, row, col, z, receiver, g FROM lat LEFT JOIN best USING (cell) WHERE z IS NOT NULL),
walk(cell, loc, straight, diagonal) AS (
  SELECT cell, cell, 0, 0 FROM d8
  UNION ALL
  SELECT w.cell, d.receiver,
    straight + CASE WHEN d.cell // 40 <> d.receiver // 40 AND d.cell % 40 <> d.receiver % 40 THEN 0 ELSE 1 END,
    diagonal + CASE WHEN d.cell // 40 <> d.receiver // 40 AND d.cell % 40 <> d.receiver % 40 THEN 1 ELSE 0 END
  FROM walk w JOIN d8 d ON d.cell = w.loc WHERE d.receiver IS NOT NULL
),
acc AS (SELECT loc AS cell, count(*) AS n FROM walk GROUP BY loc)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    z = (F.col("p_retailprice") - 900) + 0.1 * F.col("p_size")
    return part.select(
        F.lit(0).alias("grid_id"), F.expr(f"cast(p_partkey div {COLS} as int)").alias("row"), F.expr(f"cast(p_partkey % {COLS} as int)").alias("col"),
        F.col("p_partkey").alias("cell"), (F.when(F.col("p_size") != 13, z) if gaps else z).alias("z"),
    )


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("place"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice") / 20000, 3).alias("mm"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour raster from the first three coordinates of the vectors, laid out 20 to a row."""
    e = table(spark, sf_dir, "embeddings")
    band = lambda k: F.least(F.greatest(F.round(F.get("embedding", k).cast("double") + 0.5, 4), F.lit(0.0)), F.lit(1.0))
    return e.select(F.lit(0).alias("grid_id"), F.expr("cast(vec_id div 20 as int)").alias("row"), F.expr("cast(vec_id % 20 as int)").alias("col"), band(0).alias("r"), band(1).alias("g"), band(2).alias("b"))
