"""Masks as row spans: (grid_id, site, row, first, last) instead of a row for each cell.

A span is a run of columns of one row of a mask, both ends included. In a normal form the
spans of a mask neither overlap nor touch. Set operations sweep over the ends of spans in a
row, and pairs of masks meet by blocks of columns, so a mask of a million cells costs as
many rows as it has runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.projection import Grid

MASK = ["grid_id", "site"]
#: Columns in a block by which spans of two masks meet.
BLOCK = 64


def from_cells(cells: DataFrame) -> DataFrame:
    """The spans of masks given as cells (grid_id, site, row, col); a cell given twice counts once, one without a place not at all."""
    known = cells.where("row IS NOT NULL AND col IS NOT NULL")
    return merged(known.select(*MASK, "row", F.col("col").alias("first"), F.col("col").alias("last")))


def to_cells(spans: DataFrame) -> DataFrame:
    """(grid_id, site, row, col): every cell of the masks once."""
    return merged(spans).select(*MASK, "row", F.explode(F.sequence("first", "last")).alias("col"))


def dealt(spans: DataFrame) -> DataFrame:
    """The same rows in as many tasks as shuffles have; left to itself Spark puts them into few, by packed bytes that are a small part of what a sort holds."""
    return spans.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), *MASK, "row")


def merged(spans: DataFrame) -> DataFrame:
    """The normal form of spans that may overlap, touch or repeat; a span that ends before it begins holds nothing.

    A run ends where the spans before the next run have reached, the last one where all have:
    one sort, and nothing is gathered.
    """
    order = W.partitionBy(*MASK, "row").orderBy("first", "last")
    real = spans.select(*MASK, "row", "first", "last").where("last >= first")
    swept = dealt(real).withColumn("reached", F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("end", F.max("last").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    opened = swept.where(F.col("reached").isNull() | (F.col("reached") < F.col("first") - 1))
    return opened.select(*MASK, "row", "first", F.coalesce(F.lead("reached").over(order), "end").alias("last"))


def combined(a: DataFrame, b: DataFrame, keep: Column) -> DataFrame:
    """The spans where ``keep`` holds, a condition on the booleans ``in_a`` and ``in_b``, for masks of one grid and site.

    Every span gives two ends. Between two ends that follow one another in a row nothing
    changes, so sums over the ends before tell which masks hold the columns between. Outside
    all spans ``keep`` must be false.
    """
    ends = None
    for df, da, db in ((a, 1, 0), (b, 0, 1)):
        real = df.where("last >= first")
        for at, sign in ((F.col("first"), 1), (F.col("last") + 1, -1)):
            part = real.select(*MASK, "row", at.alias("at"), F.lit(sign * da).alias("da"), F.lit(sign * db).alias("db"))
            ends = part if ends is None else ends.unionByName(part)
    steps = dealt(ends).groupBy(*MASK, "row", "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = W.partitionBy(*MASK, "row").orderBy("at")
    depth = lambda c: F.sum(c).over(order.rowsBetween(W.unboundedPreceding, 0)) > 0
    states = steps.select(*MASK, "row", "at", depth("da").alias("in_a"), depth("db").alias("in_b")).select(*MASK, "row", "at", keep.alias("kept"))
    # of the places where ``keep`` changes every second begins a span, and the next ends it
    turns = states.withColumn("was", F.lag("kept", 1, False).over(order)).where("kept <> was")
    return turns.select(*MASK, "row", F.col("at").alias("first"), (F.lead("at").over(order) - 1).alias("last"), "kept").where("kept").drop("kept")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns that either mask of a grid and site holds."""
    return merged(a.select(*MASK, "row", "first", "last").unionByName(b.select(*MASK, "row", "first", "last")))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns that both masks of a grid and site hold."""
    return combined(a, b, F.col("in_a") & F.col("in_b"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of the first mask of a grid and site that the second lacks."""
    return combined(a, b, F.col("in_a") & ~F.col("in_b"))


def sizes(spans: DataFrame, grid: Grid | None = None) -> DataFrame:
    """(grid_id, site, cells), with a ``grid`` also ``area_m2``, of masks in normal form."""
    n = F.col("last") - F.col("first") + 1
    area = [] if grid is None else [F.sum(n * grid.cell_area(F.col("row"))).alias("area_m2")]
    return spans.groupBy(*MASK).agg(F.sum(n).cast("long").alias("cells"), *area)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(grid_id, site_a, site_b, shared, iou) of masks in normal form that share cells of one grid.

    Spans are cut where blocks of columns end and meet within a block of a row, an equi-join:
    however many masks lie side by side in a row, a piece meets only those of its block.
    """

    def cut(spans: DataFrame, name: str) -> DataFrame:
        block = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK)))
        dealt = spans.select("grid_id", F.col("site").alias(f"site_{name}"), "row", "first", "last", block.alias("block"))
        low, high = F.greatest("first", F.col("block") * BLOCK), F.least("last", (F.col("block") + 1) * BLOCK - 1)
        return dealt.select("grid_id", f"site_{name}", "row", "block", low.alias(f"first_{name}"), high.alias(f"last_{name}"))

    both = cut(a, "a").join(cut(b, "b"), ["grid_id", "row", "block"]).where("first_a <= last_b AND first_b <= last_a")
    n = F.least("last_a", "last_b") - F.greatest("first_a", "first_b") + 1
    shared = both.groupBy("grid_id", "site_a", "site_b").agg(F.sum(n).cast("long").alias("shared"))
    size = lambda spans, name: sizes(spans).select("grid_id", F.col("site").alias(f"site_{name}"), F.col("cells").alias(f"n_{name}"))
    joined = shared.join(size(a, "a"), ["grid_id", "site_a"]).join(size(b, "b"), ["grid_id", "site_b"])
    return joined.select("grid_id", "site_a", "site_b", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("iou"))
